"""Term statistics, concepts and their mentions."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..session import cut
from . import timeline as T
from . import vectors as V
from .components import components


def counts(terms: DataFrame) -> DataFrame:
    """(grp, seg, term, tf) from one row per occurrence."""
    return terms.groupBy("grp", "seg", "term").agg(F.count("*").alias("tf"))


#: Characters of the texts of a part whose words are counted in one task.
PART = 1 << 24


def parts_of(texts: DataFrame, text: str = "text") -> int:
    """How many parts of about PART characters the texts make, and one for each core at least."""
    size = texts.agg(F.sum(F.length(text).cast("bigint"))).first()[0] or 0
    return max(texts.sparkSession.sparkContext.defaultParallelism, -(-size // PART))


def phrase_rows(rows: DataFrame, keys: list[str], text: str = "text", most: int = 3) -> DataFrame:
    """(keys, term): the candidate phrases of ``functions.text.candidate_phrases`` as rows, repeated ones too.

    Each clause is a row and each of its words starts up to ``most`` phrases, so the tests of words are plain column
    expressions that Spark compiles; nothing is shuffled.
    """
    clauses = rows.select(*keys, F.explode(F.split(F.lower(text), X.CLAUSE_BREAK)).alias("__k"))
    words = clauses.select(*keys, F.regexp_extract_all("__k", F.lit(X.PHRASE_WORD), F.lit(0)).alias("__ws")).where(F.size("__ws") > 0)
    # a row has its own words only, so long clauses are not copied for each of theirs
    following = F.transform("__ws", lambda w, i: F.struct(w.alias("__g0"), *[F.get("__ws", i + k).alias(f"__g{k}") for k in range(1, most)]))
    at = words.select(*keys, F.explode(following).alias("__g"))
    named = at.select(*keys, *[f"__g.__g{k}" for k in range(most)])
    g = [F.col(f"__g{k}") for k in range(most)]
    plain = named.select(
        *keys,
        *[f"__g{k}" for k in range(most)],
        *[(c.isNotNull() & (F.length(c) >= 2) & ~c.endswith("ly") & ~c.isin(L.VERBS)).alias(f"__ok{k}") for k, c in enumerate(g)],
        *[c.isin(L.STOPS).alias(f"__stop{k}") for k, c in enumerate(g)],
        *[c.isin(L.EDGE_ADJECTIVES).alias(f"__edge{k}") for k, c in enumerate(g)],
    )
    phrases = []
    for n in range(1, most + 1):
        fits = ~F.col("__stop0") & ~F.col(f"__stop{n - 1}") & ~F.col(f"__edge{n - 1}")
        for k in range(n):
            fits = fits & F.col(f"__ok{k}")
        for k in range(1, n - 1):
            fits = fits & (~F.col(f"__stop{k}") | (g[k] == "of"))
        phrases.append(F.when(fits, F.concat_ws(" ", *g[:n])))
    return plain.select(*keys, F.explode(F.array_compact(F.array(*phrases))).alias("term"))


def class_tf_idf(tf: DataFrame) -> DataFrame:
    """tf with score = share of the term in its segment, times ln(1 + mean segment size / all occurrences of the term).

    Totals are aggregates joined back, so that a group that holds much of the data is not one task's.
    """
    per_seg = tf.groupBy("grp", "seg").agg(F.sum("tf").alias("seg_total"))
    per_grp = per_seg.groupBy("grp").agg((F.sum("seg_total") / F.count("*")).alias("mean_size"))
    per_term = tf.groupBy("grp", "term").agg(F.sum("tf").alias("term_total"))
    joined = tf.join(per_seg, ["grp", "seg"]).join(per_term, ["grp", "term"]).join(per_grp, "grp")
    return joined.withColumn("score", F.col("tf") / F.col("seg_total") * F.log(1 + F.col("mean_size") / F.col("term_total")))


def class_tf_idf_within(tf: DataFrame) -> DataFrame:
    """class_tf_idf of groups of a text's size: windows within a group, so that tf which is dealt by grp is not shuffled."""
    seg = Window.partitionBy("grp", "seg")
    held = tf.withColumn("term_total", F.sum("tf").over(Window.partitionBy("grp", "term")))
    held = held.withColumn("seg_total", F.sum("tf").over(seg)).withColumn("first", (F.row_number().over(seg.orderBy("term")) == 1).cast("int"))
    whole = Window.partitionBy("grp")
    held = held.withColumn("mean_size", F.sum("tf").over(whole) / F.sum("first").over(whole)).drop("first")
    return held.withColumn("score", F.col("tf") / F.col("seg_total") * F.log(1 + F.col("mean_size") / F.col("term_total")))


def top_terms(scored: DataFrame, most: int, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys, "grp", "seg").orderBy(F.round("score", 9).desc(), "term")
    return scored.where("score > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


#: Stands in each segment that has a term: the segments that hold it are all there are.
EVERY = "\u0000"


@dataclass(frozen=True)
class Dealt:
    """Texts (part, grp, seg, text) whose terms are counted in parts, with what a part must know of the rest.

    A part's terms are made in memory for each use and never shuffled. places (part, grp, term, df, total) has each term of a part once, with
    the segments of the whole group that hold it and how often it stands in them. groups (grp, n, size): segments with a term, and all occurrences.
    """

    texts: DataFrame
    terms: Callable[[Column], Column]
    parts: int

    def rows(self, known: DataFrame | None = None) -> DataFrame:
        """(part, grp, seg, term, tf, told), with EVERY. With known (part, grp, term, told) those terms only, and what is told of them: it is
        dealt together with the texts, so that it is found within a part."""
        none = lambda c: F.lit(None).cast(self.texts.schema[c].dataType).alias(c)
        held = self.texts.withColumns({"one": F.lit(None).cast("string"), "told": F.lit(None).cast("double")})
        if known is not None:
            held = held.unionByName(known.select("part", "grp", none("seg"), none("text"), F.col("term").alias("one"), F.col("told").cast("double").alias("told")))
        held = held.repartition(self.parts, "part").select("part", "grp", "seg", "one", "told", self.terms(F.col("text")).alias("ts"))
        each = F.when(F.col("one").isNotNull(), F.array("one")).when(F.size("ts") > 0, F.array_append("ts", F.lit(EVERY)))
        # not a plain explode: Spark would look for empty arrays before texts are dealt, and so find all terms twice
        each = held.select("part", "grp", "seg", "told", F.explode_outer(each).alias("term")).where("term IS NOT NULL")
        found = each.groupBy("part", "grp", "seg", "term", F.col("told").isNotNull().alias("sent")).agg(F.count("*").alias("tf"), F.max("told").alias("told"))
        if known is None:
            return found.drop("sent")
        here = found.withColumn("told", F.max("told").over(Window.partitionBy("part", "grp", "term")))
        return here.where("NOT sent AND told IS NOT NULL").drop("sent")

    @functools.cached_property
    def places(self) -> DataFrame:
        w = Window.partitionBy("grp", "term")  # a row of each part
        own = self.rows().groupBy("part", "grp", "term").agg(F.when(F.col("term") == EVERY, F.count("seg")).otherwise(F.count("*")).alias("df"), F.sum("tf").alias("own"))
        return cut(own.select("part", "grp", "term", F.sum("df").over(w).alias("df"), F.sum("own").over(w).alias("total"), "own"))

    @property
    def groups(self) -> DataFrame:
        every = F.col("term") == EVERY
        return self.places.groupBy("grp").agg(F.max(F.when(every, F.col("df"))).alias("n"), F.sum(F.when(~every, F.col("own"))).alias("size"))

    def known(self) -> DataFrame:
        return self.places.where(F.col("term") != EVERY).join(self.groups, "grp")


def dealt(texts: DataFrame, terms: Callable[[Column], Column]) -> Dealt:
    """texts (grp, seg, text) in parts; terms makes an array of a text's terms, repeated ones too. Texts of one segment are one."""
    texts = texts.where("grp IS NOT NULL")
    parts = 4 * parts_of(texts)
    return Dealt(texts.select(F.pmod(F.xxhash64("grp", "seg"), F.lit(parts)).cast("int").alias("part"), "grp", "seg", "text"), terms, parts)


def class_tf_idf_of(d: Dealt) -> DataFrame:
    """class_tf_idf of dealt texts, with their part."""
    told = d.rows(d.known().withColumn("told", F.log(1 + F.col("size") / F.col("n") / F.col("total"))))
    return told.withColumn("score", F.col("tf") / F.sum("tf").over(Window.partitionBy("part", "grp", "seg")) * F.col("told"))


def max_tf_idf(d: Dealt) -> DataFrame:
    """(grp, term, score, segments): sublinear TF-IDF of unit length in each segment, the most over segments."""
    known = d.known().where((F.col("n") <= 3) | (F.col("df") <= 0.95 * F.col("n")))
    told = d.rows(known.withColumn("told", F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    w = told.withColumn("w", (1 + F.log("tf")) * F.col("told"))
    size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("part", "grp", "seg")))
    return w.withColumn("size", size).groupBy("grp", "term").agg(F.max(F.col("w") / F.col("size")).alias("score"), F.count("*").alias("segments"))


def ranked_candidates(scores: DataFrame, most: int) -> DataFrame:
    """Best by the plain score; longer phrases gain only after the cut."""
    w = Window.partitionBy("grp").orderBy(F.round("score", 9).desc(), "term")
    usable = scores.where(X.usable_phrase(F.col("term")))
    boost = 1 + 0.2 * (F.size(F.split("term", " ")) - 1)
    return usable.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).withColumn("boosted", F.col("score") * boost)


def stem(c: Column) -> Column:
    return F.regexp_replace(c, r"(ies|es|s|ing|ed)\b", "")


def contained(terms: DataFrame) -> DataFrame:
    """(grp, part, whole) of every two different terms of a group of which the one stands in the other.

    A term is looked up by its rarest run of three signs (by itself where it is shorter), in an index of all runs of up to three
    signs of the group's terms, so that a term meets those only that share that run. terms: grp, term, each pair once.
    """

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length("term") - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.substring("term", i, F.lit(n)))

    # of a term shorter than n the last is the whole, which is in the index anyway
    runs = F.concat(of(1), of(2), of(3))
    index = terms.select("grp", "term", F.explode(F.array_distinct(runs)).alias("run"))
    rare = index.groupBy("grp", "run").agg(F.count("*").alias("df"))
    own = index.where(F.length("run") == F.least(F.length("term"), F.lit(3))).join(rare, ["grp", "run"])
    asked = own.groupBy("grp", "term").agg(F.min_by("run", F.struct("df", "run")).alias("run")).withColumnRenamed("term", "part")
    held = asked.join(index.withColumnRenamed("term", "whole"), ["grp", "run"])
    return held.where((F.col("part") != F.col("whole")) & F.contains("whole", "part")).select("grp", "part", "whole")


def similar_groups(phrases: DataFrame, *, least: float = 0.82, least_contained: float = 0.72) -> DataFrame:
    """(grp, term, head): phrases that say the same, with the least of them.

    Two phrases of a group are linked when they have one stem, when their vectors' cosine is at least ``least``, or when one stands in the
    other and the cosine is above ``least_contained``; links of links count. phrases: grp, term, vector. Repeated phrases are one (with their least vector); nulls
    in grp or term are left out; a phrase without a vector, or with zeros, is linked by its stem alone.
    """
    end = F.lit("\u0001")
    held = phrases.where(F.col("grp").isNotNull() & F.col("term").isNotNull()).groupBy("grp", "term").agg(F.min(F.col("vector").cast("array<double>")).alias("v"))
    held = cut(held.withColumn("v", F.when(F.exists("v", lambda x: x != 0), F.col("v"))).withColumn("id", F.concat(F.col("grp").cast("string"), end, "term")))
    first = held.groupBy("grp", stem(F.col("term")).alias("stem")).agg(F.min("id").alias("a"))
    stems = held.withColumn("stem", stem(F.col("term"))).join(first, ["grp", "stem"]).where("a <> id").select("a", F.col("id").alias("b"))
    near = V.near_links(held, least, key="id", vector="v", by="grp")
    side = lambda name, s: held.select("grp", F.col("term").alias(name), F.col("id").alias(s), F.col("v").alias(f"{s}_v"))
    pairs = contained(held.select("grp", "term")).join(side("part", "a"), ["grp", "part"]).join(side("whole", "b"), ["grp", "whole"])
    within = pairs.where(T.cosine(F.col("a_v"), F.col("b_v")) > least_contained).select("a", "b")
    found = components(stems.unionByName(near).unionByName(within))
    heads = held.select(F.col("id").alias("component"), F.col("term").alias("head"))
    named = found.join(heads, "component").select(F.col("v").alias("id"), "head")
    return held.drop("v").join(named, "id", "left").select("grp", "term", F.coalesce("head", "term").alias("head"))


def rolled_up(candidates: DataFrame, most: int) -> DataFrame:
    """Candidates of one stem become a concept: head, summed score, names by score."""
    grouped = candidates.withColumn("stem", stem(F.col("term"))).groupBy("grp", "stem").agg(
        F.sum("boosted").alias("score"),
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("boosted")).alias("low"), "term"))), lambda x: x["term"]).alias("names"),
    )
    w = Window.partitionBy("grp").orderBy(F.round("score", 9).desc(), F.element_at("names", 1))
    return grouped.select("grp", F.row_number().over(w).alias("concept"), X.titled(F.element_at("names", 1)).alias("label"), "score", "names").where(F.col("concept") <= most)


def main_words(docs: DataFrame, most: int = 6) -> DataFrame:
    """(video_id, concept, alias): the commonest longer words of each document."""
    words = docs.select(F.col("doc_id").alias("video_id"), F.explode_outer(X.tokens(F.col("text"))).alias("alias")).where((F.length("alias") > 3) & ~F.col("alias").isin(L.STOPS))
    tf = words.groupBy("video_id", "alias").agg(F.count("*").alias("tf"))
    w = Window.partitionBy("video_id").orderBy(F.desc("tf"), "alias")
    return tf.withColumn("concept", F.row_number().over(w)).where(F.col("concept") <= most).select("video_id", "concept", "alias")


def mentions(aliases: DataFrame, lines: DataFrame, *more: str) -> DataFrame:
    """(video_id, concept, pos, start, more): lines that hold one of a concept's aliases, in any case. Nothing is shuffled where aliases and
    lines are of the same texts, dealt by video."""
    held = aliases.hint("merge").join(lines, "video_id").where(F.contains(F.lower("text"), "alias"))
    return held.select("video_id", "concept", "pos", "start", *more).distinct()


def cooccurrence(mentioned: DataFrame) -> DataFrame:
    """(video_id, a, b, weight): lines that mention both. A line mentions a few concepts, so pairs stay few."""
    left = mentioned.select("video_id", "pos", F.col("concept").alias("a"))
    right = mentioned.select("video_id", "pos", F.col("concept").alias("b"))
    return left.join(right, ["video_id", "pos"]).where("a < b").groupBy("video_id", "a", "b").agg(F.count("*").cast("double").alias("weight"))


def strongest(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """The twice as many edges as there are concepts that weigh most."""
    w = Window.partitionBy("video_id").orderBy(F.desc("weight"), "a", "b")
    return edges.join(sizes, "video_id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 2 * F.col("n")).drop("n")


def relation(low: Column, a: Column, b: Column) -> Column:
    """(label, reversed) of two terms in a lowered sentence, from what stands between them."""
    quoted = lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))
    found = F.lit(None).cast("struct<label:string,reversed:boolean>")
    for pattern, label in reversed(L.RELATIONS):
        back = F.struct(F.lit(label).alias("label"), F.lit(True).alias("reversed"))
        on = F.struct(F.lit(label).alias("label"), F.lit(False).alias("reversed"))
        found = F.when(F.regexp_like(low, F.concat(quoted(b), F.lit(pattern), quoted(a))), back).otherwise(found)
        found = F.when(F.regexp_like(low, F.concat(quoted(a), F.lit(pattern), quoted(b))), on).otherwise(found)
    return F.coalesce(found, F.struct(F.lit(L.UNRELATED).alias("label"), F.lit(False).alias("reversed")))
