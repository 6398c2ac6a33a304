"""From captions to an outline: entries, blocks, sections, keywords and nodes, each a table of its own keyed by video."""

from __future__ import annotations

from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..operators import lexical as C
from ..operators import timeline as T
from ..operators.folds import ordered_scan
from ..session import cut, spread

#: Features of the hashed word vectors that sections are found with.
FEATURES = 64
#: Concepts of a section, details of a concept and words of a detail, by mode.
MODES = {"revision": (3, 2, 14), "academic": (5, 3, 16), "deep": (7, 5, 20)}
#: Keywords of a section that concepts are picked from.
KEYWORDS = 8


def vectors(blocks: DataFrame) -> DataFrame:
    """blocks with a hashed vector of their words; another provider may put any array<double> there."""
    words = F.filter(X.tokens(F.col("text")), lambda w: (F.length(w) > 2) & ~w.isin(L.STOPS))
    hashed = HashingTF(inputCol="words", outputCol="hashed", numFeatures=FEATURES).transform(blocks.withColumn("words", words))
    return hashed.withColumn("v", vector_to_array("hashed")).drop("words", "hashed")


def sections(blocks: DataFrame, mode: str) -> DataFrame:
    """(video_id, seg_no, block_no) of every block: a section begins at each chosen boundary."""
    whole = Window.partitionBy("video_id")
    held = vectors(blocks).withColumn("n", F.count("*").over(whole).cast("int")).withColumn("duration", F.max_by("end", "block_no").over(whole))
    gaps = T.gap_depths(held, "video_id", "block_no", "v", F.col("new_speaker"))
    cuts = T.boundaries(gaps, "video_id", mode).select("video_id", F.col("gap").alias("block_no"), F.lit(1).alias("opens"))
    upto = whole.orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = blocks.join(cuts, ["video_id", "block_no"], "left")
    return marked.select("video_id", "block_no", F.sum(F.coalesce("opens", F.lit(0))).over(upto).cast("int").alias("seg_no"))


def keywords(blocks: DataFrame, seg: str = "block_no", most: int = 6) -> DataFrame:
    """(grp, seg, term, score, rank): class TF-IDF of phrases of one or two words, of blocks or, with seg_no, of sections."""
    texts = blocks.select(F.col("video_id").alias("grp"), F.col(seg).alias("seg"), "text").where("grp IS NOT NULL AND seg IS NOT NULL")
    # texts are dealt by video; their phrases, many times as much, are counted where they are and not written
    terms = C.phrase_rows(texts.repartition(C.parts_of(texts), "grp"), ["grp", "seg"], "text", 2).where(F.length("term") > 2)
    return C.top_terms(C.class_tf_idf_within(C.counts(terms)), most).select("grp", "seg", "term", "score", "rank")


def picks(heads: DataFrame, most: int) -> DataFrame:
    """(video_id, seg_no, start, end, i, term): of each section's keywords those that no section before it has picked, then the others, by
    rank. Sections are read in order with the terms that are used up."""
    every = heads.select("video_id", "seg_no", "start", "end", F.posexplode(X.prefer_phrases(F.col("k"), KEYWORDS)).alias("place", "term"))

    def step(state, row):
        seg, term = row
        used, at, taken = state if state is not None else (set(), None, 0)
        taken, fresh = taken if at == seg else 0, term not in used
        if fresh and taken < most:
            used.add(term)
            taken += 1
        return (used, seg, taken), int(fresh)

    held = ordered_scan(every, "video_id", ["seg_no", "place"], ["seg_no", "term"], step, "fresh")
    order = Window.partitionBy("video_id", "seg_no").orderBy(F.desc("fresh"), "place")
    return held.withColumn("i", F.row_number().over(order) - 1).where(F.col("i") < most).drop("place", "fresh")


def lines_of(entries: DataFrame, spans: DataFrame) -> DataFrame:
    """(video_id, seg_no, idx, at, text): each line with the section that it begins in, by one sort of both."""
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    a = spans.select("video_id", F.col("start").alias("at"), F.lit(0).alias("kind"), F.struct("seg_no", "end").alias("held"), none("int", "idx"), none("string", "text"))
    b = entries.select("video_id", F.col("start").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(a.schema["held"].dataType).alias("held"), F.col("idx").cast("int").alias("idx"), "text")
    before = Window.partitionBy("video_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("held", F.last("held", ignorenulls=True).over(before)).where("kind = 1 AND at < held.end")
    return found.select("video_id", F.col("held.seg_no").alias("seg_no"), "idx", "at", "text")


def mentions(named: DataFrame, lines: DataFrame) -> DataFrame:
    """(video_id, seg_no, i, idx, at, text, tag, meaning): a section's lines that hold the term, the same line once."""
    held = named.select("video_id", "seg_no", "i", "term").join(lines, ["video_id", "seg_no"]).where(F.contains(F.lower("text"), "term"))
    first = held.groupBy("video_id", "seg_no", "i", "term", X.normal(F.col("text")).alias("same")).agg(F.min_by(F.struct("idx", "at", "text"), "idx").alias("l"))
    text = F.col("text")
    held = spread(cut(first.select("video_id", "seg_no", "i", "term", "l.idx", "l.at", "l.text")))
    return held.withColumn("tag", X.line_tag(text)).withColumn("meaning", X.meaning(text, F.col("term"))).drop("term")


def details(said: DataFrame, anchors: DataFrame, most: int, untagged: bool) -> DataFrame:
    """(video_id, seg_no, i, ord, tag, at, text) of the lines below each concept: the first of each tag, then other tagged ones; where there
    are none, one line as a definition. The line that gave the meaning comes last. untagged: fill up with the others."""
    key = ["video_id", "seg_no", "i"]
    held = said.drop("meaning").join(anchors.select(*key, F.col("a.idx").alias("anchor")), key).withColumn("is_anchor", (F.col("idx") == F.col("anchor")).cast("int"))
    whole = Window.partitionBy(*key)
    tagged = F.col("tag").isNotNull() & (F.col("is_anchor") == 0)
    held = held.withColumn("any", F.max(tagged.cast("int")).over(whole)).withColumn("nth", F.row_number().over(Window.partitionBy(*key, "tag", "is_anchor").orderBy("idx")))
    held = held.withColumn("plain", F.row_number().over(whole.orderBy("is_anchor", "idx")))
    rest = F.when((F.col("is_anchor") == 0) & F.lit(untagged), 3)
    turn = F.when(tagged & (F.col("nth") == 1), 0).when(tagged, 1).when((F.col("any") == 0) & (F.col("plain") == 1), 2).otherwise(rest)
    held = held.withColumn("turn", turn).where("turn IS NOT NULL").withColumn("tag", F.when(F.col("turn") == 2, F.lit("Def")).when(F.col("turn") < 2, F.col("tag")))
    held = held.withColumn("n", F.row_number().over(whole.orderBy("turn", "idx"))).where(F.col("n") <= most)
    names = F.array(*map(F.lit, [*L.TAGS, "Def"]))
    by_tag = F.coalesce(F.nullif(F.array_position(names, F.col("tag")), F.lit(0)), F.lit(len(L.TAGS) + 2))
    return held.withColumn("ord", F.row_number().over(whole.orderBy(by_tag, "idx")) - 1).select(*key, "ord", "tag", "at", "text")


def build(captions: DataFrame, mode: str = "revision") -> dict[str, DataFrame]:
    """entries, blocks, sections, keywords and nodes(map_id, node_id, parent_id, ord, type, text, start, end)."""
    entries = T.normalized(captions)
    blocks = spread(cut(T.blocks(entries)))  # each is read several times below
    segment = cut(sections(blocks, mode))
    placed = blocks.join(segment, ["video_id", "block_no"])
    words = keywords(placed, "seg_no", KEYWORDS)
    spans = placed.groupBy("video_id", "seg_no").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    terms = words.groupBy(F.col("grp").alias("video_id"), F.col("seg").alias("seg_no")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("k"))
    heads = spans.join(terms, ["video_id", "seg_no"], "left").withColumn("k", F.coalesce("k", F.array().cast("array<string>")))
    heads = cut(heads)
    part = lambda *cs: F.concat_ws(".", *[c.cast("string") for c in cs])
    video, seg = F.col("video_id"), F.col("seg_no")
    root = heads.groupBy("video_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("k", "seg_no").alias("k")).select(
        video.alias("map_id"), part(video).alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("ord"), F.lit("root").alias("type"),
        F.coalesce(X.keyword_title(F.col("k")), part(video)).alias("text"), "start", "end",
    )
    section = heads.select(
        video.alias("map_id"), part(video, seg).alias("node_id"), part(video).alias("parent_id"), seg.alias("ord"), F.lit("section").alias("type"),
        F.coalesce(X.keyword_title(X.prefer_phrases(F.col("k"), 6)), F.concat(F.lit("Part "), (seg + 1).cast("string"))).alias("text"), "start", "end",
    )
    n_concepts, n_details, n_words = MODES.get(mode, MODES["revision"])
    named = spread(cut(picks(heads, n_concepts)))
    said = spread(cut(mentions(named, lines_of(entries, spans))))
    anchors = spread(cut(said.groupBy("video_id", "seg_no", "i").agg(F.min_by(F.struct("idx", "text", "meaning"), F.struct(F.col("meaning").isNull(), F.col("idx"))).alias("a"))))
    first = F.coalesce("a.meaning", X.lower_first(X.compressed(F.col("a.text"), 10)))
    concept = named.join(anchors, ["video_id", "seg_no", "i"], "left").select(
        video.alias("map_id"), part(video, seg, F.col("i")).alias("node_id"), part(video, seg).alias("parent_id"), F.col("i").alias("ord"), F.lit("concept").alias("type"),
        F.concat(X.titled(F.col("term")), F.coalesce(F.concat(F.lit(": "), first), F.lit(""))).alias("text"), "start", "end",
    )
    detail = details(said, anchors, n_details, mode == "deep").select(
        video.alias("map_id"), part(video, seg, F.col("i"), F.col("ord")).alias("node_id"), part(video, seg, F.col("i")).alias("parent_id"), "ord", F.lit("detail").alias("type"),
        F.concat(F.coalesce(F.concat("tag", F.lit(": ")), F.lit("")), X.compressed(F.col("text"), n_words)).alias("text"), F.col("at").alias("start"), F.col("at").alias("end"),
    )
    nodes = root.unionByName(section).unionByName(concept).unionByName(detail)
    return {"entries": entries, "blocks": blocks, "sections": segment, "keywords": words, "nodes": nodes}
