"""Answers of a label model as patches of a map: what changes at which node, and which edges are replaced.

Every rule is a join or an aggregate of answers, candidates and nodes, so a map may have any number of them. A node has at most one
patch, hence the order of patches does not matter; ``as_log`` gives them as lines of an edit log.

Tables: ``nodes`` (map_id, node_id, parent_id, ord, text, and where they are known summary, tag, oneline), ``candidates`` (map_id, cid, node_id,
place, and where they are needed sid, of, fixed, recall): s1, s2, ... are sections, c1, ... concepts of a section ``sid``, d1, ... details of
a concept ``of``; ``place`` is the order within a kind. ``answers`` are lines as ``labels.parsed`` gives them, answer_id being the map's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..session import cut

#: Titles that make up a map's summary where the answer has none.
TITLES = 6
ONE_LINE = "In one line: "
#: Where the lines of a kind begin in the log.
KIND = 1_000_000_000


def _with(rows: DataFrame, **kinds: str) -> DataFrame:
    """rows with the columns that are missing, as nulls."""
    return rows.withColumns({c: F.lit(None).cast(kind) for c, kind in kinds.items() if c not in rows.columns})


def _proposals(nodes: DataFrame, candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """(map_id, node_id, seq, place, judged, text, summary, tag): what the answers say; judged rows stand in the order of seq and place."""
    said = answers.where(F.col("first")).withColumnRenamed("answer_id", "map_id")
    of_kind = lambda k: candidates.where(F.col("cid").startswith(k))
    whole = lambda k, name: said.where(F.col("kind") == k).select("map_id", F.col("label").alias(name))
    labels = lambda k: said.where(F.col("kind") == k).select("map_id", F.col("target").alias("cid"), "line", "label", "tag")
    summaries = (
        answers.where("kind = 'S' AND target IS NOT NULL AND summary IS NOT NULL").groupBy(F.col("answer_id").alias("map_id"), F.col("target").alias("cid")).agg(F.min_by("summary", "line").alias("about"))
    )
    all_about = whole("M", "all_about")
    named = of_kind("s").join(labels("S").select("map_id", "cid", "label"), ["map_id", "cid"], "left").join(nodes.select("map_id", "node_id", "text"), ["map_id", "node_id"])
    among = Window.partitionBy("map_id").orderBy("place", "cid")
    first = named.where(~F.coalesce("recall", F.lit(False))).withColumn("n", F.row_number().over(among)).where(F.col("n") <= TITLES)
    heads = first.groupBy("map_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.coalesce("label", "text").alias("t")))), lambda x: x["t"]), " · ").alias("heads"))

    none = F.lit(None).cast("string")
    shape = lambda rows, seq, place, judged, text, summary, tag: rows.select(
        "map_id", "node_id", seq.cast("bigint").alias("seq"), place.cast("bigint").alias("place"), F.lit(judged).alias("judged"), text.alias("text"), summary.alias("summary"), tag.alias("tag")
    )
    tops = nodes.where("parent_id IS NULL").groupBy("map_id").agg(F.min("node_id").alias("node_id"))
    root = tops.join(whole("R", "title"), "map_id", "left").join(all_about, "map_id", "left").join(heads, "map_id", "left")
    about = F.coalesce("all_about", F.when(F.col("title").isNotNull(), F.coalesce("heads", F.lit(""))))
    parts = [shape(root, F.lit(0), F.lit(0), True, F.col("title"), about, none)]

    sections = named.join(summaries, ["map_id", "cid"], "left").join(all_about, "map_id", "left")
    title = F.when(F.col("label").isNotNull() & ~F.coalesce("fixed", F.lit(False)), X.truncated(F.col("label"), 60))
    recall = F.coalesce("recall", F.lit(False))
    parts.append(shape(sections, KIND + F.col("place"), F.col("place"), True, title, F.when(recall, F.col("all_about")).otherwise(F.col("about")), none))
    lines = nodes.where("oneline").groupBy("map_id", F.col("parent_id").alias("above")).agg(F.min_by("node_id", F.struct("ord", "node_id")).alias("node_id"))
    recalled = sections.where(recall & F.col("all_about").isNotNull()).select("map_id", F.col("node_id").alias("above"), "place", "all_about").join(lines, ["map_id", "above"])
    parts.append(shape(recalled, KIND + F.col("place"), F.col("place"), False, F.concat(F.lit(ONE_LINE), "all_about"), none, none))

    concepts = of_kind("c").join(labels("C"), ["map_id", "cid"], "left")
    parts.append(shape(concepts, 2 * KIND + F.coalesce("line", F.lit(0)), F.col("place"), True, F.when(F.col("label").isNotNull(), X.truncated(F.col("label"), 110)), none, none))

    details = of_kind("d").join(nodes.select("map_id", "node_id", F.col("tag").alias("own")), ["map_id", "node_id"])
    given = labels("D")
    direct = given.where(F.col("cid").startswith("d")).select("map_id", "cid", F.lit(0).alias("through"), "line", "label", "tag")
    # an answer to a concept is one to its first detail of that tag, or to its first detail
    asked = given.where(F.col("cid").startswith("c")).select("map_id", F.col("cid").alias("of"), "line", "label", "tag")
    owned = details.select("map_id", "of", "cid", "place", "own")
    other = F.when(F.col("own").eqNullSafe(F.col("tag")) & F.col("tag").isNotNull(), 0).otherwise(1)
    picked = asked.join(owned, ["map_id", "of"]).groupBy("map_id", "of", "line").agg(F.min_by(F.struct("cid", "label", "tag"), F.struct(other, "place", "cid")).alias("p"))
    through = picked.select("map_id", "p.cid", F.lit(1).alias("through"), "line", "p.label", "p.tag")
    chosen = direct.unionByName(through).groupBy("map_id", "cid").agg(F.min_by(F.struct("label", "tag", "line", "through"), F.struct("through", "line")).alias("a"))
    told = details.join(chosen, ["map_id", "cid"], "left").withColumn("now", F.when(F.col("a").isNotNull(), F.coalesce("a.tag", "own")))
    text = F.when(F.col("a").isNotNull(), X.truncated(F.concat_ws(": ", "now", "a.label"), 120))
    parts.append(shape(told, 3 * KIND + F.coalesce(F.col("a.through") * (KIND // 2) + F.col("a.line"), F.lit(0)), F.col("place"), True, text, none, F.col("now")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def patches(nodes: DataFrame, candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """(map_id, node_id, seq, text, summary, tag): the new values; null is no change.

    No two labels say the same: of nodes whose text would be equal in small letters and figures, the first keeps it (root, sections,
    concepts, details, each in their order) and the others keep the text that they have. A value that is there already is no change.
    """
    nodes = _with(nodes, summary="string", tag="string", oneline="boolean")
    candidates = cut(_with(candidates, sid="string", of="string", fixed="boolean", recall="boolean"))
    answers = cut(answers)  # read for every kind, and dear to parse
    old = nodes.select("map_id", "node_id", *[F.col(c).alias(f"old_{c}") for c in ("text", "summary", "tag")])
    held = cut(_proposals(nodes, candidates, answers)).join(old, ["map_id", "node_id"])
    changed: dict[str, Column] = {c: F.when(~F.col(c).eqNullSafe(F.col(f"old_{c}")), F.col(c)) for c in ("text", "summary", "tag")}
    held = cut(held.withColumns(changed).withColumn("same", X.normal(F.coalesce("text", "old_text", F.lit("")))).withColumn("turn", F.struct(F.floor(F.col("seq") / KIND), "place", "node_id")))
    first = held.where("judged").groupBy("map_id", "same").agg(F.min("turn").alias("first"))
    kept = held.join(first, ["map_id", "same"], "left").withColumn("text", F.when(~F.col("judged") | (F.col("turn") == F.col("first")), F.col("text")))
    return kept.select("map_id", "node_id", "seq", "text", "summary", "tag").where("text IS NOT NULL OR summary IS NOT NULL OR tag IS NOT NULL")


def links(candidates: DataFrame, answers: DataFrame, edges: DataFrame) -> DataFrame:
    """(map_id, seq, type, edge_id, source, target, label): ``edge:add`` of every answered link, after the ``edge:remove`` of the edge that it replaces.

    A link ties concepts of different sections, neither for recall. An edge between the two, in either direction, is replaced where it
    says no more than that they are related; else the link is dropped. edges: map_id, edge_id, source, target, label, ord.
    """
    candidates = _with(candidates, sid="string", recall="boolean")
    answers = cut(answers.where(F.col("first") & (F.col("kind") == "X")))
    recall = candidates.where(F.col("cid").startswith("s") & F.col("recall")).select("map_id", F.col("cid").alias("sid"))
    concepts = candidates.where(F.col("cid").startswith("c")).join(recall, ["map_id", "sid"], "left_anti")
    end = lambda c, name: concepts.select("map_id", F.col("cid").alias(c), F.col("node_id").alias(f"{name}_id"), F.col("sid").alias(f"{name}_sid"))
    said = answers.select(F.col("answer_id").alias("map_id"), "line", "label", F.col("source").alias("a"), F.col("sink").alias("b"))
    held = said.join(end("a", "a"), ["map_id", "a"]).join(end("b", "b"), ["map_id", "b"]).where("a_sid <> b_sid")
    pair = lambda a, b: (F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    there = edges.groupBy("map_id", *pair("source", "target")).agg(F.min_by(F.struct("edge_id", F.col("label").alias("was")), F.struct("ord", "edge_id")).alias("e"))
    met = cut(held.select("*", *pair("a_id", "b_id")).join(there, ["map_id", "lo", "hi"], "left").where((F.col("e").isNull()) | (F.col("e.was") == L.UNRELATED)))
    seq = 4 * KIND + 2 * F.col("line").cast("bigint")
    name = F.concat(F.lit("e"), F.left(F.sha1(F.concat_ws("|", F.col("map_id").cast("string"), F.col("line").cast("string"), "a_id", "b_id").cast("binary")), F.lit(12)))
    none = lambda c: F.lit(None).cast("string").alias(c)
    gone = met.where("e IS NOT NULL").select("map_id", seq.alias("seq"), F.lit("edge:remove").alias("type"), F.col("e.edge_id").alias("edge_id"), none("source"), none("target"), none("label"))
    new = met.select("map_id", (seq + 1).alias("seq"), F.lit("edge:add").alias("type"), name.alias("edge_id"), F.col("a_id").alias("source"), F.col("b_id").alias("target"), "label")
    return gone.unionByName(new)


def as_log(patched: DataFrame, linked: DataFrame) -> DataFrame:
    """Changes of text and edges as the lines of an edit log, as ``tree.apply_ops`` reads it."""
    none = lambda c: F.lit(None).cast("string").alias(c)
    texts = patched.where("text IS NOT NULL").select("map_id", "seq", F.lit("update").alias("type"), F.col("node_id").alias("id"), "text", none("source"), none("target"))
    return texts.unionByName(linked.select("map_id", "seq", "type", F.col("edge_id").alias("id"), none("text"), "source", "target"))


def patched_nodes(nodes: DataFrame, patched: DataFrame) -> DataFrame:
    """nodes with their new values."""
    nodes = _with(nodes, summary="string", tag="string")
    new = patched.select("map_id", "node_id", *[F.col(c).alias(f"new_{c}") for c in ("text", "summary", "tag")])
    held = nodes.join(new, ["map_id", "node_id"], "left")
    return held.withColumns({c: F.coalesce(f"new_{c}", c) for c in ("text", "summary", "tag")}).select(nodes.columns)
