"""Captions, blocks, sentences, units, chapters and topic boundaries: intervals in time, by video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .folds import ordered_scan

#: Seconds of a block, and how far a block without a sentence end may go over.
BLOCK, SENTENCE_BLOCK, OVER = 25.0, 12.0, 1.6
UNIT_LEAST, UNIT_MOST, UNIT_WORDS = 2.5, 10.0, 40
#: Modes: seconds of a section, fewest and most sections.
MODES = {"revision": (300.0, 3, 6), "academic": (200.0, 4, 9), "deep": (150.0, 4, 12)}
SENTENCE_END = r"[.?!]\s*$"


def normalized(captions: DataFrame) -> DataFrame:
    """Cleaned entries (video_id, idx, start, end, text, new_speaker) without empty lines and repeats of the line before."""
    w = Window.partitionBy("video_id").orderBy("pos")
    rows = captions.withColumn("new_speaker", X.is_new_speaker(F.col("text"))).withColumn("text", X.clean_caption(F.col("text"))).where("text <> ''")
    rows = rows.withColumn("before", F.lag(F.lower("text")).over(w)).where(F.coalesce(F.col("before") != F.lower("text"), F.lit(True)))
    idx = (F.row_number().over(Window.partitionBy("video_id").orderBy("start", "pos")) - 1).cast("int")
    return rows.select("video_id", idx.alias("idx"), "start", F.greatest("end", F.col("start") + 0.5).alias("end"), "text", "new_speaker")


def block_numbers(entries: DataFrame, seconds: float = BLOCK) -> DataFrame:
    """entries with block_no: a new block before a new speaker, and after a sentence end beyond ``seconds``."""

    def step(state, row):
        start, end, text, speaker = row
        if state is None:
            return (start, 0, text), 0
        first, no, before = state
        span = end - first
        if speaker or span > seconds * OVER or (span > seconds and before.rstrip().endswith((".", "?", "!"))):
            return (start, no + 1, text), no + 1
        return (first, no, text), no

    return ordered_scan(entries, "video_id", ["idx"], ["start", "end", "text", "new_speaker"], step, "block_no")


def merged_blocks(numbered: DataFrame, number: str = "block_no") -> DataFrame:
    return numbered.groupBy("video_id", number).agg(
        F.min_by("start", "idx").alias("start"),
        F.max_by("end", "idx").alias("end"),
        F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY idx)").alias("text"),
        F.min_by("new_speaker", "idx").alias("new_speaker"),
    )


def blocks(entries: DataFrame, seconds: float = BLOCK) -> DataFrame:
    return merged_blocks(block_numbers(entries, seconds))


def timed_sentences(entries: DataFrame) -> DataFrame:
    """Sentences of short blocks; a block's time is shared out by characters."""
    held = blocks(entries, SENTENCE_BLOCK).withColumn("parts", X.sentences(F.col("text")))
    total = F.greatest(F.aggregate("parts", F.lit(0), lambda a, p: a + F.length(p)), F.lit(1))
    each = held.withColumn("total", total).select("*", F.posexplode("parts").alias("part", "sentence"))
    before = F.aggregate(F.slice("parts", 1, F.col("part")), F.lit(0), lambda a, p: a + F.length(p))
    share = lambda n: F.col("start") + (F.col("end") - F.col("start")) * n / F.col("total")
    no = F.row_number().over(Window.partitionBy("video_id").orderBy("block_no", "part")) - 1
    return each.select(
        "video_id",
        no.cast("int").alias("sent_no"),
        share(before).alias("start"),
        share(before + F.length("sentence")).alias("end"),
        F.col("sentence").alias("text"),
        (F.col("new_speaker") & (F.size("parts") == 1)).alias("new_speaker"),
    )


def unit_numbers(entries: DataFrame) -> DataFrame:
    """entries with unit_no: a unit ends with a sentence, after ten seconds, or with forty words."""
    ends = (".", "?", "!", "।", "॥", "؟", "。", "？", "！")

    def step(state, row):
        start, end, text = row
        no, first, words, closed = state or (0, start, 0, False)
        if closed:
            no, first, words = no + 1, start, 0
        words += len(text.split())
        span = end - first
        closed = (text.rstrip().endswith(ends) and span >= UNIT_LEAST) or span >= UNIT_MOST or words >= UNIT_WORDS
        return (no, first, words, closed), no

    return ordered_scan(entries, "video_id", ["idx"], ["start", "end", "text"], step, "unit_no")


def units(entries: DataFrame) -> DataFrame:
    return merged_blocks(unit_numbers(entries), "unit_no")


def stride_rank(i: Column) -> Column:
    """Coarse to fine: every eighth first, then every fourth, second, and the rest."""
    return F.when(i % 8 == 0, 0).when(i % 4 == 0, 1).when(i % 2 == 0, 2).otherwise(3)


# Fixed value: the form of a chapter's line in a description.
CHAPTER_LINE = r"^\s*[(\[]?((?:\d{1,2}:)?\d{1,2}:\d{2})[)\]]?\s*[-–—:|]?\s*(.+?)\s*$"


def chapters(descriptions: DataFrame) -> DataFrame:
    """(video_id, chap_no, title, start, end) from lines such as ``1:30 Title``: two at least, and the first starts at 0 or 1."""
    lines = descriptions.select("video_id", "duration", F.posexplode(F.split("description", "\n")).alias("line", "t"))
    lines = lines.where(F.col("t").rlike(CHAPTER_LINE)).select(
        "video_id",
        "duration",
        "line",
        X.seconds_of(F.regexp_extract("t", CHAPTER_LINE, 1)).alias("start"),
        F.btrim(F.regexp_extract("t", CHAPTER_LINE, 2), F.lit(" -–—")).alias("title"),
    )
    whole = Window.partitionBy("video_id")
    good = lines.withColumn("n", F.count("*").over(whole)).withColumn("head", F.min_by("start", "line").over(whole)).where("n >= 2 AND head <= 1")
    order = whole.orderBy("start", "line")
    last = F.coalesce(F.when(F.col("duration") != 0, F.col("duration")), F.col("start") + 60)
    return good.select("video_id", (F.row_number().over(order) - 1).cast("int").alias("chap_no"), "title", "start", F.coalesce(F.lead("start").over(order), last).alias("end"))


def chapter_segments(blocks_: DataFrame, chapters_: DataFrame) -> DataFrame:
    """Blocks of each chapter, from a second before its start to the next one's; chapters without blocks vanish."""
    until = F.lead("start").over(Window.partitionBy("video_id").orderBy("start", "chap_no"))
    spans = chapters_.select("video_id", "chap_no", "title", F.col("start").alias("c_start"), until.alias("c_until"))
    held = blocks_.join(spans, "video_id").where((F.col("start") >= F.col("c_start") - 1) & (F.col("c_until").isNull() | (F.col("start") < F.col("c_until"))))
    rank = F.row_number().over(Window.partitionBy("video_id", "chap_no").orderBy("block_no"))
    seg = F.dense_rank().over(Window.partitionBy("video_id").orderBy("chap_no"))
    return held.withColumn("rank", rank).withColumn("seg_no", seg.cast("int")).groupBy("video_id", "seg_no", "title").agg(
        F.min("start").alias("start"),
        F.max_by("end", "block_no").alias("end"),
        F.count("*").alias("n_blocks"),
        (F.count_if(F.col("new_speaker") & (F.col("rank") > 1)) + 1).alias("speakers"),
        F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY block_no)").alias("text"),
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 where either has no length, null where either is null."""
    size = norm(a) * norm(b)
    return F.when(size.isNull(), F.lit(None).cast("double")).when(size > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size))).otherwise(F.lit(0.0))


def gap_depths(rows: DataFrame, key: str, order: str, vector: str, speaker: Column | None = None) -> DataFrame:
    """(key, gap, similarity, smooth, depth) between neighbours: how far a gap's likeness lies below the best on either side."""
    w = Window.partitionBy(key).orderBy(order)
    plus = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.zip_with(a, b, lambda x, y: x + y))
    left = plus(F.lag(vector, 2).over(w), F.lag(vector, 1).over(w))
    right = plus(F.col(vector), F.lead(vector, 1).over(w))
    bonus = F.when(speaker, F.lit(0.05)).otherwise(F.lit(0.0)) if speaker is not None else F.lit(0.0)
    gaps = rows.withColumn("gap", (F.row_number().over(w) - 1).cast("int")).withColumn("similarity", cosine(left, right)).withColumn("bonus", bonus).where("gap > 0")
    g = Window.partitionBy(key).orderBy("gap")
    s = F.col("similarity")
    mean = (F.coalesce(F.lag(s).over(g), s) + s + F.coalesce(F.lead(s).over(g), s)) / 3
    gaps = gaps.withColumn("smooth", F.when(F.count("*").over(Window.partitionBy(key)) >= 3, mean).otherwise(s))
    high = lambda a, b: F.max("smooth").over(g.rowsBetween(a, b))
    depth = high(Window.unboundedPreceding, 0) + high(0, Window.unboundedFollowing) - F.col("smooth") * 2 + F.col("bonus")
    return gaps.withColumn("depth", depth)


def section_target(duration: Column, n: Column, mode: str = "academic") -> Column:
    per, low, high = MODES.get(mode, MODES["academic"])
    return F.greatest(F.lit(1), F.least(F.greatest(F.lit(low), F.least(F.lit(high), F.bround(duration / per, 0).cast("int"))), n))


def boundaries(gaps: DataFrame, key: str, mode: str = "academic") -> DataFrame:
    """(key, gap) of the chosen gaps: deepest first, far enough from each other and from both ends. gaps: key, gap, start, depth, duration, n."""
    held = gaps.withColumn("target", section_target(F.col("duration"), F.col("n"), mode))
    least = F.greatest(F.lit(45.0), F.col("duration") / (F.col("target") * 3))
    ranked = held.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("low"), "gap", "start"))).alias("all"),
        F.first("duration").alias("duration"),
        F.first("target").alias("target"),
        F.first("n").alias("n"),
        F.first(least).alias("least"),
    )
    none = F.array().cast("array<struct<gap:int,start:double>>")

    def take(chosen: Column, x: Column) -> Column:
        near = F.exists(chosen, lambda c: F.abs(c["start"] - x["start"]) < F.col("least"))
        fits = (F.size(chosen) < F.col("target") - 1) & ~near & (x["start"] >= F.col("least")) & (F.col("duration") - x["start"] >= F.col("least"))
        return F.when(fits, F.array_append(chosen, F.struct(x["gap"].alias("gap"), x["start"].alias("start")))).otherwise(chosen)

    picked = ranked.where("n > 3 AND target > 1").select(key, F.explode(F.aggregate("all", none, take)).alias("c"))
    return picked.select(key, "c.gap", "c.start")
