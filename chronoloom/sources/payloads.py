"""Parsers of captured payloads: caption JSON, chapter markers, storyboards, video addresses, scripts in pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

VIDEO = r"(?:v=|youtu\.be/|/shorts/|/embed/|/live/)([A-Za-z0-9_-]{11})"
SEGMENTS = "array<struct<startMs:string,endMs:string,text:string>>"
EVENTS = "struct<events:array<struct<tStartMs:double,dDurationMs:double,segs:array<struct<utf8:string>>>>>"


def video_id(c: Column) -> Column:
    """A bare id, or the one in an address; else null."""
    t = F.trim(c)
    return F.when(t.rlike("^[A-Za-z0-9_-]{11}$"), t).otherwise(F.nullif(F.regexp_extract(t, VIDEO, 1), F.lit("")))


def segment_captions(payloads: DataFrame) -> DataFrame:
    """captions from (video_id, payload) with segments in milliseconds; blank and broken ones go."""
    s = payloads.select("video_id", F.posexplode(F.from_json("payload", SEGMENTS)).alias("pos", "s"))
    start, end = F.col("s.startMs").try_cast("double") / 1000, F.col("s.endMs").try_cast("double") / 1000
    return s.select("video_id", "pos", start.alias("start"), end.alias("end"), F.col("s.text").alias("text")).where("start IS NOT NULL AND trim(text) <> ''")


def event_captions(payloads: DataFrame) -> DataFrame:
    """captions from a caption track's events; the pieces of an event are joined."""
    e = payloads.select("video_id", F.posexplode(F.from_json("payload", EVENTS)["events"]).alias("pos", "e")).where("e.segs IS NOT NULL")
    text = X.squeeze(F.array_join(F.transform("e.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), ""))
    start = F.col("e.tStartMs") / 1000
    return e.select("video_id", "pos", start.alias("start"), (start + F.coalesce("e.dDurationMs", F.lit(0.0)) / 1000).alias("end"), text.alias("text")).where("text <> ''")


def chosen_track(tracks: DataFrame) -> DataFrame:
    """Of (video_id, track, lang, auto) the written English one, else any English one, else the first."""
    rank = F.when((F.col("lang") == "en") & ~F.col("auto"), 0).when(F.col("lang") == "en", 1).otherwise(2)
    return tracks.groupBy("video_id").agg(F.min_by(F.struct("track", "lang"), F.struct(rank, "track")).alias("t")).select("video_id", "t.track", "t.lang")


def best_source(sources: DataFrame, least: dict[str, int]) -> DataFrame:
    """Of (video_id, source, priority, entries) the first by priority that has enough entries."""
    enough = F.lit(False)
    for name, n in least.items():
        enough = enough | ((F.col("source") == name) & (F.col("entries") >= n))
    return sources.where(enough).groupBy("video_id").agg(F.min_by("source", "priority").alias("source"))


def chapter_markers(markers: DataFrame) -> DataFrame:
    """(video_id, start, title): the first of equal starts, in time order."""
    return markers.groupBy("video_id", "start").agg(F.min_by("title", "seq").alias("title"))


def storyboard(specs: DataFrame) -> DataFrame:
    """(video_id, level, width, height, count, cols, rows, interval) of a ``url|level|level`` spec with # between fields."""
    parts = specs.select("video_id", "duration", F.posexplode(F.slice(F.split("spec", r"\|"), 2, 99)).alias("level", "p")).withColumn("f", F.split("p", "#"))
    n = lambda k: F.get("f", F.lit(k)).try_cast("int")
    made = F.floor(F.col("duration") * 1000 / F.greatest(n(2), F.lit(1))).cast("int")
    interval = F.when(n(5) > 0, n(5)).otherwise(made)
    return parts.where(F.size("f") >= 6).select("video_id", "level", n(0).alias("width"), n(1).alias("height"), n(2).alias("count"), n(3).alias("cols"), n(4).alias("rows"), interval.alias("interval"))


def frame_place(seconds: Column, interval: Column, count: Column, cols: Column, rows: Column) -> Column:
    """(frame, sheet, row, col) of a moment in a storyboard."""
    frame = F.greatest(F.lit(0), F.least(F.floor(seconds * 1000 / interval).cast("int"), count - 1))
    cell = frame % (cols * rows)
    return F.struct(frame.alias("frame"), F.floor(frame / (cols * rows)).cast("int").alias("sheet"), F.floor(cell / cols).cast("int").alias("row"), (cell % cols).cast("int").alias("col"))


def first_json(c: Column) -> Column:
    """The first JSON value in a text: fenced, the whole, or the span from the first opening to the last closing bracket."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.trim(F.when(fenced != "", fenced).otherwise(c))
    span = F.regexp_extract(body, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.coalesce(F.try_parse_json(body), F.try_parse_json(span))


def latest(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """One row of each key, the last by order: what an upsert leaves."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order.desc()))).where("__n = 1").drop("__n")


def json_after(marker: str):
    """A column function: the first balanced JSON object after a marker in a page, mindful of strings and escapes."""

    def cut(page: str | None) -> str | None:
        at = page.find(marker) if page else -1
        at = page.find("{", at) if at >= 0 else -1
        depth, quoted, k = 0, False, at
        while 0 <= k < len(page or ""):
            c = page[k]
            if quoted:
                k += c == "\\"
                quoted = c != '"'
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if depth == 0:
                    return page[at : k + 1]
            k += 1
        return None

    @F.pandas_udf("string")
    def found(pages: pd.Series) -> pd.Series:
        return pages.map(cut)

    return found


def values_under(rows: DataFrame, key: str, json: str, name: str) -> DataFrame:
    """(key, place, value) of every value under a name in a JSON text, at any depth, depth first; values as JSON."""
    from ..session import ship

    ship(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()

    def walk(x):
        if isinstance(x, dict):
            for k, v in x.items():
                if k == name:
                    yield v
                yield from walk(v)
        elif isinstance(x, list):
            for v in x:
                yield from walk(v)

    def run(frames):
        import json as J

        for frame in frames:
            out = []
            for k, t in zip(frame[key], frame[json], strict=True):
                try:
                    tree = J.loads(t) if t else None
                except ValueError:
                    continue
                out += [(k, n, J.dumps(v, ensure_ascii=False)) for n, v in enumerate(walk(tree))]
            yield pd.DataFrame(out, columns=[key, "place", "value"])

    return rows.select(key, json).mapInPandas(run, f"{key} {kind}, place long, value string")
