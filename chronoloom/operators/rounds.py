"""Work on the units of videos in rounds that spread over each video, kept round by round, so that it ends early or starts again.

The plan deals every unit that needs the provider to a round, in stride order: the first rounds cover a whole video thinly. A round is a
folder that is whole once its writer has committed it; one that was broken off is written anew, and none that is whole is done again. How many
rounds a coverage takes follows from counts, so nothing is gathered to find out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import timeline as T
from .providers import BATCH, Provider, provided

KEYS = ["video_id", "pos"]


class Rounds:
    """A task on units (video_id, pos, text, lang) in the folder ``path``, which executors must share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _whole(self, name: str) -> bool:
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def plan(self, units: DataFrame, size: int = BATCH) -> None:
        """Write the plan, unless there is one: ``size`` units of every video a round. English and blank units need no provider.

        A null language is one of its own; units with a null video or position are left out; a video's positions differ.
        """
        if self._whole("plan"):
            return
        held = units.where(F.col("video_id").isNotNull() & F.col("pos").isNotNull())
        needs = (F.coalesce("lang", F.lit("")) != "en") & (F.trim(F.coalesce("text", F.lit(""))) != "")
        order = Window.partitionBy("video_id", "needs").orderBy(T.stride_rank(F.col("pos")), "pos")
        turn = F.when(F.col("needs"), F.floor((F.row_number().over(order) - 1) / size))
        made = held.select(*KEYS, "text", "lang", needs.alias("needs")).withColumn("round", turn).drop("needs")
        made.withColumn("part", F.coalesce("round", F.lit(-1))).write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/plan")

    def planned(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/plan").drop("part")

    def wanted(self, least: float) -> int:
        """Rounds after which every video is covered so far."""
        per = self.planned().groupBy("video_id").agg(F.count("*").alias("units"), F.count("round").alias("todo"), F.max("round").alias("last"))
        sizes = self.planned().where("round IS NOT NULL").groupBy("video_id", "round").agg(F.count("*").alias("n")).groupBy("video_id").agg(F.max("n").alias("size"))
        short = F.least(F.col("todo"), F.ceil(F.lit(least) * F.col("units") - F.lit(1e-9)) - (F.col("units") - F.col("todo")))
        return per.join(sizes, "video_id").agg(F.max(F.ceil(F.greatest(short, F.lit(0)) / F.col("size")))).first()[0] or 0

    def advance(self, provider: Provider, least: float = 1.0) -> int:
        """Do the rounds that are not done, up to the coverage ``least``; how many were done now. What the provider raises ends it, and
        the rounds before are kept."""
        done, schema = 0, self.planned().schema
        for number in range(self.wanted(least)):
            name = f"rounds/{number}"
            if self._whole(name):
                continue
            units = self.spark.read.schema(schema).parquet(f"{self.path}/plan/part={number}")
            provided(units, provider).select(*KEYS, "translated").write.mode("overwrite").parquet(f"{self.path}/{name}")
            done += 1
        return done

    def units(self) -> DataFrame:
        """video_id, pos, text, lang, round, translated: units that are done or need nothing; the others are left out."""
        plan, last = self.planned(), self.wanted(1.0)
        whole = [f"{self.path}/rounds/{k}" for k in range(last) if self._whole(f"rounds/{k}")]
        as_is = plan.where("round IS NULL").withColumn("translated", F.col("text"))
        return as_is.unionByName(plan.join(self.spark.read.parquet(*whole), KEYS)) if whole else as_is

    def coverage(self) -> DataFrame:
        """video_id, coverage: the share of a video's units that are done or need nothing."""
        have = self.units().groupBy("video_id").agg(F.count("*").alias("have"))
        every = self.planned().groupBy("video_id").agg(F.count("*").alias("n"))
        return every.join(have, "video_id", "left").select("video_id", (F.coalesce("have", F.lit(0)) / F.col("n")).alias("coverage"))
