"""A table of keyed groups of rows with versions: compare and set, conflicts, merging on top.

A commit writes the new rows of its keys beside the others and then puts a manifest in place, the one with the next number. Only one
writer can put that one in place: locally a link to a finished file, elsewhere a rename that does not replace (as HDFS has it). A writer that comes
second reads the manifest that won, judges its rows anew and tries again; what was changed meanwhile is then a conflict. Readers follow the
newest manifest, so they see whole commits. Every COMPACT commits the live rows are put together in one folder.

Manifests hold folder names only; versions of keys are columns of the rows, and no list of keys passes through the driver.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

#: Folders from which a commit puts the table together.
COMPACT = 16
VERSION = "__version"


@dataclass(frozen=True)
class Manifest:
    number: int
    folders: tuple[str, ...]


class Versioned:
    """Rows of ``schema``, grouped by ``key``; a group is replaced as a whole."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = spark.createDataFrame([], schema).schema
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        self.local = self.files.getScheme() == "file"

    # -- manifests

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _manifest_name(self, number: int) -> str:
        return f"_manifests/{number:012d}.json"

    def manifest(self) -> Manifest:
        """The newest one; numbers have no gaps, and old ones stay."""
        folder = self._path("_manifests")
        if not self.files.exists(folder):
            return Manifest(0, ())
        names = [s.getPath().getName() for s in self.files.listStatus(folder)]
        numbers = [int(n[:12]) for n in names if n.endswith(".json") and n[:12].isdigit()]
        if not numbers:
            return Manifest(0, ())
        text = "".join(r.value for r in self.spark.read.text(f"{self.path}/{self._manifest_name(max(numbers))}").collect())
        return Manifest(max(numbers), tuple(json.loads(text)["folders"]))

    def _put(self, made: Manifest) -> bool:
        """Whether the manifest is in place now; false where another one was there first."""
        self.files.mkdirs(self._path("_manifests"))
        name, draft = self._manifest_name(made.number), f"_manifests/.draft-{uuid.uuid4().hex}"
        out = self.files.create(self._path(draft), False)
        out.write(bytearray(json.dumps({"number": made.number, "folders": made.folders}).encode()))
        out.close()
        if not self.local:
            done = not self.files.exists(self._path(name)) and self.files.rename(self._path(draft), self._path(name))
        else:
            plain = self.path.removeprefix("file://").removeprefix("file:")
            try:
                os.link(f"{plain}/{draft}", f"{plain}/{name}")
                done = True
            except FileExistsError:
                done = False
        if self.files.exists(self._path(draft)):
            self.files.delete(self._path(draft), False)
        return done

    # -- reading

    def _rows(self, held: Manifest) -> DataFrame:
        schema = self.spark.createDataFrame([], self.schema).withColumn(VERSION, F.lit(0).cast("long")).schema
        if not held.folders:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in held.folders])
        newest = rows.groupBy(self.key).agg(F.max(VERSION).alias("__newest"))
        return rows.join(newest, self.key).where(F.col(VERSION) == F.col("__newest")).drop("__newest")

    def read(self, held: Manifest | None = None) -> DataFrame:
        return self._rows(held or self.manifest()).drop(VERSION)

    def versions(self, held: Manifest | None = None) -> DataFrame:
        """key, version."""
        return self._rows(held or self.manifest()).groupBy(self.key).agg(F.max(VERSION).alias("version"))

    # -- writing

    def replace(self, rows: DataFrame, bases: DataFrame, tries: int = 20) -> DataFrame:
        """Replace the groups of rows whose base (key, base) is their version by now, or null, which forces it. The result is key, accepted,
        version: the new version, or of a conflict the present one, whose rows ``read`` gives. bases names every key of rows."""
        rows, bases = cut(rows.select(self.schema.names)), cut(bases.select(self.key, F.col("base").cast("long")))
        for _ in range(tries):
            held = self.manifest()
            now = bases.join(self.versions(held), self.key, "left").withColumn("version", F.coalesce("version", F.lit(0)))
            judged = cut(now.withColumn("accepted", F.coalesce(F.col("base") == F.col("version"), F.lit(True))))
            taken = judged.where("accepted").select(self.key, (F.col("version") + 1).alias(VERSION))
            if taken.isEmpty() or self._commit(held, rows.join(taken, self.key)):
                return judged.select(self.key, "accepted", (F.col("version") + F.col("accepted").cast("long")).alias("version"))
        raise RuntimeError(f"{tries} other commits came first")

    def _commit(self, held: Manifest, new: DataFrame) -> bool:
        folder = f"data-{held.number + 1:012d}-{uuid.uuid4().hex}"
        columns = [*self.schema.names, VERSION]
        folders = (*held.folders, folder)
        if len(folders) > COMPACT:
            old = self._rows(held).join(new.select(self.key).distinct(), self.key, "left_anti")
            new, folders = old.select(columns).unionByName(new.select(columns)), (folder,)
        new.select(columns).write.parquet(f"{self.path}/{folder}")
        return self._put(Manifest(held.number + 1, folders))

    def merge(self, incoming: DataFrame, merged, tries: int = 20) -> DataFrame:
        """merged(present rows, incoming rows) of the incoming keys as their next version, whatever others commit meanwhile: where one comes first,
        the merge is made anew on top of it. The result is key, accepted (true), version."""
        incoming = cut(incoming)
        keys = cut(incoming.select(self.key).distinct())
        for _ in range(tries):
            held = self.manifest()
            present = self.read(held).join(keys, self.key, "left_semi")
            now = cut(keys.join(self.versions(held), self.key, "left").select(self.key, F.coalesce("version", F.lit(0)).alias("version")))
            made = merged(present, incoming).select(self.schema.names).join(now.select(self.key, (F.col("version") + 1).alias(VERSION)), self.key)
            if self._commit(held, made):
                return now.select(self.key, F.lit(True).alias("accepted"), (F.col("version") + 1).alias("version"))
        raise RuntimeError(f"{tries} other commits came first")
