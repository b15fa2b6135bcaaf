"""A table as numbered versions in one folder, rewritten step by step.

    ROOT/v00000000/_bucket=K/...   rows of version 0, the backup: never written again
    ROOT/v00000001/_bucket=K/...   a later version
    ROOT/_log/00000001.json        version 1 counts (its folder, base and numbers of rows)
    ROOT/_log/00000001.00003       bucket 3 of version 1 is flushed

A version is there when its log entry is.  A rewrite works bucket by bucket and logs each one as it is flushed; a run that was
killed is taken up after its last flushed bucket.  Nothing is written where it is read, and readers see whole versions only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from annolith.session import scratch_path

BUCKET = "_bucket"


@dataclass
class Rewrite:
    """What a rewrite did or, for a dry run, would do."""

    version: int
    rows: int
    changed: int
    steps_done: int
    steps_found: int
    dry_run: bool


class CommitLog:
    """Small named entries in a folder; each is written once."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.path = spark, f"{root.rstrip('/')}/_log"

    def _files(self):  # noqa: ANN202
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(self.path)
        return hadoop, path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def names(self) -> list[str]:
        _, files, path = self._files()
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    def add(self, name: str, entry: dict) -> None:
        """A new entry; raises if it is there already."""
        hadoop, files, path = self._files()
        stream = files.create(hadoop.Path(path, name), False)
        try:
            stream.write(bytearray(json.dumps(entry).encode()))
        finally:
            stream.close()

    def read(self, names: list[str]) -> dict[str, dict]:
        """Entries by name; one that its writer did not finish does not count."""
        if not names:
            return {}
        lines = self.spark.read.text([f"{self.path}/{n}" for n in names], wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("n"), "value").collect()  # a row an entry
        found = {}
        for row in lines:
            try:
                found[row["n"]] = json.loads(row["value"])
            except ValueError:
                continue
        return found


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = 16) -> None:
        """key: the column that names a row; buckets: steps of a rewrite, so many for all versions."""
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self.log = CommitLog(spark, self.root)

    def entries(self) -> dict[int, dict]:
        """Committed versions by number."""
        names = [n for n in self.log.names() if n.endswith(".json")]
        return {int(n.removesuffix(".json")): entry for n, entry in self.log.read(names).items()}

    def latest(self) -> int:
        return max(self.entries(), default=-1)

    def _folder(self, version: int) -> str:
        return f"{self.root}/v{version:08d}"

    def create(self, rows: DataFrame) -> None:
        """Version 0, from which restore() can always return."""
        if self.latest() >= 0:
            raise ValueError(f"{self.root} has versions already")
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        rows.withColumn(BUCKET, bucket).write.mode("overwrite").partitionBy(BUCKET).parquet(self._folder(0))
        self.log.add("00000000.json", {"folder": self._folder(0), "base": None, "schema": rows.schema.json()})

    def _rows(self, entry: dict) -> DataFrame:
        schema = StructType.fromJson(json.loads(entry["schema"])).add(BUCKET, IntegerType())
        return self.spark.read.schema(schema).parquet(entry["folder"])

    def read(self, version: int | None = None) -> DataFrame:
        found = self.entries()
        return self._rows(found[max(found) if version is None else version]).drop(BUCKET)

    def restore(self, version: int = 0) -> int:
        """A new version with an old one's rows; none are copied."""
        found = self.entries()
        number = max(found) + 1
        self.log.add(f"{number:08d}.json", {**found[version], "base": version})
        return number

    def _changed(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """Rows of new that old does not have like this."""
        shared = [c for c in new.columns if c in old.columns and c != BUCKET]
        added = [c for c in new.columns if c not in old.columns and c != BUCKET]
        mark = lambda df, more: df.select(F.col(self.key).alias("_key"), F.xxhash64(*(F.col(c).cast("string") for c in shared)).alias("_hash"), *more)
        filled = F.lit(False)
        for c in added:
            filled = filled | F.col(c).isNotNull()
        same = (F.col("n._key").eqNullSafe(F.col("o._key"))) & (F.col("n._hash") == F.col("o._hash")) & ~F.col("n._filled")
        return mark(new, [filled.alias("_filled")]).alias("n").join(mark(old, []).alias("o"), same, "left_anti")

    def rewrite(self, update: Callable[[DataFrame], DataFrame], dry_run: bool = False) -> Rewrite:
        """The next version, update(rows) of the latest one, bucket by bucket.

        update keeps the key and maps rows one by one or by key, so that a bucket can be done by itself.  A dry run reads and
        counts only.  An interrupted rewrite is continued by calling this again with the same update.
        """
        found = self.entries()
        base, number = max(found), max(found) + 1
        old = self._rows(found[base])
        if dry_run:
            new = update(old.drop(BUCKET))
            return Rewrite(number, new.count(), self._changed(old, new).count(), 0, 0, True)
        flushed = {n for n in self.log.names() if n.startswith(f"{number:08d}.") and not n.endswith(".json")}
        done = 0
        for k in range(self.buckets):
            name = f"{number:08d}.{k:05d}"
            if name not in flushed:
                part = update(old.filter(F.col(BUCKET) == k).drop(BUCKET))
                part.write.mode("overwrite").parquet(f"{self._folder(number)}/{BUCKET}={k}")
                self.log.add(name, {"schema": part.schema.json()})
                done += 1
        first = f"{number:08d}.00000"
        entry = {"folder": self._folder(number), "base": base, "schema": self.log.read([first])[first]["schema"]}
        new = self._rows(entry)
        rows, changed = new.count(), self._changed(old, new).count()
        self.log.add(f"{number:08d}.json", {**entry, "rows": rows, "changed": changed})
        return Rewrite(number, rows, changed, done, len(flushed), False)

    def history(self) -> list[dict]:
        return [{"version": n, **{k: v for k, v in e.items() if k != "schema"}} for n, e in sorted(self.entries().items())]



class WorkLog:
    """Results of long work over rows, bucket by bucket: what is flushed is there after a crash, and is not done again.

    ROOT/data/RUN-K: results of a bucket; ROOT/_log/RUN-K: that it is flushed.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = 16) -> None:
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self.log = CommitLog(spark, self.root)

    def results(self) -> DataFrame | None:
        """What is flushed so far, or None."""
        entries = self.log.read(self.log.names())
        if not entries:
            return None
        schema = StructType.fromJson(json.loads(next(iter(entries.values()))["schema"]))
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/data/{n}" for n in sorted(entries)))

    def run(self, rows: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Results of all rows: work(rows) for the keys without any, flushed bucket by bucket.  work keeps the key."""
        done = self.results()
        pending = rows if done is None else rows.join(done.select(self.key).distinct(), self.key, "left_anti")
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        # Dealt out once, so that a bucket reads its own rows only.
        dealt = scratch_path(self.spark, "pending")
        pending.withColumn(BUCKET, bucket).write.partitionBy(BUCKET).parquet(dealt)
        schema = StructType(pending.schema.fields).add(BUCKET, IntegerType())
        own, run = self.spark.read.schema(schema).parquet(dealt), uuid.uuid4().hex
        for row in own.select(BUCKET).distinct().orderBy(BUCKET).collect():  # a row a bucket
            name = f"{run}-{row[BUCKET]:05d}"
            part = work(own.filter(F.col(BUCKET) == row[BUCKET]).drop(BUCKET))
            part.write.parquet(f"{self.root}/data/{name}")
            self.log.add(name, {"schema": part.schema.json()})
        found = self.results()
        return work(rows.limit(0)) if found is None else found
