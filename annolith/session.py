"""Tables kept between the steps of a run, in the shared folder that spark.checkpoint.dir names."""

from __future__ import annotations

import atexit
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: What opening a file counts for, in bytes, when files are packed into tasks.
OPEN_KEY, OPEN_BYTES = "spark.sql.files.openCostInBytes", 1 << 16

_written: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only where that is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="annolith-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the scratch folder; what is written there goes with the scratch tables."""
    path = f"{scratch_root(spark)}/annolith/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write df once and read it back: later steps neither compute it again nor carry its plan."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def many_files(spark: SparkSession) -> None:
    """Small files are packed by the thousand into a task, not by 32, unless the session says what a file's opening costs.

    A setting of the session, since a frame is planned only when it is run.
    """
    if spark.conf.get(OPEN_KEY, None) is None:
        spark.conf.set(OPEN_KEY, OPEN_BYTES)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by key over all cores: a small file is one row group or a few, whatever is made of each of its rows."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def _delete(since: int) -> None:
    while len(_written) > since:
        spark, path = _written.pop()
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes at its end the scratch tables written inside; frames that read them must have been written or collected by then."""
    since = len(_written)
    try:
        yield
    finally:
        _delete(since)


@contextmanager
def progress(spark: SparkSession, say: Callable[[str], None] = print, every: float = 5.0) -> Iterator[None]:
    """Says now and then, while what stands inside runs, how many tasks of the active stages are done, and how many a second."""
    tracker, over, began = spark.sparkContext.statusTracker(), threading.Event(), time.monotonic()
    seen: dict[int, int] = {}

    def watch() -> None:
        while not over.wait(every):
            total = 0
            for stage in tracker.getActiveStageIds():
                info = tracker.getStageInfo(stage)
                if info is not None:
                    seen[stage] = info.numCompletedTasks
                    total += info.numTasks
            spent = time.monotonic() - began
            say(f"{sum(seen.values())} tasks done, {total} in active stages, {sum(seen.values()) / spent:.1f} a second, {spent:.0f} s")

    thread = threading.Thread(target=watch, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()


@atexit.register
def _forget() -> None:
    """Remove what is left at the end of the driver, if its session still lives."""
    try:
        _delete(0)
    except Exception:  # noqa: BLE001 - the session may be gone already
        return
