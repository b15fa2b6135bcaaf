"""Deleting files that nothing names any more, and the folders that are left empty."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolith.session import kept, many_files, spread


#: Kinds of file system that tasks list by themselves, through pyarrow.
_LISTED = ("file", "hdfs", "s3", "gs", "gcs")
#: Entries that a listing task hands over at a time.
_SOME = 20_000


def listed(spark: SparkSession, root: str) -> DataFrame:
    """path (URI) and relative of every file below root; contents are not read, hidden files are left out, as by Spark's readers.

    Tasks list the folders, level by level, so that the driver never holds the listing; a folder is listed by one task, which
    streams it.  On file systems that only Spark reaches, Spark's own listing is taken.
    """
    base = _qualified(spark, root).rstrip("/")
    relative = F.substr("path", F.lit(len(base) + 2)).alias("relative")
    if base.partition(":")[0] not in _LISTED:
        many_files(spark)
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", relative)
    out, folders = None, spark.createDataFrame([(base,)], "path string")
    while True:  # a step a level of the tree
        found = kept(folders.mapInPandas(_listing, "path string, folder boolean"), "level")
        files = found.filter("not folder").select("path", relative)
        out = files if out is None else out.union(files)
        folders = spread(found.filter("folder").select("path"), "path")
        if found.filter("folder").isEmpty():
            return out


def _qualified(spark: SparkSession, root: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _filesystem(uri: str):  # noqa: ANN202
    from pyarrow import fs

    local = re.sub("^file:/*", "/", uri)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(uri)


def _entries(uri: str) -> Iterator[tuple[str, bool]]:
    """Name of each entry of a folder, and whether it is a folder."""
    from pyarrow import fs

    files, path = _filesystem(uri)
    if isinstance(files, fs.LocalFileSystem):
        with os.scandir(path) as found:
            for entry in found:
                yield entry.name, entry.is_dir()
    else:
        for info in files.get_file_info(fs.FileSelector(path)):
            yield info.base_name, info.type == fs.FileType.Directory


def _hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _listing(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for uri in part["path"]:
            shown = ((f"{uri}/{name}", folder) for name, folder in _entries(uri) if not _hidden(name))
            while some := list(islice(shown, _SOME)):
                yield pd.DataFrame(some, columns=["path", "folder"])


def _deleted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        status = []
        for uri in part["path"]:
            try:
                files, path = _filesystem(uri)
                files.delete_file(path)
                status.append("deleted")
            except FileNotFoundError:
                status.append("deleted")  # by an earlier attempt of this task
            except OSError as problem:
                status.append(f"failed: {problem}"[:200])
        yield part.assign(status=status)


def _emptied(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Folders without entries go."""
    from pyarrow import fs

    for part in parts:
        gone = []
        for uri in part["folder"]:
            files, path = _filesystem(uri)
            try:
                empty = not files.get_file_info(fs.FileSelector(path))
                if empty:
                    files.delete_dir(path)
                gone.append(empty)
            except (FileNotFoundError, NotADirectoryError):
                gone.append(True)
        yield part.assign(gone=gone)


def prune(spark: SparkSession, root: str, used: DataFrame, dry_run: bool = False) -> DataFrame:
    """relative and status (deleted, would_delete, failed: ...) of each file below root that used (relative) does not name.

    The list is made, and written, before anything is deleted; tasks delete their own part of it.  Then folders that
    held such files, or stand above them, are removed from the deepest up where nothing is left in them.  A second run deletes nothing.
    """
    files = kept(listed(spark, root), "listing")
    rest = files.join(used.select("relative").distinct(), "relative", "left_anti").select("path", "relative")
    if dry_run:
        return rest.select("relative", F.lit("would_delete").alias("status"))
    done = kept(spread(rest, "relative").mapInPandas(_deleted, "path string, relative string, status string"), "pruned")
    steps = F.split("relative", "/")
    inside = done.filter(F.col("status") == "deleted").select(F.slice(steps, F.lit(1), F.size(steps) - 1).alias("steps")).filter(F.size("steps") > 0)
    above = inside.select("steps", F.explode(F.sequence(F.lit(1), F.size("steps"))).alias("depth"))
    folder = F.concat(F.lit(root.rstrip("/") + "/"), F.array_join(F.slice("steps", F.lit(1), F.col("depth")), "/"))
    folders = kept(above.select(folder.alias("folder"), "depth").distinct(), "folders")
    for level in range(folders.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("d")).first()["d"], 0, -1):  # a step a level of the tree
        folders.filter(F.col("depth") == level).select("folder").mapInPandas(_emptied, "folder string, gone boolean").write.format("noop").mode("overwrite").save()
    return done.select("relative", "status")
