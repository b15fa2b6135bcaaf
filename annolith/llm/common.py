"""Helpers shared by the corpus operators: shared scratch tables and byte-level text batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from annolith.session import kept

#: Bytes of text that one vectorised step handles (a longer document is one step by itself).
STEP_BYTES = 2_000_000
#: Bytes of rows that a Python worker gets at a time, unless the session sets BATCH_KEY itself.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4_000_000


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """df.mapInArrow in batches bounded by bytes: 10,000 rows of whole texts have no bound, in the worker as in the JVM beside it.

    The bound is a setting of the session, since a frame is planned only when it is run; one that is set already stays.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_KEY, None) is None:
        conf.set(BATCH_KEY, BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return the memory that a task has freed to the system: workers live on between tasks, beside the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def materialise(df: DataFrame, tag: str, few: bool = False) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors.

    few: a narrow table of an iteration; its last stage runs as at most four tasks a core of the cluster.
    """
    if few:
        df = df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)
    return kept(df, tag)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo folds."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % F.lit(folds)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --------------------------------------------------------------------------- byte batches


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, at, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most limit bytes together, or of one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def byte_class(kept: str) -> np.ndarray:
    """256 flags; kept: 'nonspace' (all but space and \\x09-\\x0D) or 'alnum' (ASCII letters, digits, non-ASCII)."""
    flags = np.ones(256, bool)
    if kept == "nonspace":
        flags[[0x20, *range(0x09, 0x0E)]] = False
    else:
        flags[:0x30] = flags[0x3A:0x41] = flags[0x5B:0x61] = flags[0x7B:0x80] = False
    return flags


def word_spans(data: np.ndarray, offsets: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each document (n + 1 numbers)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    mask = flags[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = mask[:-1]
    starts = np.flatnonzero(mask & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    ends = np.flatnonzero(mask & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_BASE, _pow = 0x9E3779B97F4A7C15 | 1, {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow.get("up", ())) < n:
        size = max(n, 1 << 19)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps_ = np.full(size, base, np.uint64)
            steps_[0] = 1
            _pow[key] = np.multiply.accumulate(steps_)
    return _pow["up"], _pow["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand."""
    _, down = _powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def ngram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word hashes, by its first word; callers drop runs across documents."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + len(out)]
    return mix(out)


def code_points(data: np.ndarray) -> np.ndarray:
    """1 for each byte that begins a code point, as prefix sums (n + 1 numbers)."""
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=sums[1:])
    return sums


def lowered(data: np.ndarray, latin: bool = False) -> np.ndarray:
    """A-Z lower-cased; with latin, U+00C0 to U+00DE as well (byte lengths stay)."""
    out = np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(0x20), data)
    if latin and len(out) > 1:
        second = np.zeros(len(out), bool)
        second[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out = np.where(second, out + np.uint8(0x20), out)
    return out
