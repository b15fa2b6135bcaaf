"""Merkle manifest of a dataset: a tree of digests over the rows of each source, and one over the sources.

A row's leaf is the digest of its fields.  Rows are ranked inside their source by one range
partitioning (narrow rows; a source may span any number of partitions), and meet in aligned blocks
of FANOUT ** LEVELS leaves.  A block is one row of a written table: the matrix of its leaves'
64-byte hex digests, contiguous, and the node that the block folds to.  Nodes of blocks are the
leaves of the next tier, until each source has one node; these are ranked by source and folded
alike.  Paths come down the same tiers: every entry of a block gets its siblings by index arithmetic
on the block's levels, followed by the path of the block's node.  The driver sees one row a
partition, and the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolith.llm.common import crc_fold, lower_ascii, map_arrow, materialise, utf8

FANOUT, LEVELS, DIGEST = 16, 3, 64
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: A fifth of the rows is tampered with.
TAMPERED = 5


def leaf(values: list[Column]) -> Column:
    """Digest of a row's fields: `-` for null, else the UTF-8 byte count, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with `run` (number of their group in the partition) and `local` (place in that run)."""
    run, local, last = 0, 0, None
    for batch in batches:
        groups = batch.column(0).to_pylist()
        runs, locals_ = np.zeros(len(groups), np.int64), np.zeros(len(groups), np.int64)
        for i, group in enumerate(groups):
            if last is not None and last[0] != group:
                run, local = run + 1, 0
            last = (group,)
            runs[i], locals_[i] = run, local
            local += 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs), pa.array(locals_)], names=[*batch.schema.names, "run", "local"])


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (grp first) with place: 0, 1, ... inside their grp, in ascending order (nulls first); equal rows in any order.

    One range partitioning and one pass; what earlier partitions hold of a partition's first group is added from one
    row a partition.
    """
    # The row number keeps apart rows that are equal in all else, so that no value is too frequent for one partition.
    marked = rows.withColumn("_at", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in ("grp", *order, "_at")]
    sorted_ = marked.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_at").withColumn("part", F.spark_partition_id())
    columns = ", ".join(f"{c} {t}" for c, t in sorted_.dtypes)
    numbered = materialise(map_arrow(sorted_, _numbered, f"{columns}, run long, local long"), "ranked")
    runs = numbered.groupBy("part", "run").agg(F.first("grp").alias("grp"), F.count("*").alias("n"))
    edges = runs.groupBy("part").agg(F.max("run").alias("last"), F.min_by("grp", "run").alias("first_grp"), F.max_by("grp", "run").alias("last_grp"), F.max_by("n", "run").alias("last_n")).orderBy("part").collect()
    offsets, open_group, so_far = [], None, 0
    for edge in edges:  # a row a partition
        carried = so_far if open_group == (edge["first_grp"],) else 0
        if carried:
            offsets.append((edge["part"], 0, carried))
        so_far = edge["last_n"] + (carried if edge["last"] == 0 else 0)
        open_group = (edge["last_grp"],)
    if not offsets:
        return numbered.withColumnRenamed("local", "place").drop("part", "run")
    before = F.broadcast(rows.sparkSession.createDataFrame(offsets, "part int, run long, before long"))
    return numbered.join(before, ["part", "run"], "left").withColumn("place", F.col("local") + F.coalesce("before", F.lit(0))).drop("part", "run", "local", "before")


# --------------------------------------------------------------------------- blocks


def fold(leaves: np.ndarray, fanout: int = FANOUT, levels: int | None = None) -> list[np.ndarray]:
    """Levels of digests (n x 64 bytes of hex) from the leaves up: to one node, or exactly `levels` times."""
    found = [leaves]
    while len(found[-1]) > 1 if levels is None else len(found) <= levels:
        at = found[-1]
        full = len(at) // fanout
        digests = [hashlib.sha256(row).hexdigest() for row in at[: full * fanout].reshape(full, fanout * DIGEST)]
        if full * fanout < len(at):
            digests.append(hashlib.sha256(at[full * fanout :].reshape(-1)).hexdigest())
        found.append(np.frombuffer("".join(digests).encode(), np.uint8).reshape(-1, DIGEST))
    return found


def siblings(levels: list[np.ndarray], fanout: int = FANOUT) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level below the top, of every leaf: bytes of its node's siblings, how many stand left of it, how many there are."""
    out, index = [], np.arange(len(levels[0]))
    for at in levels[:-1]:
        own, start = index % fanout, index - index % fanout
        others = np.arange(fanout - 1)
        where = start[:, None] + others + (others >= own[:, None])
        count = np.minimum(fanout, len(at) - start) - 1
        out.append((at[np.minimum(where, len(at) - 1)].reshape(len(index), -1), own, count))
        index = index // fanout
    return out


def _tree(block: int, leaves: np.ndarray, levels: int) -> list[np.ndarray]:
    """A group's only block folds to one node, other blocks to their place in the aligned tree."""
    return fold(leaves, FANOUT, None if block == 0 and len(leaves) < FANOUT**levels else levels)


BLOCK = "grp string, block long, whole boolean, node string, leaves binary, ids array<long>, changed binary"


def _blocks(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by grp and place (grp, place, leaf, id, other) to a row a block."""
    waiting: list[pa.RecordBatch] = []
    span = FANOUT**levels

    def made(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        whole = rows.combine_chunks().to_batches()[0]
        digests, other = (utf8(whole.column(c))[0].reshape(-1, DIGEST) for c in (2, 4))
        places, groups, ids = whole.column(1).to_numpy(), whole.column(0), whole.column(3)
        out: list[list] = [[] for _ in range(7)]
        for a, b in zip(starts, [*starts[1:], len(places)], strict=True):
            block = int(places[a]) // span
            top = _tree(block, digests[a:b], levels)[-1]
            entry = (groups[a].as_py(), block, block == 0 and b - a < span, top.tobytes().decode(), digests[a:b].tobytes(), ids[a:b].to_pylist(), other[a:b].tobytes())
            for column, value in zip(out, entry, strict=True):
                column.append(value)
        types = [pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["grp", "block", "whole", "node", "leaves", "ids", "changed"])

    for batch in batches:
        heads = np.flatnonzero(batch.column(1).to_numpy() % span == 0)
        # A block ends where the next begins: what came before the last head is complete.
        if len(heads) and (waiting or heads[-1] > 0):
            rows = pa.Table.from_batches([*waiting, batch.slice(0, heads[-1])])
            if rows.num_rows:
                yield made(rows, np.flatnonzero(rows.column(1).to_numpy() % span == 0))
            waiting = [batch.slice(heads[-1])]
        elif batch.num_rows:
            waiting.append(batch)
    if waiting:
        rows = pa.Table.from_batches(waiting)
        yield made(rows, np.flatnonzero(rows.column(1).to_numpy() % span == 0))


def blocks(rows: DataFrame, levels: int) -> DataFrame:
    """rows (grp, place, leaf, id, other) as aligned blocks of FANOUT ** levels entries."""
    dealt = rows.select("grp", "place", "leaf", "id", "other").repartition("grp", F.floor(F.col("place") / F.lit(FANOUT**levels)))
    return materialise(map_arrow(dealt.sortWithinPartitions(F.col("grp").asc_nulls_first(), "place"), lambda it: _blocks(it, levels), BLOCK), "blocks")


def forest(rows: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Tiers of blocks over rows, from the leaves up, and the one node (grp, node) of each group."""
    tiers, tops = [], None
    while True:
        tier = blocks(rows, levels)
        rest = tier.filter("not whole")
        single = not rest.filter("block > 0").limit(1).count()
        found = tier.select("grp", "node") if single else tier.filter("whole").select("grp", "node")
        tops = found if tops is None else tops.union(found)
        tiers.append(tier)
        if single:
            return tiers, tops
        rows = rest.select("grp", F.col("block").alias("place"), F.col("node").alias("leaf"), F.lit(None).cast("long").alias("id"), F.col("node").alias("other"))


STEP = "array<struct<left: binary, right: binary>>"


def _paths(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    """Blocks with the path of their node to a row an entry, with the entry's path."""
    for batch in batches:
        for row in batch.to_pylist():
            tree = _tree(row["block"], np.frombuffer(row["leaves"], np.uint8).reshape(-1, DIGEST), levels)
            own = siblings(tree)
            for a in range(0, len(tree[0]), 256):
                paths = []
                for i in range(a, min(a + 256, len(tree[0]))):
                    steps = [{"left": s[i, : left[i] * DIGEST].tobytes(), "right": s[i, left[i] * DIGEST : n[i] * DIGEST].tobytes()} for s, left, n in own]
                    paths.append(steps + row["path"])
                place = pa.array(np.arange(a, a + len(paths)) + row["block"] * FANOUT**levels)
                kinds = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))
                yield pa.RecordBatch.from_arrays([pa.array([row["grp"]] * len(paths), pa.string()), place, pa.array([row["top"]] * len(paths), pa.string()), pa.array(paths, kinds)], names=["grp", "place", "top", "path"])


def with_paths(tiers: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """The lowest tier's blocks with top (node of their group) and path of their node; tops: grp, top, path."""
    below = None
    for at in reversed(range(len(tiers))):
        tier, own = tiers[at], tops.withColumnRenamed("grp", "_grp")
        final = tier if at == len(tiers) - 1 else tier.filter("whole")
        out = final.join(own, F.col("grp").eqNullSafe(F.col("_grp"))).drop("_grp")
        if below is not None:
            path = below.withColumnRenamed("grp", "_grp")
            inner = tier.filter("not whole").join(path, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("block") == F.col("place"))).drop("_grp", "place")
            out = out.unionByName(inner)
        if at == 0:
            return out
        below = materialise(map_arrow(out, lambda it: _paths(it, levels), f"grp string, place long, top string, path {STEP}"), "paths")
    raise AssertionError("no tiers")


def _proved(batches: Iterator[pa.RecordBatch], root: str, levels: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    for batch in batches:
        for row in batch.to_pylist():
            tree = _tree(row["block"], np.frombuffer(row["leaves"], np.uint8).reshape(-1, DIGEST), levels)
            changed = np.frombuffer(row["changed"], np.uint8).reshape(-1, DIGEST)
            own = siblings(tree)
            rest = [(step["left"], step["right"]) for step in row["path"]]
            tail = b"".join(left + right for left, right in rest)
            proofs, folded = [], []
            for i in range(len(changed)):
                proof, node = hashlib.sha256(), changed[i].tobytes()
                for s, left, n in own:
                    cut, end = left[i] * DIGEST, n[i] * DIGEST
                    proof.update(s[i, :end])
                    node = hashlib.sha256(s[i, :cut].tobytes() + node + s[i, cut:end].tobytes()).hexdigest().encode()
                proof.update(tail)
                for left, right in rest:
                    node = hashlib.sha256(left + node + right).hexdigest().encode()
                proofs.append(proof.hexdigest())
                folded.append(node.decode())
            n = len(changed)
            leaves = [x.tobytes().decode() for x in tree[0]]
            columns = [pa.array(row["ids"], pa.int64()), pa.array(leaves), pa.array([row["top"]] * n), pa.array([root] * n), pa.array(proofs), pa.array(folded), pa.array([x == root for x in folded])]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def manifest(docs: DataFrame, fields: list[str] = FIELDS, tamper: int = TAMPERED, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row.

    Leaves ascend by doc_id inside a source (null ids first, equal ids by leaf), sources bytewise (null first).  Rows whose
    id's crc32 is divisible by tamper have the A-Z of their text lower-cased before they are folded again; rows with null
    text or id stay as they are, as do texts without capitals, which so verify.  Repeated rows are leaves of their own;
    extra columns do not count; an empty table gives no rows.
    """
    values = {"doc_id": F.col("doc_id").cast("long"), "n_chars": F.col("n_chars").cast("long")}
    own = [values.get(c, F.col(c)) for c in fields]
    low = [lower_ascii(v.cast("string")) if c == "text" else v for c, v in zip(fields, own, strict=True)]
    chosen = F.coalesce(crc_fold(values["doc_id"], tamper) == 0, F.lit(False))
    rows = materialise(docs.select(F.col("source").cast("string").alias("grp"), values["doc_id"].alias("id"), leaf(own).alias("leaf"), F.when(chosen, leaf(low)).alias("low")), "leaves")
    rows = rows.select("grp", "id", "leaf", F.coalesce("low", "leaf").alias("other"))
    tiers, subroots = forest(ranked(rows, ["id", "leaf"]), levels)
    sources = ranked(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("node").alias("leaf")), ["name"])
    upper, top = forest(sources.select("grp", "place", "leaf", F.lit(None).cast("long").alias("id"), F.col("leaf").alias("other")), levels)
    root = top.select("node").collect()  # one row, or none
    root = root[0]["node"] if root else ""
    ends = top.select("grp", F.col("node").alias("top"), F.array().cast(STEP).alias("path"))
    paths = map_arrow(with_paths(upper, ends, levels), lambda it: _paths(it, levels), f"grp string, place long, top string, path {STEP}").select("place", "path")
    paths = sources.join(paths, "place").select(F.col("name").alias("grp"), F.col("leaf").alias("top"), "path")
    proved = with_paths(tiers, materialise(paths, "paths"), levels)
    return map_arrow(proved, lambda it: _proved(it, root, levels), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
