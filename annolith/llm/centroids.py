"""Centroid clustering of vectors with Hamerly's bounds, in exact integers.

Components are integers floor(64 * x), so that distances, sums and ties are exact and do not
depend on how the vectors are dealt out.  The state of a round is a written table: each vector
with its cluster, one upper bound of the distance to its own centroid and one lower bound of
the distance to the second-nearest.  When centroids move, the upper bound grows by the own
centroid's drift and the lower one shrinks by the largest drift of another.  A vector whose upper
bound stays below the lower one, or below half the distance from its centroid to the next,
keeps its cluster without a scan; the others are measured to their own centroid first, and to
all of them if that does not settle it.  Bounds are floats, compared with a margin far above
their error; whatever lies inside the margin (ties too) is decided by the integer scan.

Rounds exchange the centroids and their sums only: k rows, added up per task before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolith.llm.common import map_arrow, materialise

WIDTH, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
#: Integer components are clamped to this size, so that every squared distance fits 64 bits.
LARGEST = 1 << 27
#: Relative and absolute margin of bounds.
MARGIN = 1e-9
STATE = "vec_id long, x array<int>, cluster int, upper double, lower double, scans int"


def integers(vectors: DataFrame, column: str = "embedding", width: int = WIDTH) -> DataFrame:
    """(vec_id, x) of the vectors with exactly width components, none null or non-finite; x holds floor(64 * component)."""
    raw = F.col(column).cast("array<double>")
    finite = F.forall(raw, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    x = F.transform(raw, lambda v: F.greatest(F.least(F.floor(v * SCALE), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    return vectors.filter(F.coalesce((F.size(raw) == width) & finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def first_centroids(rows: DataFrame, clusters: int = CLUSTERS) -> np.ndarray:
    """The vectors with the smallest sha256 of `1:<vec_id>`; null ids come last, equal ids by their components."""
    hashed = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    top = rows.orderBy(hashed.asc_nulls_last(), "x").limit(clusters).select("x").collect()
    return np.array([r["x"] for r in top], np.int64)


def squared(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to one centroid, or to a centroid each."""
    away = x - to
    return np.einsum("ij,ij->i", away, away)


def scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number), its squared distance and that of the second-nearest."""
    best, first, second = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), np.iinfo(np.int64).max)
    for j, centroid in enumerate(centroids):
        d = squared(x, centroid)
        nearer = d < first
        second = np.where(nearer, first, np.minimum(second, d))
        best[nearer], first = j, np.where(nearer, d, first)
    return best, first, second


def assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, scans: np.ndarray, centroids: np.ndarray, before: np.ndarray | None) -> None:
    """One assignment in place; before: the centroids that the bounds belong to, None when there are no bounds yet."""
    k = len(centroids)
    unsure = np.arange(len(x))
    if before is not None:
        drift = np.sqrt(squared(centroids, before).astype(float))
        others = np.array([max([0.0, *np.delete(drift, j)]) for j in range(k)])
        gaps = np.array([[np.sqrt(float(squared(a[None], b)[0])) for b in centroids] for a in centroids])
        np.fill_diagonal(gaps, np.inf)
        upper += drift[cluster]
        lower -= others[cluster]
        enough = np.maximum(lower, gaps.min(1)[cluster] / 2) * (1 - MARGIN)
        unsure = np.flatnonzero(~(upper * (1 + MARGIN) + MARGIN < enough))
        upper[unsure] = np.sqrt(squared(x[unsure], centroids[cluster[unsure]]).astype(float))
        unsure = unsure[~(upper[unsure] * (1 + MARGIN) + MARGIN < enough[unsure])]
    best, first, second = scan(x[unsure], centroids)
    cluster[unsure], upper[unsure] = best, np.sqrt(first.astype(float))
    lower[unsure] = np.sqrt(second.astype(float)) if k > 1 else np.inf
    scans[unsure] += 1


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.int64) if len(column) else np.zeros((0, 0), np.int64)


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, before: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(1))
            state = [batch.column(c).to_numpy(zero_copy_only=False).copy() for c in range(2, 6)]
            state[0] = state[0].astype(np.int64)
            assign(x, *state, centroids, before)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(state[0].astype(np.int32)), *(pa.array(s) for s in state[1:])], names=["vec_id", "x", "cluster", "upper", "lower", "scans"])


def _measured(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, cluster = _matrix(batch.column(1)), batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(5), pa.array(squared(x, centroids[cluster]))], names=["vec_id", "cluster", "scans", "distance"])


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each cluster's vectors; a cluster without vectors keeps its centroid."""
    sums = [F.sum(F.col("x")[i].cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])]
    moved = centroids.copy()
    for row in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # a row a cluster
        moved[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(centroids.shape[1])]
    return moved


def cluster(vectors: DataFrame, column: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and scans (full scans it took) of each vector of
    exactly width finite components.

    Other rows (null, short or long vectors, null or non-finite components) are left out.  Repeated rows count as often as
    they stand; null ids are clustered like others.  Components beyond LARGEST / 64 count as that; an inertia beyond
    64 bits is null.  With fewer vectors than clusters there are fewer clusters; without vectors there are no rows.
    """
    rows = materialise(integers(vectors, column, width), "vectors")
    centroids, before = first_centroids(rows, clusters), None
    fresh = {"cluster": F.lit(0), "upper": F.lit(0.0), "lower": F.lit(0.0), "scans": F.lit(0)}
    state = rows.withColumns(fresh)
    for at in range(rounds + 1 if len(centroids) else 0):
        state = map_arrow(state, lambda it, c=centroids, b=before: _assigned(it, c, b), STATE)
        if at < rounds:
            state = materialise(state, "bounds")
            before, centroids = centroids, means(state, centroids)
    if not len(centroids):
        return rows.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"), ("scans", "int"))))
    out = materialise(map_arrow(state, lambda it: _measured(it, centroids), "vec_id long, cluster int, scans int, distance long"), "clusters")
    sums = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a cluster
    fits = lambda n: F.lit(n if n < 1 << 63 else None).cast("long")
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    of = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    return out.select(
        "vec_id",
        "cluster",
        "distance",
        of([fits(sums.get(j, 0)) for j in range(len(centroids))]).alias("cluster_inertia"),
        fits(sum(sums.values())).alias("inertia"),
        of([F.lit(d) for d in digests]).alias("centroid_sha256"),
        "scans",
    )
