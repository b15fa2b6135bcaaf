"""Positions of rows in a global order, and samples by position."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolith.session import kept

#: Rows that a join may broadcast.
BROADCAST_ROWS = 100_000


def row_index(rows: DataFrame, *order: str | Column) -> DataFrame:
    """rows with index: 0, 1, ... in the given order (rows equal in it: in any order).

    One range partitioning, written once; the driver sees the number of rows of each partition only.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    spread = rows.withColumn("_tie", F.monotonically_increasing_id())
    spread = spread.repartitionByRange(*keys, F.col("_tie")).sortWithinPartitions(*keys, F.col("_tie")).drop("_tie")
    numbered = kept(spread.withColumn("_at", F.monotonically_increasing_id()), "index")
    part = F.shiftrightunsigned("_at", 33)
    before, so_far = [], 0
    for row in numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # a row a partition
        before.append((row["part"], so_far))
        so_far += row["n"]
    starts = rows.sparkSession.createDataFrame(before, "_part long, _before long")
    return numbered.join(F.broadcast(starts), part == F.col("_part")).withColumn("index", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")


def drawn(rows: DataFrame, positions: list[int], *order: str | Column) -> DataFrame:
    """The rows at these positions of the order, with place: their place in the list."""
    places = rows.sparkSession.createDataFrame(list(enumerate(positions)), "place long, index long")
    return row_index(rows, *order).join(F.broadcast(places) if len(positions) <= BROADCAST_ROWS else places, "index").drop("index")


def exact_sample(rows: DataFrame, n: int, *order: str | Column, seed: int = 42) -> DataFrame:
    """n rows without replacement and their place in the sample: the rows, in the order, that random.Random(seed).sample
    draws from a list of all.  All rows in their order if there are no more than n."""
    total = rows.count()
    positions = random.Random(seed).sample(range(total), n) if total > n else range(total)
    if total <= n:
        return row_index(rows, *order).withColumnRenamed("index", "place")
    return drawn(rows, positions, *order)
