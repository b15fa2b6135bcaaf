"""Streaming forms of the batch operators, where their state is bounded by keys and not by rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from annolith.operators.metrics import confusion


def confusion_counts(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Running confusion counts of a stream of evaluation rows (gt, pred and keys), for output modes update and complete.

    The state is one row a label pair of each key; metrics follow from it as from a batch.
    """
    return confusion(stream, keys)
