"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space.

A document is a bag of hashed byte trigrams and words, and of two shapes (how many words of a hundred
equal the one before, how many stand in the text already); counts are damped and weighted by how few
of all documents have the cell, shapes by a fixed weight.  The latent space is the span of the leading singular vectors of
the labelled documents' matrix, found by subspace iteration; the labelled vectors, of unit length,
are shipped with the function (at_most * AXES numbers).  Every document is projected and multiplied
with all of them, in blocks; its NEAREST neighbours vote with their labels, weighted by a power
of the cosine and by how many labelled documents one of the sample stands for.

Document frequencies are over all documents.  Labelled rows are read up to a bound for each label,
in the order of a hash of the id.  Two Arrow passes over the texts, no shuffle of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolith.llm.common import byte_class, crc_fold, map_arrow, mix, prefix_sums, span_hash, steps, utf8, word_spans

#: Cells of trigrams, then cells of words, then shapes.
TRIGRAMS, WORDS, SHAPES = 1 << 12, 1 << 12, 2
CELLS = TRIGRAMS + WORDS + SHAPES
SHAPE_WEIGHT = 6.0
#: Labelled documents read for each label at most; dimensions of the latent space; neighbours that vote.
LABELLED, AXES, NEAREST, POWER = 1_500, 64, 15, 8
THRESHOLD = 0.3
#: Documents and bytes of one step: its matrix has ROWS * CELLS floats.
ROWS, STEP = 256, 500_000
#: What the prior weighs among the votes.
PRIOR_WEIGHT = 1e-3


def matrix(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """n x CELLS counts of trigrams and words, neither across documents, and shapes per hundred words."""
    n = len(offsets) - 1
    out = np.zeros(n * CELLS, np.float32)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    if len(data) > 2:
        wide = data.astype(np.uint64)
        code = mix((wide[:-2] << np.uint64(16)) | (wide[1:-1] << np.uint64(8)) | wide[2:])
        inside = owner[:-2] == owner[2:]
        out += np.bincount(owner[:-2][inside] * CELLS + (code[inside] & np.uint64(TRIGRAMS - 1)).astype(np.int64), minlength=len(out))
    starts, ends, first = word_spans(data, offsets, byte_class("nonspace"))
    if len(starts):
        words, doc = span_hash(prefix_sums(data), starts, ends), np.repeat(np.arange(n), np.diff(first))
        out += np.bincount(doc * CELLS + TRIGRAMS + (words & np.uint64(WORDS - 1)).astype(np.int64), minlength=len(out))
        share = lambda flags, of: 100 * np.bincount(of[flags], minlength=n) / np.maximum(np.diff(first), 1)
        stutter = np.zeros(len(words), bool)
        stutter[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
        _, at = np.unique(words ^ mix(doc.astype(np.uint64) + np.uint64(1)), return_index=True)
        again = np.ones(len(words), bool)
        again[at] = False
        out.reshape(n, CELLS)[:, -SHAPES:] = np.column_stack([share(stutter, doc), share(again, doc)])
    return out.reshape(n, CELLS)


def _matrices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    data, offsets = utf8(column)
    for i, j in steps(offsets, STEP):
        for a in range(i, j, ROWS):
            b = min(a + ROWS, j)
            yield a, b, matrix(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to one (cell, n) row for each cell that the task's documents have; cell -1 counts the documents."""
    found, total = np.zeros(CELLS, np.int64), 0
    for batch in batches:
        for a, b, counts in _matrices(batch.column(0)):
            found += (counts > 0).sum(0)
            total += b - a
    own = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(own, -1)), pa.array(np.append(found[own], total))], names=["cell", "n"])


def weighted(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Damped counts times rarity, rows of unit length (empty rows stay zero)."""
    x = np.log1p(counts) * rarity
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _sampled(batches: Iterator[pa.RecordBatch], rarity: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(label, text) to label, cells and values of the weighted row."""
    for batch in batches:
        for a, b, counts in _matrices(batch.column(1)):
            x = weighted(counts, rarity)
            held = [np.flatnonzero(row) for row in x]
            values = [row[c].tobytes() for row, c in zip(x, held, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([c.astype(np.int32).tobytes() for c in held], pa.binary()), pa.array(values, pa.binary())], names=["label", "cells", "weights"])


def axes(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """CELLS x k leading right singular vectors of x, by subspace iteration from a fixed start."""
    k = min(k, *x.shape)
    basis = np.linalg.qr(np.random.default_rng(0).standard_normal((x.shape[1], min(k + 16, *x.shape))))[0].astype(np.float32)
    for _ in range(rounds):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    _, _, turn = np.linalg.svd(x @ basis, full_matrices=False)
    return np.ascontiguousarray((basis @ turn.T)[:, :k], np.float32)


@dataclass
class Model:
    rarity: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    stands_for: np.ndarray
    prior: float


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", at_most: int = LABELLED, k: int = AXES) -> Model:
    """labels: doc_id and column (0 or 1); rows without either are left out, a document labelled both ways counts as 0.

    At most `at_most` labelled documents of each label are read.  Without labels every score is 0.5.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = {r["cell"]: r["n"] for r in map_arrow(own.select("text"), _frequencies, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # a row a cell
    total, rarity = seen.pop(-1, 0), np.zeros(CELLS, np.float32)
    for cell, n in seen.items():
        rarity[cell] = np.log((1 + total) / (1 + n)) + 0.1
    rarity[-SHAPES:] = SHAPE_WEIGHT
    usable = labels.select(F.col("doc_id").cast("long").alias("labelled_id"), F.col(column).cast("int").alias("label")).filter("labelled_id is not null and label in (0, 1)")
    usable = usable.groupBy("labelled_id").agg(F.min("label").alias("label"))
    number = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}  # a row a label
    parts = [usable.filter(F.col("label") == label).orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(at_most) for label in (0, 1)]
    chosen = parts[0].union(parts[1])
    texts = own.join(F.broadcast(chosen), own.doc_id == chosen.labelled_id).select("label", "text")  # 2 * at_most ids
    rows = map_arrow(texts, lambda it: _sampled(it, rarity), "label int, cells binary, weights binary").collect()  # 2 * at_most rows of CELLS values at most
    rows.sort(key=lambda r: (r["label"], bytes(r["cells"]), bytes(r["weights"])))  # the order of tasks must not show
    x = np.zeros((len(rows), CELLS), np.float32)
    for i, row in enumerate(rows):
        x[i, np.frombuffer(row["cells"], np.int32)] = np.frombuffer(row["weights"], np.float32)
    kind = np.array([r["label"] for r in rows], np.int64)
    basis = axes(x, k) if len(rows) else np.zeros((CELLS, 0), np.float32)
    read = np.maximum(np.bincount(kind, minlength=2), 1)
    stands_for = np.array([number.get(label, 0) / read[label] for label in (0, 1)])[kind] if len(rows) else np.zeros(0)
    every = sum(number.values())
    return Model(rarity, basis, unit(x @ basis), kind, stands_for, number.get(1, 0) / every if every else 0.5)


def vote(own: np.ndarray, model: Model, nearest: int = NEAREST, power: float = POWER) -> np.ndarray:
    """Share of label 1 among the nearest labelled vectors of each row, by cosine ** power; the prior counts a little."""
    if not len(model.labels):
        return np.full(len(own), model.prior)
    cosine = np.maximum(own @ model.vectors.T, 0)
    k = min(nearest, len(model.labels))
    at = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    weight = np.take_along_axis(cosine, at, 1).astype(float) ** power * model.stands_for[at]
    return (np.sum(weight * model.labels[at], 1) + PRIOR_WEIGHT * model.prior) / (weight.sum(1) + PRIOR_WEIGHT)


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, counts in _matrices(batch.column(1)):
            score = vote(unit(weighted(counts, model.rarity) @ model.basis), model)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.clip(score, 0.0, 1.0))], names=["doc_id", "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of each row's whole text.

    Null, empty and blank texts, and texts like no labelled one, get the share of label 1 among the labels.  Rows are
    scored one by one, whatever their ids and other columns; an empty table gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(own, lambda it: _scored(it, model), "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_fold(doc_id, 5) == 0, F.lit(False))
