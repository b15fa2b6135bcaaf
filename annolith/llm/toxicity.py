"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is logistic in the hashed words
and word beginnings it holds, a document's is their noisy-or: it is toxic if any sentence
is.  Weights are trained from document labels alone and then locate offending sentences.

The model is fitted on at most LABELLED labelled documents, in the order of a hash of the
id: features are chosen by a distributed count over them, and the sentences that hold any
chosen feature (those without need a number only) are what the driver trains on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolith.llm.common import byte_class, crc_fold, lowered, map_arrow, mix, prefix_sums, span_hash, steps, utf8, word_spans

LABELLED, FEATURES, SPACE = 12_000, 1024, 1 << 20
#: Lengths in bytes of the word beginnings that are features beside the whole word.
PREFIXES = (5, 6, 7, 8, 9)
THRESHOLD = 0.7


def _parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (start, end), the sentence of each, and each sentence's document.  Sentences end at . ! ? and \\n."""
    starts, ends, _ = word_spans(data, offsets, byte_class("alnum"))
    stop = np.zeros(256, bool)
    stop[[0x0A, 0x21, 0x2E, 0x3F]] = True
    cut = np.zeros(len(data) + 1, np.int64)
    cut[1:] = stop[data]
    cut[offsets[:-1]] += 1
    number = np.cumsum(cut)[starts]
    heads = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(starts) else np.zeros(0, np.int64)
    sentence = np.cumsum(np.concatenate([[0], number[1:] != number[:-1]])) if len(starts) else number
    return starts, ends, sentence, np.searchsorted(offsets, starts[heads], "right") - 1


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of word numbers and feature cells: whole words, then each beginning."""
    sums = prefix_sums(lowered(data, latin=True))
    room = np.uint64(SPACE - 1)
    yield np.arange(len(starts)), (span_hash(sums, starts, ends) & room).astype(np.int64)
    length = ends - starts
    for n in PREFIXES:
        long = np.flatnonzero(length >= n)
        yield long, (mix(span_hash(sums, starts[long], starts[long] + n) + np.uint64(n)) & room).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) to (cell, toxic documents, other documents) of each task."""
    found = np.zeros((2, SPACE), np.int32)
    for batch in batches:
        labels, (data, offsets) = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64), utf8(batch.column(1))
        for i, j in steps(offsets):
            own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            starts, ends, sentence, doc = _parts(own, at)
            keys = np.unique(np.concatenate([doc[sentence[words]] * SPACE + cell for words, cell in _features(own, starts, ends)])) if len(starts) else np.zeros(0, np.int64)
            toxic = labels[i:j][keys // SPACE] == 1
            found[1] += np.bincount(keys[toxic] % SPACE, minlength=SPACE).astype(np.int32)
            found[0] += np.bincount(keys[~toxic] % SPACE, minlength=SPACE).astype(np.int32)
    own = np.flatnonzero(found[1])
    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(found[1][own].astype(np.int64)), pa.array(found[0][own].astype(np.int64))], names=["cell", "toxic", "other"])


def _instances(batches: Iterator[pa.RecordBatch], chosen: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(toxic, text) to toxic, plain (sentences without a chosen feature), bags (chosen features of each other sentence)."""
    index = np.full(SPACE, -1, np.int32)
    index[chosen] = np.arange(len(chosen))
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for i, j in steps(offsets):
            own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            starts, ends, sentence, doc = _parts(own, at)
            number, pairs = np.bincount(doc, minlength=j - i), [np.zeros((0, 2), np.int64)]
            for words, cell in _features(own, starts, ends):
                known = index[cell] >= 0
                pairs.append(np.column_stack([sentence[words[known]], index[cell[known]]]))
            pairs_ = np.unique(np.concatenate(pairs), axis=0)
            bags: list[list[list[int]]] = [[] for _ in range(j - i)]
            heads = np.flatnonzero(np.concatenate([[True], pairs_[1:, 0] != pairs_[:-1, 0]])) if len(pairs_) else []
            for a, b in zip(heads, [*heads[1:], len(pairs_)] if len(heads) else [], strict=True):
                bags[doc[pairs_[a, 0]]].append(pairs_[a:b, 1].tolist())
            plain = [int(number[k]) - len(bags[k]) for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(plain, pa.int64()), pa.array(bags, pa.list_(pa.list_(pa.int64())))], names=["toxic", "plain", "bags"])


Model = tuple[np.ndarray, np.ndarray, float]


def gradient(weights: np.ndarray, bias: float, labels: np.ndarray, plain: np.ndarray, doc: np.ndarray, sentence: np.ndarray, feature: np.ndarray, decay: float) -> np.ndarray:
    """Slope of the mean negative log likelihood by each weight and, last, by the bias; decay / 20 times the squared weights on top."""
    z = bias + np.bincount(sentence, weights[feature], len(doc)) if len(doc) else np.zeros(0)
    p, none = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-bias))
    total = np.bincount(doc, np.logaddexp(0, z), len(labels)) + plain * np.logaddexp(0, bias)
    total = np.maximum(total, 1e-9)
    # d loss / d softplus sum: 1 for clean documents, -exp(-S) / (1 - exp(-S)) for toxic ones.
    outer = np.where(labels == 1, -1 / np.expm1(total), 1.0)
    dz = outer[doc] * p
    return np.append(np.bincount(feature, dz[sentence], len(weights)) + decay * len(labels) * weights / 10, dz.sum() + (outer * plain).sum() * none) / max(len(labels), 1)


def train(labels: np.ndarray, plain: np.ndarray, doc: np.ndarray, sentence: np.ndarray, feature: np.ndarray, n: int, rounds: int = 400, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam on the noisy-or likelihood.

    doc: the document of each sentence with features; sentence and feature: which features it holds.
    """
    weights, bias = np.zeros(n), -6.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, rounds + 1):
        slope = gradient(weights, bias, labels, plain, doc, sentence, feature, decay)
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
        weights, bias = weights - step[:-1], bias - step[-1]
    return weights, float(bias)


def fit(docs: DataFrame, labels: DataFrame, at_most: int = LABELLED, features: int = FEATURES) -> Model:
    """(cells, weights, bias).  labels: doc_id and toxic (0 or 1); rows without either are left out.

    At most `at_most` labelled documents are read; a document labelled twice counts as toxic if any label says so.
    Without labelled documents of both kinds the model gives every document score 0.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("labelled_id"), F.col("toxic").cast("int").alias("toxic")).filter("labelled_id is not null and toxic is not null")
    chosen = chosen.groupBy("labelled_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(at_most)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bags = own.join(F.broadcast(chosen), own.doc_id == chosen.labelled_id).select("toxic", "text")  # at_most ids
    seen = map_arrow(bags, _counted, "cell long, toxic long, other long").groupBy("cell").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).filter("toxic >= 3")
    size = bags.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    if not size["t"] or size["t"] == size["n"]:
        return np.zeros(0, np.int64), np.zeros(0), -np.inf
    rate = size["t"] / size["n"]
    expected = (F.col("toxic") + F.col("other")) * F.lit(rate)
    strength = (F.col("toxic") - expected) / F.sqrt(expected)
    top = seen.withColumn("strength", strength).filter("strength > 2").orderBy(F.desc("strength"), "cell").limit(features).collect()  # `features` rows
    cells = np.array(sorted(r["cell"] for r in top), np.int64)
    rows = map_arrow(bags, lambda it: _instances(it, cells), "toxic int, plain long, bags array<array<long>>").collect()  # chosen features of at_most documents
    doc, sentence, feature = [], [], []
    for k, row in enumerate(rows):
        for bag in row["bags"]:
            sentence += [len(doc)] * len(bag)
            feature += bag
            doc.append(k)
    as_int = lambda x: np.array(x, np.int64)
    weights, bias = train(as_int([r["toxic"] for r in rows]), np.array([r["plain"] for r in rows], float), as_int(doc), as_int(sentence), as_int(feature), len(cells))
    return cells, weights, bias


def _scored(batches: Iterator[pa.RecordBatch], model: Model, locate: bool) -> Iterator[pa.RecordBatch]:
    cells, weights, bias = model
    table = np.zeros(SPACE, np.float32)
    table[cells] = weights
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for i, j in steps(offsets):
            own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            starts, ends, sentence, doc = _parts(own, at)
            z = np.full(len(doc), bias)
            for words, cell in _features(own, starts, ends):
                known = table[cell] != 0
                z += np.bincount(sentence[words[known]], table[cell[known]], len(doc))
            score = np.clip(-np.expm1(-np.bincount(doc, np.logaddexp(0, z), j - i)), 0.0, 1.0)
            columns, names = [batch.column(0).slice(i, j - i), pa.array(score)], ["doc_id", "score"]
            if locate:
                found: list[list[str]] = [[] for _ in range(j - i)]
                heads = np.searchsorted(sentence, np.arange(len(doc)))
                tails = np.append(heads[1:], len(starts)) - 1
                for k in np.flatnonzero(z > 0):
                    found[doc[k]].append(own[starts[heads[k]] : ends[tails[k]]].tobytes().decode())
                columns.append(pa.array(found, pa.list_(pa.string())))
                names.append("sentences")
            yield pa.RecordBatch.from_arrays(columns, names=names)


def score(docs: DataFrame, model: Model, locate: bool = True) -> DataFrame:
    """doc_id, score (0 to 1) and, with locate, the sentences likelier toxic than not, in text order.

    Null and empty texts have no sentences and score 0.  Rows are scored one by one, whatever their ids and other
    columns; an empty table gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(own, lambda it: _scored(it, model, locate), "doc_id long, score double" + ", sentences array<string>" * locate)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_fold(doc_id, 3) == 1, F.lit(False))
