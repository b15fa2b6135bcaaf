"""Quality rules: text counts and a hashed n-gram log-likelihood ratio.

The word unigrams and bigrams of every document are hashed into BUCKETS cells.  One
multinomial is fitted on one half of the trusted documents (labelled quality 1), dealt by a
hash of the id, one on the raw corpus (every document); a document's score is the mean log
ratio of the two over its n-grams.  The threshold is fixed once, as a low quantile of the
scores of the other half, and applied to every document.  Both halves are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolith.llm.common import byte_class, code_points, crc_fold, lowered, map_arrow, materialise, mix, ngram_hash, prefix_sums, span_hash, steps, utf8, word_spans
from annolith.operators.order import row_index

BUCKETS = 1 << 16
#: Share of trusted documents that the threshold may reject.
QUANTILE = 0.004
WINDOW, SYMBOLS = 8, b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _per_document(positions: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Number of true flags between edges."""
    sums = np.concatenate([[0], np.cumsum(positions)])
    return np.diff(sums[edges])


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of each document."""
    n = len(offsets) - 1
    starts, ends, first = word_spans(data, offsets, byte_class("nonspace"))
    number = np.diff(first)
    points = code_points(data)
    chars = np.concatenate([[0], np.cumsum(points[ends] - points[starts])])
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    sums = prefix_sums(data)
    seeds = mix(np.arange(1, n + 1, dtype=np.uint64))
    # Lines with a word; a line's key holds its document.
    breaks = np.flatnonzero(data == 0x0A)
    begin = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    doc = np.searchsorted(offsets, begin, "right") - 1
    stop = np.minimum(np.concatenate([breaks, [len(data)]])[np.searchsorted(breaks, begin)], offsets[np.minimum(doc + 1, n)]) if n else begin
    worded = (doc < n) & (np.searchsorted(starts, begin) < np.searchsorted(starts, stop))
    begin, stop, doc = begin[worded], stop[worded], doc[worded]
    _, at = np.unique(mix(span_hash(sums, begin, stop) ^ seeds[doc]), return_index=True)
    duplicates = np.bincount(doc, minlength=n) - np.bincount(doc[at], minlength=n)
    # Words inside windows that stand twice or more.
    owner = np.repeat(np.arange(n), number)
    grams = ngram_hash(span_hash(sums, starts, ends), WINDOW)
    place = np.flatnonzero(owner[: len(grams)] == owner[WINDOW - 1 :]) if len(grams) else np.zeros(0, np.int64)
    covered = np.zeros(len(starts) + 1, np.int64)
    if len(place):
        keys = mix(grams[place] ^ seeds[owner[place]])
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        again = np.zeros(len(order), bool)
        again[1:] |= same
        again[:-1] |= same
        hit = place[order[again]]
        covered = np.bincount(hit, minlength=len(starts) + 1) - np.bincount(hit + WINDOW, minlength=len(starts) + 1)[: len(starts) + 1]
    repeated = _per_document(np.cumsum(covered)[: len(starts)] > 0, first)
    return {"n_words": number, "word_chars": chars[first[1:]] - chars[first[:-1]], "n_symbols": _per_document(symbol[data], offsets), "n_dup_lines": duplicates, "n_repeat_words": repeated}


def cells(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and cell of each unigram and bigram of lower-cased words."""
    data = lowered(data, latin=True)
    starts, ends, first = word_spans(data, offsets, byte_class("nonspace"))
    words = span_hash(prefix_sums(data), starts, ends)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    pairs = ngram_hash(words, 2)
    inside = owner[: len(pairs)] == owner[1:] if len(pairs) else np.zeros(0, bool)
    return np.concatenate([owner, owner[: len(pairs)][inside]]), (np.concatenate([words, pairs[inside]]) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to one (cell, n) row for each cell of the task."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        for i, j in steps(offsets):
            _, cell = cells(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            total += np.bincount(cell, minlength=BUCKETS)
    own = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], names=["cell", "n"])


def _totals(texts: DataFrame) -> np.ndarray:
    """Number of n-grams in each cell."""
    out = np.zeros(BUCKETS)
    for row in map_arrow(texts.select("text"), _counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # a row a cell
        out[row["cell"]] = row["n"]
    return out


Model = tuple[np.ndarray, float]


def _scores(data: np.ndarray, offsets: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    doc, cell = cells(data, offsets)
    n = len(offsets) - 1
    return np.bincount(doc, ratio[cell], n) / np.maximum(np.bincount(doc, minlength=n), 1)


def _scored(batches: Iterator[pa.RecordBatch], ratio: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for i, j in steps(offsets):
            score = _scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ratio)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(score)], names=["doc_id", "score"])


def _quantile(scores: DataFrame, share: float) -> float | None:
    """The exact quantile between the two nearest scores; the driver sees these two, no task more than its part of the scores."""
    placed = row_index(scores, "score")
    last = placed.agg(F.max("index").alias("last")).first()["last"]
    if last is None:
        return None
    at = share * last
    low = int(at)
    near = {r["index"]: r["score"] for r in placed.filter(F.col("index").isin(low, min(low + 1, last))).collect()}
    return near[low] + (at - low) * (near[min(low + 1, last)] - near[low])


def fit(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE) -> Model:
    """(log ratio by cell, threshold).  docs: doc_id, text; trusted: the doc_id of trusted documents.

    Raw counts are over every document, target counts over every trusted document of one half, the threshold over every one
    of the other.  Only the texts of the first half are dealt by id to meet the labels; the others are scored where they
    are, and their scores meet them.  Without trusted documents every ratio is 0 and every document passes.
    """
    chosen = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct().hint("merge")  # the same plan at every size
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fits = crc_fold(F.col("doc_id"), 2) == 0
    target = _totals(own.filter(fits).join(chosen, "doc_id", "left_semi"))
    if not target.sum():
        return np.zeros(BUCKETS, np.float32), -np.inf
    raw = _totals(own)
    # The target is smoothed by the raw corpus: cells without evidence weigh nothing.
    share = (raw + 0.5) / (raw + 0.5).sum()
    ratio = np.log((target + 8 * BUCKETS * share / 16 + 1e-9) / (target.sum() + 8 * BUCKETS / 16) / share).astype(np.float32)
    scored = map_arrow(own.filter(~fits), lambda it: _scored(it, ratio), "doc_id long, score double")
    cut = _quantile(materialise(scored.join(chosen, "doc_id", "left_semi").select("score"), "trusted_scores"), quantile)
    return ratio, -np.inf if cut is None else float(cut)


def _judged(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    ratio, cut = model
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for i, j in steps(offsets):
            own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            found, score = counts(own, at), _scores(own, at, ratio)
            failed = (found["n_words"] < 20) | (100 * found["n_repeat_words"] > 30 * found["n_words"])
            columns = [pa.array(found[name].astype(np.int64)) for name in COUNTS]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns, pa.array(score), pa.array(failed), pa.array(~failed & (score >= cut))], names=["doc_id", *COUNTS, "score", "base_failed", "kept"])


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, the five counts, score, base_failed and kept of each row.

    Words are runs of anything but space and \\x09-\\x0D.  Null and empty texts have no words and so fail the
    base rule.  Rows are judged one by one: repeated rows and null ids get their own text's verdict.  Extra
    columns are ignored; an empty table gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(own, lambda it: _judged(it, model), f"doc_id long, {', '.join(f'{x} long' for x in COUNTS)}, score double, base_failed boolean, kept boolean")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents labelled quality 1 and never 0."""
    usable: Column = F.col("doc_id").isNotNull() & F.col("quality").isNotNull()
    return labels.filter(usable).groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")
