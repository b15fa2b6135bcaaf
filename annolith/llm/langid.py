"""Language identification by rank-order n-gram profiles.

A profile lists the PROFILE most frequent letter n-grams (1 to 3 letters, words padded by
one blank on either side) of a language's training texts, by rank.  A document's own most
frequent n-grams are ranked alike; its distance to a profile is the sum of the rank
differences, PROFILE for an n-gram that the profile lacks.

Profiles are fitted on at most SAMPLE training documents of each of the LANGUAGES languages
with most of them, taken in the order of a hash of the id, and hold PROFILE numbers each, so
they are shipped with the function.  Prediction is one Arrow pass over the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolith.llm.common import crc_fold, map_arrow, steps, utf8

PROFILE, SAMPLE, LONGEST = 400, 2000, 3
#: Languages that are learned at most: what is broadcast has LANGUAGES * SAMPLE ids, what the driver sees LANGUAGES * PROFILE rows.
LANGUAGES = 1000
#: Bytes of text in one vectorised step.
STEP = 100_000
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """For each code point of the Basic Multilingual Plane its lower-case letter, or 0 for what is no letter; by rule."""
    table = np.zeros(0x10000, np.uint16)
    for c in range(0x10000):
        char = chr(c)
        if char.isalpha():
            low = char.lower()
            table[c] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else c
    return table


_table: list[np.ndarray] = []


def ranked(data: np.ndarray, offsets: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each document's n-grams: document, code, count, rank (0 first; by count, then code), ranks under top only."""
    if not _table:
        _table.append(_letters())
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    ends = lead[offsets]
    if lead[-1] != len(points):  # not valid UTF-8: document by document, with U+FFFD for what is wrong
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([0, *map(len, texts)])
    # Astral letters are kept apart from all others by one shared code.
    letters = _table[0][np.minimum(points, 0xFFFF)]
    letters[(points > 0xFFFF)] = 0
    for k in np.flatnonzero(points > 0xFFFF):
        if chr(points[k]).isalpha():
            letters[k] = 0xFFFE
    # A blank (1) before and after each document, and for each run of anything else.
    counts = np.diff(ends)
    owner = np.repeat(np.arange(len(counts)), counts + 2)
    padded = np.zeros(len(letters) + 2 * len(counts), np.uint64)
    at = np.arange(len(letters)) + 2 * np.repeat(np.arange(len(counts)), counts) + 1
    padded[at] = letters
    kept = (padded > 0) | np.concatenate([[True], (padded[:-1] > 0) | (owner[1:] != owner[:-1])])
    owner, seq = owner[kept], np.where(padded[kept] > 0, padded[kept], np.uint64(1))
    codes = []
    for n in range(1, LONGEST + 1):
        if len(seq) >= n:
            code = np.zeros(len(seq) - n + 1, np.uint64)
            for k in range(n):
                code = (code << np.uint64(16)) | seq[k : k + len(code)]
            ok = owner[: len(code)] == owner[n - 1 :]
            if n == 1:
                ok &= code != 1
            elif n == 2:
                ok &= code != 0x10001
            codes.append((owner[: len(code)][ok], code[ok]))
    if not codes:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    owners, grams = np.concatenate([x for x, _ in codes]), np.concatenate([x for _, x in codes])
    parts: list[list[np.ndarray]] = [[], [], [], []]
    order = np.argsort(owners, kind="stable")
    owners, grams = owners[order], grams[order]
    first = np.searchsorted(owners, np.arange(len(counts) + 1))
    for d in range(len(counts)):
        if first[d + 1] > first[d]:
            own, number = np.unique(grams[first[d] : first[d + 1]], return_counts=True)
            by = np.argsort(-number, kind="stable")[:top]
            parts[0].append(np.full(len(by), d))
            parts[1].append(own[by])
            parts[2].append(number[by])
            parts[3].append(np.arange(len(by)))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in parts)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, code, n)."""
    for batch in batches:
        langs, (data, offsets) = np.array(batch.column(0).to_pylist(), object), utf8(batch.column(1))
        for i, j in steps(offsets, STEP):
            doc, code, n, _ = ranked(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], 1 << 40)
            for lang in sorted(set(langs[i:j])):
                of = langs[i:j][doc] == lang
                own, at = np.unique(code[of], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.view(np.int64)), pa.array(np.bincount(at, n[of], len(own)).astype(np.int64))], names=["lang", "code", "n"])


Profiles = dict[str, np.ndarray]


def fit(docs: DataFrame, train: Column, sample: int = SAMPLE, profile: int = PROFILE, languages: int = LANGUAGES) -> Profiles:
    """Each learned language's n-gram codes by rank, from rows with train true and lang and text there.

    The `languages` languages with most such rows are learned.  At most `sample` rows of each are read, in the order of a hash
    of doc_id.  The result has `profile` numbers for each language.
    """
    usable = docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
    # Of a language with n rows, those whose hash is in the lowest 4 * sample / n of its range hold the first `sample`:
    # few rows of a language meet in one task, however many it has.
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    low = (F.xxhash64("doc_id").cast("double") / F.lit(2.0**64) + 0.5) * F.col("n") <= F.lit(4.0 * sample) + 64
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    first = usable.join(F.broadcast(sizes), "lang").filter(low).withColumn("at", place).filter(F.col("at") <= sample).select("doc_id", F.col("lang").alias("of"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    chosen = texts.join(F.broadcast(first), "doc_id").filter(F.col("lang") == F.col("of")).select("lang", "text")  # at most languages * sample ids
    counts = map_arrow(chosen, _counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = counts.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).filter(F.col("at") <= profile)
    found: dict[str, list[tuple[int, int]]] = {}
    for row in top.select("lang", "code", "at").collect():  # profile rows a language
        found.setdefault(row.lang, []).append((row["at"], row.code))
    return {lang: np.array([code for _, code in sorted(rows)], np.int64).view(np.uint64) for lang, rows in sorted(found.items())}


def distances(docs: np.ndarray, codes: np.ndarray, ranks: np.ndarray, n: int, profiles: Profiles, top: int) -> np.ndarray:
    """n x languages: mean out-of-place distance of each document's n-grams, as a share of the largest possible."""
    out = np.ones((n, len(profiles)))
    total = np.maximum(np.bincount(docs, minlength=n), 1)
    for k, own in enumerate(profiles.values()):
        order = np.argsort(own)
        at = np.minimum(np.searchsorted(own[order], codes), len(own) - 1)
        known = own[order][at] == codes
        away = np.where(known, np.abs(order[at] - ranks), top)
        out[:, k] = np.bincount(docs, np.minimum(away, top), n) / (total * top)
    return out


def _predicted(batches: Iterator[pa.RecordBatch], profiles: Profiles, top: int) -> Iterator[pa.RecordBatch]:
    names = np.array([*profiles, UNKNOWN], object)
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for i, j in steps(offsets, STEP):
            doc, code, _, rank = ranked(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], top)
            has = np.bincount(doc, minlength=j - i) > 0
            best, score = np.full(j - i, len(profiles)), np.zeros(j - i)
            if profiles:
                away = distances(doc, code, rank, j - i, profiles, top)
                best = np.where(has, np.argmin(away, 1), len(profiles))
                two = np.sort(away, 1)[:, :2] if len(profiles) > 1 else np.column_stack([away[:, 0], np.ones(j - i)])
                score = np.where(has, np.clip((two[:, 1] - two[:, 0]) / np.maximum(two[:, 1], 1e-9), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(names[best].tolist(), pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])


def identify(docs: DataFrame, profiles: Profiles, profile: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred and score of each row's whole text.

    lang_pred is the nearest profile's language (ties: the first by name), `und` if the text is null or has no
    letter, or if nothing was learned.  score is how much nearer the best profile is than the second, from 0 to
    1 (`und`: 0).  Null ids, repeated rows and extra columns are passed by; an empty table gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(own, lambda it: _predicted(it, profiles, profile), "doc_id long, lang_pred string, score double")


def rejected_free(docs: DataFrame, profiles: Profiles, profile: int = PROFILE) -> DataFrame:
    """docs without the rows whose language is `und`: the same columns, passed through one Arrow function."""
    columns, schema = docs.columns, docs.schema
    place = columns.index("text")
    if dict(docs.dtypes)["text"] != "string":
        docs = docs.withColumn("text", F.col("text").cast("string"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                pair = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(place)], names=["doc_id", "text"])
                langs = pa.concat_arrays([x.column(1) for x in _predicted(iter([pair]), profiles, profile)])
                yield batch.filter(pa.compute.not_equal(langs, UNKNOWN))

    import pyarrow.compute  # noqa: F401

    return map_arrow(docs, kept, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_fold(doc_id, 5) == 0, F.lit(False))
