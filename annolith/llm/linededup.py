"""Line deduplication by pairwise alignment.

A text's lines are cut into pieces where a sentence may begin (after . ! or ?, and before a
word with a capital), so that a passage inside a longer line is found as well.  Consecutive
pieces are taken together until they have `least` words: such a run is rare, however common
its pieces are.  Every run is linked to the first document (smallest doc_id) that holds it,
one link whatever the number of copies, so no group of copies is ever paired with itself.
Each pair of documents that runs link is aligned once, over the stretches that the runs
span and `least` pieces on either side: patience diff on pieces that stand once in either stretch, extended to the equal
neighbours of each anchor, then the gaps between anchors.  Aligned pieces with the same shift
and at most GAP others between are one block; blocks of `least` words are deleted from the
later document, and what is left is aligned again, so passages in another order and further
copies go too.  Every run that an earlier document holds is deleted in the end.

Pieces are compared by 64-bit hashes; no text is shuffled.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolith.llm.common import byte_class, map_arrow, materialise, prefix_sums, span_hash, steps, utf8, word_spans

#: A block of aligned pieces is deleted if it has so many words.
MIN_BLOCK_WORDS = 20
#: Bytes that count as one word where there are no spaces.
WORD_BYTES = 24
#: Pieces without a match that a block may have between two aligned ones.
GAP = 2
#: Bytes of text that one step cuts into pieces; some 50 bytes of memory are needed for each.
STEP = 500_000
#: Pieces of an owner in which the runs of one alignment begin.
STRETCH = 2048
#: Rounds of alignment before the runs that are left are looked up directly (which gives the same runs, in linear time).
PASSES = 8


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte, words and line of each piece (lines count from the first text on), and each text's first piece (n + 1 numbers)."""
    starts, ends, first = word_spans(data, offsets, byte_class("nonspace"))
    if not len(starts):
        return starts, ends, starts, starts, np.zeros(len(offsets), np.int64)
    lines = np.concatenate([[0], np.cumsum(data == 0x0A)])[starts]
    lead, second = data[starts], data[np.minimum(starts + 1, len(data) - 1)]
    capital = (lead >= 0x41) & (lead <= 0x5A) | (lead == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
    new = capital
    new[0] = True
    new[1:] |= (lines[1:] != lines[:-1]) | np.isin(data[ends[:-1] - 1], np.frombuffer(b".!?", np.uint8))
    new[first[:-1][first[:-1] < len(starts)]] = True
    at = np.flatnonzero(new)
    weight = np.concatenate([[0], np.cumsum(-(-(ends - starts) // WORD_BYTES))])
    until = np.concatenate([at[1:], [len(starts)]])
    return starts[at], ends[until - 1], weight[until] - weight[at], lines[at], np.searchsorted(at, first)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, of, text) to (id, of, pieces: hashes, words)."""
    for batch in batches:
        data, offsets = utf8(batch.column(2))
        for i, j in steps(offsets, STEP):
            own = data[offsets[i] : offsets[j]]
            starts, ends, words, _, first = pieces(own, offsets[i : j + 1] - offsets[i])
            hashes = span_hash(prefix_sums(own), starts, ends).view(np.int64)
            at = pa.array(first, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, kind)) for x, kind in ((hashes, pa.int64()), (words, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *lists], names=["id", "of", "hashes", "words"])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and n + 1 offsets of a list column."""
    offsets = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths().fill_null(0)))]).astype(np.int64)
    return np.asarray(column.flatten()), offsets


def run_ends(words: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First piece and end of the shortest run of `least` words from each piece on, where its text has one."""
    total = np.concatenate([[0], np.cumsum(words)])
    ends = np.searchsorted(total, total[:-1] + least)
    limit = np.repeat(offsets[1:], np.diff(offsets))
    kept = np.flatnonzero(ends <= limit)
    return kept, ends[kept]


def _runs(batches: Iterator[pa.RecordBatch], least: int, stretch: int) -> Iterator[pa.RecordBatch]:
    """(id, of, hashes, words) to (run, id, of, first, last): each text's distinct runs in each stretch of pieces, where the first there begins
    and the last that begins there ends."""
    for batch in batches:
        words, offsets = _flat(batch.column(3))
        hashes = _flat(batch.column(2))[0].astype(np.int64).view(np.uint64)
        starts, ends = run_ends(words.astype(np.int64), offsets, least)
        if not len(starts):
            continue
        runs = span_hash(prefix_sums(hashes), starts, ends)
        owner = np.searchsorted(offsets, starts, "right") - 1
        part = (starts - offsets[owner]) // stretch
        order = np.lexsort((starts, runs, owner))
        runs, owner, part, starts, ends = runs[order], owner[order], part[order], starts[order], ends[order]
        new = np.flatnonzero(np.concatenate([[True], (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])]))
        last = np.concatenate([new[1:], [len(runs)]]) - 1
        rows, base = owner[new], offsets[owner[new]]
        own = pa.array(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(runs[new].view(np.int64)), batch.column(0).take(own), batch.column(1).take(own), pa.array((starts[new] - base).astype(np.int32)), pa.array((ends[last] - base).astype(np.int32))],
            names=["run", "id", "of", "first", "last"],
        )


def rising(places: list[int]) -> list[int]:
    """Positions (in places) of a longest strictly rising run, by patience sorting."""
    piles: list[int] = []
    tops: list[int] = []
    back = [-1] * len(places)
    for k, x in enumerate(places):
        at = bisect_left(tops, x)
        back[k] = piles[at - 1] if at else -1
        if at == len(tops):
            tops.append(x)
            piles.append(k)
        else:
            tops[at], piles[at] = x, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def align(own: list[int | None], places: dict[int, list[int]], other: list[int]) -> dict[int, int]:
    """Patience diff: piece of the later text -> piece of the earlier one; own: None where a piece is gone, places: of each hash in other."""
    count: dict[int, int] = {}
    for x in own:
        if x is not None:
            count[x] = count.get(x, 0) + 1
    once = [k for k, x in enumerate(own) if x is not None and count[x] == 1 and len(places.get(x, ())) == 1]
    anchors = [once[k] for k in rising([places[own[k]][0] for k in once])]
    found = {k: places[own[k]][0] for k in anchors}
    edges = [(-1, -1), *sorted(found.items()), (len(own), len(other))]
    for (k, low), (end, high) in zip(edges[:-1], edges[1:], strict=True):
        # Equal neighbours of either anchor, then what is left between in order, the nearest place first.
        while k >= 0 and k + 1 < end and low + 1 < high and own[k + 1] == other[low + 1]:
            k, low = k + 1, low + 1
            found[k] = low
        while end < len(own) and end - 1 > k and high - 1 > low and own[end - 1] == other[high - 1]:
            end, high = end - 1, high - 1
            found[end] = high
        for line in range(k + 1, end):
            spots = places.get(own[line], ()) if own[line] is not None else ()
            at = bisect_left(spots, low + 1)
            if at < len(spots) and spots[at] < high:
                low = found[line] = spots[at]
    return found


def blocks(found: dict[int, int], words: list[int], least: int) -> set[int]:
    """Aligned pieces to delete.  Pieces with the same shift and at most GAP others between them are one block."""
    out: set[int] = set()
    group: list[int] = []
    for k in [*sorted(found), None]:
        if group and (k is None or k - group[-1] > GAP + 1 or found[k] - k != found[group[-1]] - group[-1]):
            if sum(words[x] for x in group) >= least:
                out.update(group)
            group = []
        if k is not None:
            group.append(k)
    return out


def _windows(hashes: list[int], words: list[int], least: int) -> Iterator[tuple[int, int]]:
    """The shortest runs of `least` words, as first piece and end."""
    end = total = 0
    for k in range(len(hashes)):
        while total < least and end < len(hashes):
            total += words[end]
            end += 1
        if total < least:
            return
        yield k, end
        total -= words[k]


def passages(own: list[int], words: list[int], other: list[int], other_words: list[int], least: int) -> set[int]:
    """Pieces of the later text to delete: blocks of the alignments, round by round, and the runs that no round has met."""
    mine, left = set(own), list(own)
    places: dict[int, list[int]] = {}
    for k, x in enumerate(other):
        if x in mine:
            places.setdefault(x, []).append(k)
    gone: set[int] = set()
    for _ in range(PASSES):
        cut = blocks(align(left, places, other), words, least)
        if not cut:
            break
        gone |= cut
        for k in cut:
            left[k] = None
    # From each piece on, and up to each piece: every piece of a longer common run stands in one of these.
    n = len(own)
    for mirrored in (False, True):
        mine_, theirs = ((own[::-1], words[::-1]), (other[::-1], other_words[::-1])) if mirrored else ((own, words), (other, other_words))
        common = None
        for k, end in _windows(*mine_, least):
            if any((n - 1 - x if mirrored else x) not in gone for x in range(k, end)) and all(x in places for x in mine_[0][k:end]):
                if common is None:
                    common = {tuple(theirs[0][a:b]) for a, b in _windows(*theirs, least)}
                if tuple(mine_[0][k:end]) in common:
                    gone.update((n - 1 - x if mirrored else x) for x in range(k, end))
    return gone


def _ranges(places: set[int]) -> list[tuple[int, int]]:
    """First and end of each run of neighbours."""
    out: list[tuple[int, int]] = []
    for x in sorted(places):
        if out and out[-1][1] == x:
            out[-1] = (out[-1][0], x + 1)
        else:
            out.append((x, x + 1))
    return out


def _aligned(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(id, of, first, own, words, other, other_words) to (id, of, cut: pieces from, until)."""
    for batch in batches:
        rows, cuts = [], []
        columns = [batch.column(k) for k in range(2, 7)]
        for k in range(batch.num_rows):
            first, *lists = (c[k].as_py() for c in columns)
            gone = passages(*lists, least)
            if gone:
                rows.append(k)
                cuts.append([{"from": first + a, "until": first + b} for a, b in _ranges(gone)])
        kind = pa.list_(pa.struct([("from", pa.int32()), ("until", pa.int32())]))
        taken = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), pa.array(cuts, kind)], names=["id", "of", "cut"])


def _key(docs_id: Column, text: Column) -> tuple[Column, Column]:
    return docs_id.cast("long"), F.xxhash64(text.cast("string"))


def line_cuts(docs: DataFrame, least: int = MIN_BLOCK_WORDS) -> DataFrame:
    """(id, of, cut) of the texts that lose pieces; id: doc_id, of: the text's hash, cut: ranges of pieces."""
    id_, of = _key(F.col("doc_id"), F.col("text"))
    own = docs.filter("doc_id is not null and text is not null").select(id_.alias("id"), of.alias("of"), F.col("text").cast("string").alias("text"))
    hashed = materialise(map_arrow(own, _hashed, "id long, of long, hashes array<long>, words array<int>"), "pieces")
    stretch = STRETCH
    runs = map_arrow(hashed, lambda it: _runs(it, least, stretch), "run long, id long, of long, first int, last int")
    # Partial sums meet first, so a run that very many documents hold is no hot key.  Written, so that the join can be split.
    first = runs.groupBy("run").agg(F.min("id").alias("owner"), F.max("id").alias("top")).filter("owner < top").select("run", "owner")
    met = materialise(runs.join(materialise(first, "owners"), "run"), "shared")
    held = met.filter("id = owner").select("run", F.col("id").alias("e_id"), F.col("of").alias("e_of"), F.col("first").alias("e_first"), F.col("last").alias("e_last")).dropDuplicates(["run", "e_id", "e_of", "e_first"])
    held = materialise(held, "held")
    # A long owner is met stretch by stretch: a document that shares its beginning and its end gets those, not all that lies between.
    linked = met.filter("id > owner").join(held, "run").groupBy("id", "of", "e_id", "e_of", F.floor(F.col("e_first") / stretch))
    pairs = linked.agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("e_first").alias("e_first"), F.max("e_last").alias("e_last"))
    pairs = materialise(pairs.select("id", "of", "e_id", "e_of", "first", "last", "e_first", "e_last"), "pairs")
    # The pieces of the documents in pairs, one row a text however often it is repeated.
    named = pairs.select("id", "of").union(pairs.select("e_id", "e_of")).distinct()
    texts = materialise(hashed.join(named, ["id", "of"]).groupBy("id", "of").agg(F.first("hashes").alias("hashes"), F.first("words").alias("words")), "texts")
    # What a common block has beyond its last run has under `least` words, so under `least` pieces.
    low = lambda a: F.greatest(F.col(a) - least, F.lit(0))
    span = lambda c, a, b: F.slice(c, low(a) + 1, F.col(b) + least - low(a))
    earlier = texts.select(F.col("id").alias("e_id"), F.col("of").alias("e_of"), F.col("hashes").alias("e_hashes"), F.col("words").alias("e_words"))
    rows = pairs.join(earlier, ["e_id", "e_of"]).select("id", "of", "first", "last", span("e_hashes", "e_first", "e_last").alias("other"), span("e_words", "e_first", "e_last").alias("other_words"))
    rows = rows.join(texts, ["id", "of"]).select("id", "of", low("first").alias("first"), span("hashes", "first", "last").alias("own"), span("words", "first", "last").alias("own_words"), "other", "other_words")
    found = map_arrow(rows, lambda it: _aligned(it, least), "id long, of long, cut array<struct<from: int, until: int>>")
    return found.groupBy("id", "of").agg(F.flatten(F.collect_list("cut")).alias("cut"))


def without_pieces(text: str, cut: list[tuple[int, int]]) -> tuple[str, int, int]:
    """text without the pieces in cut; lines that lost all their pieces, and words cut.

    A line without any piece left goes with its end; in other lines the white space after a piece goes with it
    (or that before it, at the line's end).
    """
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    starts, ends, words, lines, _ = pieces(data, np.array([0, len(raw)]))
    gone = np.zeros(len(starts) + 1, np.int64)
    for a, b in cut:
        gone[a] += 1
        gone[b] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    out, dropped = [], 0
    begin = np.searchsorted(lines, np.arange(raw.count(b"\n") + 2))
    at = 0
    for k, line in enumerate(raw.split(b"\n")):
        a, b = begin[k], begin[k + 1]
        lost = np.flatnonzero(gone[a:b]) + a
        if len(lost) and len(lost) == b - a:
            dropped += 1
        elif len(lost):
            kept, last = [], 0
            for x in lost:
                kept.append(line[last : max(last, starts[x] - at)])
                last = (starts[x + 1] if x + 1 < b else ends[x]) - at
            whole = b"".join(kept)
            out.append((whole.rstrip() if lost[-1] == b - 1 else whole) + line[last:])
        else:
            out.append(line)
        at += len(line) + 1
    return b"\n".join(out).decode("utf-8", "surrogatepass"), dropped, int(words[gone].sum())


def _rebuilt(text: pa.Array, cut: pa.Array) -> pa.Array:
    """(text, cut) to struct of text, n_cut and words_cut; null where nothing is cut."""
    rows = []
    for k in range(len(text)):
        own = text[k].as_py()
        if own is None:
            rows.append((None, 0, 0))
        else:
            rows.append(without_pieces(own, [(x["from"], x["until"]) for x in cut[k].as_py()]))
    kind = pa.struct([("text", pa.string()), ("n_cut", pa.int64()), ("words_cut", pa.int64())])
    return pa.array([dict(zip(("text", "n_cut", "words_cut"), row, strict=True)) for row in rows], kind)


def dedup_lines(docs: DataFrame, least: int = MIN_BLOCK_WORDS) -> DataFrame:
    """docs with common blocks deleted from the text of later documents, and n_lines, n_cut and words_cut (all long).

    Lines are split at \\n, pieces are compared without white space around them; blank lines match nothing.  A
    word is a run of anything but space and \\x09-\\x0D, and counts once for each WORD_BYTES bytes begun.  The
    document with the smallest doc_id keeps a shared block.  n_cut counts lines of which nothing is left.  Null
    text and null doc_id: the row is untouched.  Rows that share doc_id and text get the same result, rows that
    share the doc_id alone are not compared; repeats inside one document stay.  A text that loses all its
    pieces becomes empty.  Extra columns, whatever their names, are kept.
    """
    if not docs.columns:
        return docs
    kept = [f"c{k}" for k in range(len(docs.columns))]
    place = {name: kept[k] for k, name in enumerate(docs.columns)}
    cuts = line_cuts(docs.select("doc_id", "text"), least)
    text = F.col(place["text"]).cast("string")
    id_, of = _key(F.col(place["doc_id"]), F.col(place["text"]))
    out = docs.toDF(*kept).withColumn("own_id", id_).withColumn("own_of", of).join(cuts, (F.col("own_id") == F.col("id")) & (F.col("own_of") == F.col("of")), "left")
    # Only texts that lose something reach Python.
    rebuild = F.arrow_udf(_rebuilt, "text string, n_cut long, words_cut long")
    out = out.select(*kept, "cut", rebuild(F.when(F.col("cut").isNotNull(), text), F.col("cut")).alias("new"))
    rebuilt = F.when(F.col("cut").isNull(), text).otherwise(F.col("new.text"))
    columns = [(rebuilt if name == "text" else F.col(place[name])).alias(name) for name in docs.columns if name not in ("n_lines", "n_cut", "words_cut")]
    lines = F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    return out.select(*columns, lines.alias("n_lines"), F.coalesce("new.n_cut", F.lit(0)).cast("long").alias("n_cut"), F.coalesce("new.words_cut", F.lit(0)).cast("long").alias("words_cut"))


def without_copies(docs: DataFrame, least: int = MIN_BLOCK_WORDS) -> DataFrame:
    """dedup_lines with docs' own columns; rows that lost all their words go."""
    out = dedup_lines(docs, least)
    return out.filter((F.col("words_cut") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)
