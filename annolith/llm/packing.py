"""Sequence packing by minimum bin slack.

Each partition packs its own documents in one pass, without a shuffle.  Documents are
tokenised, cut at every full sequence, and what remains of each is binned by its length.
As soon as a window of WINDOW remainders is there, bins are filled: the longest remainder
opens a bin, a subset-sum over the multiset of the other lengths, kept as one bitset per
length, finds the fill closest to the bin's slack; the counts are read back from the
bitsets and the same bin is repeated as often as the multiset allows.  Where no multiset
fills a bin, the front of another remainder does.  At a partition's end the rest of under
one sequence is split over sequences whose lengths are powers of two: they need no padding.

Everything a task holds is bounded by the window.  A retried task reads the same rows and
so writes the same sequences; sequence ids hold the partition's number in their high bits.
"""

from __future__ import annotations

import base64
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolith.llm.common import map_arrow

CAPACITY, END_ID = 2048, 1
#: Remainders that a task holds before it fills bins.
WINDOW = 8192
#: Characters for which both tokeniser libraries split alike beyond doubt; texts with others go to `tokenizers` itself.
PLAIN = re.compile("[^\t\n\r -~¡-¬®-ſ]")


def tokeniser_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids as `tokenizers` gives them for the vocabulary file.

    The same vocabulary as ranks, run by tiktoken, gives the same ids several times faster for plain texts;
    anything else (rare characters, the special token's string) is encoded by `tokenizers`.
    """

    def __init__(self, vocabulary: str | None, ranks: str | None) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(vocabulary or tokeniser_path("byte_bpe_50k.json"))
        self.special = [str(x.content) for x in self.exact.get_added_tokens_decoder().values()]
        self.fast = None
        if vocabulary is None or ranks is not None:
            import public_tokenizers

            with open(ranks or tokeniser_path("byte_bpe_50k.tiktoken"), "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is not None and not PLAIN.search(text) and not any(x in text for x in self.special):
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths with the sum closest to capacity (never above), as counts by length.

    Bit s of reach[k] is set if the first k distinct lengths, each used at most as often as it is there, can sum
    to s.  Reading back from the best sum takes as many of each length, longest first, as must be taken.
    """
    lengths = sorted((x for x in counts if x <= capacity), reverse=True)
    room, reach = (1 << (capacity + 1)) - 1, [1]
    for x in lengths:
        bits, left, step = reach[-1], min(counts[x], capacity // x), 1
        while left:  # counts by powers of two
            take = min(step, left)
            bits |= (bits << (x * take)) & room
            left -= take
            step *= 2
        reach.append(bits)
        if bits >> capacity & 1:
            break
    best, chosen = reach[-1].bit_length() - 1, {}
    for k in range(len(reach) - 1, 0, -1):
        x, used = lengths[k - 1], 0
        while not reach[k - 1] >> best & 1:
            best -= x
            used += 1
        if used:
            chosen[x] = used
    return chosen


class Piece:
    """Ids of one document from `start` on, not yet placed."""

    __slots__ = ("doc_id", "ids", "start", "tokens")

    def __init__(self, doc_id: object, ids: np.ndarray, start: int, tokens: int) -> None:
        self.doc_id, self.ids, self.start, self.tokens = doc_id, ids, start, tokens

    def cut(self, length: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.ids[:length], self.start, self.tokens), Piece(self.doc_id, self.ids[length:], self.start + length, self.tokens)


class Packer:
    """Packs pieces; out lists (piece, sequence, offset)."""

    def __init__(self, capacity: int, base: int) -> None:
        self.capacity, self.next, self.held, self.tokens, self.out = capacity, base, 0, 0, []
        self.waiting: dict[int, list[Piece]] = defaultdict(list)

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.capacity
        for start in range(0, whole, self.capacity):
            self._sequence([Piece(doc_id, ids[start : start + self.capacity], start, len(ids))])
        if len(ids) > whole:
            self._wait(Piece(doc_id, ids[whole:].copy(), whole, len(ids)))

    def _wait(self, piece: Piece) -> None:
        self.waiting[len(piece.ids)].append(piece)
        self.held += 1
        self.tokens += len(piece.ids)

    def _take(self, length: int) -> Piece:
        piece = self.waiting[length].pop()
        if not self.waiting[length]:
            del self.waiting[length]
        self.held -= 1
        self.tokens -= length
        return piece

    def _sequence(self, pieces: list[Piece]) -> None:
        at = 0
        for piece in pieces:
            self.out.append((piece, self.next, at))
            at += len(piece.ids)
        self.next += 1

    def pack(self, keep: int) -> None:
        """Fill sequences while more than keep remainders wait and one can be filled."""
        while self.held > keep and self.tokens >= self.capacity:
            longest = max(self.waiting)
            counts = {x: len(own) - (x == longest) for x, own in self.waiting.items()}
            chosen = fill({x: n for x, n in counts.items() if n}, self.capacity - longest)
            chosen[longest] = chosen.get(longest, 0) + 1
            slack = self.capacity - sum(x * n for x, n in chosen.items())
            times = 1 if slack else min(len(self.waiting[x]) // n for x, n in chosen.items())
            for _ in range(times):
                pieces = [self._take(x) for x, n in chosen.items() for _ in range(n)]
                while slack:  # no multiset fills it: the front of another remainder does
                    other = min((x for x in self.waiting if x >= slack), default=0) or max(self.waiting)
                    front, back = self._take(other).cut(min(other, slack))
                    pieces.append(front)
                    slack -= len(front.ids)
                    if len(back.ids):
                        self._wait(back)
                self._sequence(pieces)

    def finish(self) -> None:
        """What is left after the last full sequence: sequences whose lengths are the powers of two of its sum."""
        self.pack(0)
        rest = [piece for x in sorted(self.waiting, reverse=True) for piece in self.waiting[x]][::-1]
        self.waiting, self.held, left = defaultdict(list), 0, self.tokens
        self.tokens = 0
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            pieces = []
            while room:
                front, back = rest.pop().cut(room)
                pieces.append(front)
                room -= len(front.ids)
                if len(back.ids):
                    rest.append(back)
            self._sequence(pieces)


def _packed(batches: Iterator[pa.RecordBatch], capacity: int, vocabulary: str | None, ranks: str | None, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder, packer = Encoder(vocabulary, ranks), Packer(capacity, TaskContext.get().partitionId() << 40)
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def flush(at_least: int) -> Iterator[pa.RecordBatch]:
        if len(packer.out) >= at_least:
            rows, packer.out = packer.out, []
            columns = [[p.doc_id for p, *_ in rows], [p.start for p, *_ in rows], [len(p.ids) for p, *_ in rows], [p.ids.tobytes() for p, *_ in rows], [p.tokens for p, *_ in rows], [q for _, q, _ in rows], [o for *_, o in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if name == "ids" else pa.int64()) for name, x in zip(names, columns, strict=True)], names=names)

    for batch in batches:
        keys, texts = batch.column(0), batch.column(1)
        for k in range(batch.num_rows):
            packer.add(keys[k].as_py(), np.array([*encoder(texts[k].as_py() or ""), end_id], "<u4"))
            if packer.held >= WINDOW:
                packer.pack(WINDOW // 2)
            yield from flush(2000)
    packer.finish()
    yield from flush(1)


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, ranks: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces of sequences of at most capacity tokens: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ids: the piece's token ids as little-endian unsigned 32-bit numbers.  A document's tokens are its text's ids
    and end_id; null and empty texts have end_id alone.  Rows are packed one by one, so repeated rows and null
    doc_ids are packed like any others; an empty table gives no pieces.  Every sequence is full or has a power
    of two of tokens.  Other columns are ignored.  vocabulary: a `tokenizers` file, ranks: the same as tiktoken
    ranks (optional, for speed); by default those of the public tokenisers package.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(own, lambda it: _packed(it, capacity, vocabulary, ranks, end_id), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
