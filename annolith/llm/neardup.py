"""Near-duplicate detection by b-bit MinHash.

One Arrow pass hashes every document's distinct word shingles, takes the minima of
BANDS x ROWS hash functions, keeps the low BITS bits of each minimum in a packed
signature and one key per band.  Documents with equal shingle sets collapse to one
class first.  Classes that share a band key are candidates; the bit count of two
signatures' difference, corrected for chance collisions, drops those that are far from
the threshold, and the rest is confirmed on the full shingle sets.

No pair list of a group is ever made: in each bucket every member is compared with one
centre, the links found merge components, and further centres are tried among what is
left.  What then remains in a bucket (pairs of different components) is compared in
bounded blocks: signatures tell the members that still matter, and these are compared on
their full sets inside the task, which only links leave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolith.llm.common import byte_class, lowered, map_arrow, materialise, mix, ngram_hash, prefix_sums, span_hash, steps, utf8, word_spans

BANDS, ROWS, BITS, SHINGLE = 40, 4, 4, 5
#: Members of a bucket in one block of the last, pairwise step, and bytes of text that a block is expected to hold at most.
BLOCK, BLOCK_BYTES = 256, 8_000_000
#: Estimates this far under the threshold are dropped unconfirmed: over 5 standard errors of BANDS * ROWS minima.
SLACK = 0.18
#: Rounds of centres at most before the pairwise step, and the pairs a bucket member that it may have to compare.
ROUNDS, PAIRS = 4, 200
SIGNATURE = BANDS * ROWS * BITS // 8


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the shingles of all documents, each document's first shingle (n + 1), and word counts."""
    data = lowered(data)
    starts, ends, first = word_spans(data, offsets, byte_class("nonspace"))
    words, counts = span_hash(prefix_sums(data), starts, ends), np.diff(first)
    grams = ngram_hash(words, size)
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = owner[: len(grams)] == owner[size - 1 :] if len(grams) else np.zeros(0, bool)
    grams, owner = grams[inside], owner[: len(grams)][inside]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.array([int(ngram_hash(words[first[i] : first[i + 1]], int(counts[i]))[0]) ^ int(counts[i]) for i in short], np.uint64)
        order = np.argsort(np.concatenate([owner, short]), kind="stable")
        grams, owner = np.concatenate([grams, mix(whole)])[order], np.concatenate([owner, short])[order]
    return grams, np.searchsorted(owner, np.arange(len(counts) + 1)), counts


def _families() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32)


def signatures(batches: Iterator[pa.RecordBatch], size: int = SHINGLE) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, n_shingles, fp, sig, bands)."""
    times, plus = _families()
    weights = (np.uint32(1) << (np.arange(2, dtype=np.uint32) * BITS)).astype(np.uint8)
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for i, j in steps(offsets):
            grams, first, _ = shingle_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
            sets = []
            for a, b in zip(first[:-1], first[1:], strict=True):
                own = np.sort(grams[a:b])
                sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) > 1 else own)
            sizes = np.array([len(x) for x in sets], np.int64)
            full = np.flatnonzero(sizes)
            distinct = np.concatenate(sets) if sets else grams
            at = np.concatenate([[0], np.cumsum(sizes[full])])[:-1]
            minima = np.empty((len(full), BANDS * ROWS), np.uint32)
            if len(full):
                low = (distinct >> np.uint64(32)).astype(np.uint32)
                for k in range(BANDS * ROWS):
                    minima[:, k] = np.minimum.reduceat(low * times[k] + plus[k], at)
                print_ = np.stack([np.add.reduceat(distinct, at), np.add.reduceat(mix(distinct ^ np.uint64(0x5851F42D4C957F2D)), at)], 1)
                keys = minima.reshape(len(full), BANDS, ROWS).astype(np.uint64)
                band = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(full), BANDS)).copy()
                for k in range(ROWS):
                    band = mix(band * np.uint64(0xD6E8FEB86659FD93) + keys[:, :, k])
                bits = (minima & np.uint32((1 << BITS) - 1)).astype(np.uint8).reshape(len(full), SIGNATURE, 2)
                packed = (bits * weights).sum(2, dtype=np.uint8)
            fp, sig, bands = [None] * (j - i), [None] * (j - i), [None] * (j - i)
            for row, k in enumerate(full):
                fp[k], sig[k], bands[k] = print_[row].tobytes(), packed[row].tobytes(), band[row].view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sizes), pa.array(fp, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "fp", "sig", "bands"])


def estimate(difference: np.ndarray) -> np.ndarray:
    """Similarity from the share of unequal b-bit minima, corrected for chance equality."""
    chance = 1.0 / (1 << BITS)
    return ((1.0 - difference) - chance) / (1.0 - chance)


def _unequal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of unequal BITS-bit cells of packed signatures (last axis: bytes)."""
    x = a ^ b
    for shift in (1, 2):
        x = x | (x >> np.uint8(shift))
    return np.bitwise_count(x & np.uint8(0x11)).sum(-1) / (BANDS * ROWS)


def near(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(a, b, sig_a, sig_b), of sizes that allow a link, to the pairs (a, b) whose estimate is near the threshold or above."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SIGNATURE) for k in (2, 3))
            kept = pa.array(estimate(_unequal(x, y)) >= threshold - SLACK)
            yield batch.select([0, 1]).filter(kept)


def _members(own: list[dict]) -> tuple[np.ndarray, ...]:
    return (*(np.array([x[name] for x in own], np.int64) for name in ("rep", "comp", "n_shingles")), np.frombuffer(b"".join(x["sig"] for x in own), np.uint8).reshape(-1, SIGNATURE))


def _likely(row: dict, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """Of two blocks of a bucket: each left member with the right members of other components that may be linked with it."""
    (ids, comps, sizes, sigs), (ids2, comps2, sizes2, sigs2) = _members(row["left"]), _members(row["right"])
    for k in range(len(ids)):
        fits = np.minimum(sizes2, sizes[k]) >= threshold * np.maximum(sizes2, sizes[k])
        other = np.flatnonzero(fits & (comps2 != comps[k]) & (ids2 > ids[k] if row["same"] else True))
        if len(other):
            other = other[estimate(_unequal(sigs[k], sigs2[other])) >= threshold - SLACK]
            if len(other):
                yield k, other


def flagged(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Two blocks of a bucket to its key and the members that may be linked with a member of another component."""
    for batch in batches:
        keys, reps = [], []
        for number in range(batch.num_rows):
            row = batch.slice(number, 1).to_pylist()[0]
            near_ = {row[side][k]["rep"] for i, other in _likely(row, threshold) for side, ks in (("left", [i]), ("right", other)) for k in ks}
            keys += [row["key"]] * len(near_)
            reps += sorted(near_)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(reps, pa.int64())], names=["key", "rep"])


def linked(batches: Iterator[pa.RecordBatch], percent: int, size: int) -> Iterator[pa.RecordBatch]:
    """Two blocks of a bucket, with texts, to links on full sets; of those that join the same components, one."""
    for batch in batches:
        a, b = [], []
        for number in range(batch.num_rows):
            row = batch.slice(number, 1).to_pylist()[0]
            sets = []
            for side in ("left", "right"):
                raw = [(x["text"] or "").encode() for x in row[side]]
                grams, first, _ = shingle_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), size)
                sets.append([np.unique(grams[i:j]) for i, j in zip(first[:-1], first[1:], strict=True)])
            cells, root = np.unique(np.concatenate(sets[1])), {x["comp"]: x["comp"] for side in ("left", "right") for x in row[side]}

            def find(x: int, root: dict[int, int] = root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            places = [np.searchsorted(cells, x) for x in sets[1]]
            for k, other in _likely(row, percent / 100):
                own = sets[0][k]
                at = np.minimum(np.searchsorted(cells, own), len(cells) - 1)
                flags = np.zeros(len(cells), np.int64)
                flags[at[cells[at] == own]] = 1
                for j in other:
                    one, two = find(row["left"][k]["comp"]), find(row["right"][j]["comp"])
                    if one != two:
                        both = int(flags[places[j]].sum())
                        if 100 * both >= percent * (len(own) + len(sets[1][j]) - both):
                            root[max(one, two)] = min(one, two)
                            a.append(min(row["left"][k]["rep"], row["right"][j]["rep"]))
                            b.append(max(row["left"][k]["rep"], row["right"][j]["rep"]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def confirmed(batches: Iterator[pa.RecordBatch], percent: int, size: int) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) to the pairs whose full sets have 100 * intersection >= percent * union."""
    last: tuple[str | None, np.ndarray | None] = (None, None)

    def shingles(text: str | None) -> np.ndarray:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        return np.unique(shingle_hashes(raw, np.array([0, len(raw)]), size)[0])

    for batch in batches:
        kept = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if last[0] is None or last[0] != x:
                last = (x, shingles(x))
            one, two = last[1], shingles(y)
            both = len(np.intersect1d(one, two, assume_unique=True)) if 100 * min(len(one), len(two)) >= percent * max(len(one), len(two)) else 0
            kept.append(both > 0 and 100 * both >= percent * (len(one) + len(two) - both))
        yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node reachable.  Min-label hooking with pointer jumping; every round is written."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a)))
    labels = materialise(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")), "labels", few=True)
    while True:
        heard = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("label").alias("heard"))
        hooked = labels.join(heard, labels.node == heard.u, "left").select("node", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        ends = labels.select(F.col("node").alias("end"), F.col("label").alias("further"))
        jumped = hooked.join(ends, hooked.label == ends.end, "left").select("node", "was", F.least("label", "further").alias("label"))
        labels = materialise(jumped, "labels", few=True)
        moved = labels.filter("label <> was").limit(1).count()
        labels = labels.drop("was")
        if not moved:
            return labels


def _confirm(likely: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """Links among candidate pairs, by the full sets."""
    own, other = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    rows = likely.join(other, "b").join(own, "a").select("a", "b", "text_a", "text_b")
    return materialise(map_arrow(rows, lambda it: confirmed(it, percent, size), "a long, b long"), "links")


def _starred(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a < b) whose sizes and bit counts allow a link."""
    left, right = (sigs.select(F.col("rep").alias(k), F.col("sig").alias(f"sig_{k}"), F.col("n_shingles").alias(f"n_{k}")) for k in ("a", "b"))
    rows = pairs.join(right, "b").join(left, "a").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return map_arrow(rows.select("a", "b", "sig_a", "sig_b"), lambda it: near(it, percent / 100), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75, shingle: int = SHINGLE) -> DataFrame:
    """Every row of docs with n_shingles, component_id and kept (one row of each component has doc_id = component_id).

    Words are runs of anything but space and \\x09-\\x0D of the text with A-Z lower-cased; a document's set holds
    its distinct shingles of `shingle` words, or its whole word sequence if that is shorter.  Null or empty text:
    n_shingles 0, a component of its own.  Null doc_id: component_id null, kept true, linked with nothing.  Rows
    that share a doc_id count as one document: it is linked with whatever any of its texts is, and all its rows
    with a text get the same component.  Other columns play no part.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = materialise(map_arrow(texts, lambda it: signatures(it, shingle), "doc_id long, n_shingles long, fp binary, sig binary, bands array<long>"), "marks")
    alive = marks.filter(F.col("doc_id").isNotNull() & F.col("fp").isNotNull())
    # Written, so that the joins by it can be split where one class holds very many rows.
    classes = materialise(alive.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    own = alive.join(classes, "fp")
    # A class is named by its first document; one that names several classes has a row for each.
    sigs = materialise(own.filter("doc_id = rep").dropDuplicates(["rep", "fp"]).select("rep", "n_shingles", "sig", "bands"), "classes")
    buckets = sigs.select("rep", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("top")).filter("a < top").select("key", "a")
    members = materialise(buckets.join(shared, "key").select("key", "rep", "a"), "members")
    tried = materialise(_starred(members.filter("a < rep").select("a", F.col("rep").alias("b")).distinct(), sigs, percent), "likely", few=True)
    links = _confirm(tried, texts, percent, shingle)
    nodes = members.select("rep").distinct()
    # Classes that share a document by its id are linked by it.
    owned = materialise(own.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("top")).filter("a < top").select("doc_id", "a"), "repeated", few=True)
    if owned.limit(1).count():
        same = materialise(own.join(owned, "doc_id").filter("rep > a").select("a", F.col("rep").alias("b")).distinct(), "same", few=True)
        links, nodes = links.union(same), nodes.union(same.select("a")).union(same.select("b")).distinct()
    nodes = _merged(materialise(nodes.select("rep", F.col("rep").alias("comp")), "nodes", few=True), links)
    for turn in range(ROUNDS + 1):
        mixed = members.select("key", "rep").join(nodes, "rep").select("key", "rep", "comp")
        parts = mixed.groupBy("key", "comp").agg(F.count("*").cast("double").alias("n"))
        split = parts.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("within")).filter("low < high")
        split = materialise(split.select("key", "low", "n", "within"), "split", few=True)
        rows, cross = split.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("within")) / 2), F.lit(0.0))).first()
        if not rows:
            break
        left = mixed.join(split, "key")
        if turn == ROUNDS or cross <= PAIRS * max(rows, 50_000):
            nodes = _merged(nodes, _pairwise(left.select("key", "rep", "comp"), sigs, texts, percent, shingle))
            break
        # The next centre of a bucket is a member outside its smallest component; it meets every member of another one.
        left = materialise(left, "left")
        centre = left.filter("comp > low").groupBy("key").agg(F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("by"), F.col("rep").alias("c"), F.col("comp").alias("own"))).alias("x")).select("key", "x.c", "x.own")
        pairs = left.join(centre, "key").filter("comp <> own").select(F.least("rep", "c").alias("a"), F.greatest("rep", "c").alias("b")).distinct()
        likely = materialise(_starred(pairs, sigs, percent).join(tried, ["a", "b"], "left_anti"), "likely", few=True)
        tried = materialise(tried.union(likely), "tried", few=True)
        nodes = _merged(nodes, _confirm(likely, texts, percent, shingle))
    found = marks.select("doc_id", "n_shingles", "fp").join(classes, "fp", "left").join(nodes.withColumnRenamed("rep", "node"), F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "rep", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _merged(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes (rep, comp) with the components that links join made one, named by the smallest."""
    a, b = (nodes.select(F.col("rep").alias(k), F.col("comp").alias(f"c_{k}")) for k in ("a", "b"))
    edges = materialise(links.join(a, "a").join(b, "b").filter("c_a <> c_b").select(F.least("c_a", "c_b").alias("a"), F.greatest("c_a", "c_b").alias("b")).distinct(), "edges", few=True)
    if not edges.limit(1).count():
        return nodes
    labels = connected_components(edges)
    return materialise(nodes.join(labels, F.col("comp") == F.col("node"), "left").select("rep", F.coalesce("label", "comp").alias("comp")), "nodes", few=True)


def _blocked(rows: DataFrame, *columns: str) -> DataFrame:
    """(key, left, right, same): every two blocks of each bucket's members; a block has about BLOCK of them, and BLOCK_BYTES of text or one text."""
    parts = F.count("*") / F.lit(float(BLOCK))
    if "text" in columns:
        parts = F.greatest(parts, F.sum(F.coalesce(F.octet_length("text"), F.lit(0))) / F.lit(float(BLOCK_BYTES)))
    sizes = rows.groupBy("key").agg(F.ceil(parts).cast("int").alias("parts"))
    cut = rows.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    packed = cut.groupBy("key", "part").agg(F.collect_list(F.struct(*columns)).alias("own"), F.first("parts").alias("parts"))
    one = packed.select("key", "part", F.col("own").alias("left"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("with"))
    two = packed.select("key", F.col("part").alias("with"), F.col("own").alias("right"))
    return one.join(two, ["key", "with"]).select("key", "left", "right", (F.col("part") == F.col("with")).alias("same"))


def _pairwise(left: DataFrame, sigs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """Links between different components of each bucket (key, rep, comp).  Signatures tell which members still
    matter (a row a member, not a pair); only those meet again with their texts, and only links leave the task."""
    rows = left.join(sigs.select("rep", "n_shingles", "sig"), "rep")
    columns = ["rep", "comp", "n_shingles", "sig"]
    matter = map_arrow(_blocked(rows, *columns), lambda it: flagged(it, percent / 100), "key long, rep long").distinct()
    matter = materialise(rows.join(matter, ["key", "rep"]), "matter")
    rows = matter.join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep")
    return materialise(map_arrow(_blocked(rows, *columns, "text"), lambda it: linked(it, percent, size), "a long, b long"), "links")


def deduplicate(docs: DataFrame, percent: int = 75, shingle: int = SHINGLE) -> DataFrame:
    """docs without the rows of a component but one (of rows that share the kept doc_id, one with the smallest hash of its text)."""
    keep = near_duplicates(docs, percent, shingle).filter("kept and doc_id is not null").select("doc_id").distinct()
    kept = docs.join(keep, "doc_id", "left_semi").select(*docs.columns)
    # Repeated ids are rare: only their rows are compared.
    repeated = materialise(kept.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min(F.xxhash64(F.col("text").cast("string"))).alias("first")).filter("rows > 1").select("doc_id", "first"), "repeated-ids", few=True)
    once = kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))
    if not repeated.limit(1).count():
        return once
    of = docs.join(repeated.withColumnsRenamed({"doc_id": "id of it", "first": "first of it"}), F.col("doc_id") == F.col("id of it"))
    chosen = of.filter(F.xxhash64(F.col("text").cast("string")) == F.col("first of it")).select(*docs.columns)
    return once.unionByName(chosen.dropDuplicates(["doc_id"]))
