"""op11 to op13 against plain versions."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolith.llm import centroids, merkle, neighbours
from annolith.llm.common import crc_fold, utf8
from annolith.llm.queries import op12_neighbours

# ------------------------------------------------------------------ centroids


def plain_clusters(rows, clusters, rounds, width):
    kept = []
    for vec_id, vector in rows:
        if vector is not None and len(vector) == width and all(v is not None and np.isfinite(v) for v in vector):
            kept.append((vec_id, [int(np.floor(centroids.SCALE * float(v))) for v in vector]))
    name = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    middle = [x for _, x in sorted(kept, key=lambda r: (r[0] is None, name(r[0]), r[1]))[:clusters]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    nearest = lambda x: min(range(len(middle)), key=lambda j: (far(x, middle[j]), j))
    for _ in range(rounds):
        at = [nearest(x) for _, x in kept]
        for j in set(at):
            own = [x for (_, x), k in zip(kept, at, strict=True) if k == j]
            middle[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = [(i, nearest(x), far(x, middle[nearest(x)])) for i, x in kept]
    total = sum(d for *_, d in out)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return sorted(((str(i), j, d, sum(e for _, k, e in out if k == j), total, digest[j]) for i, j, d in out))


@pytest.mark.parametrize("seed,spread", [(0, 0.2), (1, 3.0), (2, 0.0)])
def test_clusters_against_plain_rounds(spark, seed, spread):
    r = np.random.default_rng(seed)
    middles = r.normal(0, spread, (5, 6))
    rows = [(k, [float(v) for v in (middles[k % 5] + r.normal(0, 0.3, 6)).round(2)]) for k in range(150)]
    rows += [(k, [1.0, -0.5, 0.25, 0.0, 2.0, -1.0]) for k in range(200, 240)]  # repeated vectors, ties
    rows += [rows[3], rows[3], (None, [0.5] * 6), (None, None), (300, None), (301, [1.0]), (302, [None] * 6), (303, [float("nan")] * 6), (304, [float("inf")] + [0.0] * 5), (305, [])]
    frame = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<double>, x string, cluster int").repartition(5)
    for k in (4, 1):
        got = centroids.cluster(frame, clusters=k, width=6)
        assert sorted((str(a), *rest) for a, *rest in got.drop("scans").collect()) == plain_clusters(rows, k, 3, 6)


def test_clusters_of_few_and_none(spark):
    few = spark.createDataFrame([(1, [0.1, 0.2]), (2, [5.0, 5.0])], "vec_id long, embedding array<float>")
    assert {(r.vec_id, r.distance) for r in centroids.cluster(few, width=2).collect()} == {(1, 0), (2, 0)}
    none = centroids.cluster(few.filter("vec_id > 9"), width=2)
    assert none.collect() == [] and none.columns == centroids.cluster(few, width=2).columns
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert [r.distance >= 0 for r in centroids.cluster(huge, clusters=1, width=2).collect()] == [True] * 3


def test_bounds_save_scans_and_change_nothing():
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(900 * k, 20, (300, 8)) for k in range(4)]).astype(np.int64)
    state = [np.zeros(len(x), np.int64), np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x), np.int32)]
    now, before = x[::300].copy(), None
    for _ in range(4):
        centroids.assign(x, *state, now, before)
        best, first, second = centroids.scan(x, now)
        assert (state[0] == best).all()
        assert (state[1] * (1 + 1e-9) >= np.sqrt(first)).all() and (state[2] * (1 - 1e-9) <= np.sqrt(second) + 1e-6).all()
        before, now = now, np.array([x[state[0] == k].sum(0) // (state[0] == k).sum() for k in range(4)])
    assert (state[3] == 1).mean() > 0.95


# ------------------------------------------------------------------ neighbours


def test_cells_are_those_of_plain_counting():
    texts = ["", "ab", "abc abc abc\tx", "é ü é", " \n", "Zz! " * 40]
    import pyarrow as pa

    found = neighbours.matrix(*utf8(pa.array(texts)))
    for text, row in zip(texts, found, strict=True):
        words = text.split()
        assert row[: neighbours.TRIGRAMS].sum() == max(len(text.encode()) - 2, 0)
        assert row[neighbours.TRIGRAMS : -2].sum() == len(words)
        stutter = sum(a == b for a, b in zip(words, words[1:], strict=False))
        assert row[-2] == pytest.approx(100 * stutter / max(len(words), 1)) and row[-1] == pytest.approx(100 * (len(words) - len(set(words))) / max(len(words), 1))


def test_axes_are_singular_vectors():
    x = np.random.default_rng(0).normal(size=(60, 90)).astype(np.float32) @ np.diag(0.9 ** np.arange(90)).astype(np.float32)
    own, true = neighbours.axes(x, 5, rounds=20), np.linalg.svd(x, full_matrices=False)[2][:5].T
    assert np.abs(np.abs((own * true).sum(0)) - 1).max() < 1e-3


def test_vote_against_plain_neighbours():
    r = np.random.default_rng(3)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    model = neighbours.Model(np.ones(1), np.ones((1, 4)), unit(r.normal(size=(50, 4))), r.integers(0, 2, 50), r.uniform(1, 3, 50), 0.4)
    own = np.vstack([unit(r.normal(size=(20, 4))), np.zeros(4)])
    got = neighbours.vote(own, model, nearest=5, power=3)
    for row, score in zip(own, got, strict=True):
        near = sorted(((max(float(row @ v), 0), k) for k, v in enumerate(model.vectors)), reverse=True)[:5]
        weights = [(c**3 * model.stands_for[k], model.labels[k]) for c, k in near]
        assert score == pytest.approx((sum(w * y for w, y in weights) + 0.4e-3) / (sum(w for w, _ in weights) + 1e-3))


def test_quality_of_held_out_documents(spark):
    """Over nine of ten bad documents are found, at most one good one of a hundred is lost."""
    folder = "/root/testdata/sf0.1"
    rows = op12_neighbours(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out")
    seen = {(r.quality, r.predicted): r.n for r in rows.groupBy("quality", "predicted").agg(F.count("*").alias("n")).collect()}
    assert seen.get((1, 0), 0) <= 0.01 * seen[1, 1] and seen[0, 0] >= 9 * seen.get((0, 1), 0)


def test_labels_of_one_kind_or_none(spark, small, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in neighbours.score(small, neighbours.fit(small, none)).collect()} == {0.5}
    one = spark.createDataFrame([(0, 1), (10, 1), (10, None), (None, 0), (12, 7)], "doc_id long, quality int")
    scores = [r.score for r in neighbours.score(small, neighbours.fit(small, one)).collect()]
    assert len(scores) == small.count() and set(scores) == {1.0}
    assert neighbours.score(nothing, neighbours.fit(nothing, one)).count() == 0


def test_held_out_texts_and_labels_leave_the_scores_alone(spark, small):
    """The label of a held-out document is not read."""
    labels = spark.createDataFrame([(k, k % 2) for k in range(14)], "doc_id long, quality int")
    train = crc_fold(F.col("doc_id"), 5) != 0
    turned = labels.withColumn("quality", F.when(train, F.col("quality")).otherwise(1 - F.col("quality")))
    a, b = ([tuple(r) for r in neighbours.score(small, neighbours.fit(small, x.filter(train))).orderBy("doc_id", "score").collect()] for x in (labels, turned))
    assert a == b


# ------------------------------------------------------------------ merkle

digest = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain_leaf(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """Root and each leaf's path of (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 16 * 16 : k // 16 * 16 + 16]
            paths[i].append(("".join(run[: k % 16]), "".join(run[k % 16 + 1 :])))
            at[i] = k // 16
        nodes = [digest("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
    return nodes[0], paths


def plain_manifest(rows):
    by = {}
    for doc_id, source, lang, n_chars, text in rows:
        low = text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        chosen = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        own = plain_leaf((doc_id, source, lang, n_chars, text))
        by.setdefault(source, []).append((doc_id is not None, doc_id or 0, own, plain_leaf((doc_id, source, lang, n_chars, low)) if chosen else own, doc_id))
    sources, tops = sorted(by, key=lambda s: (s is not None, (s or "").encode())), []
    trees = {s: plain_tree([x[2] for x in sorted(by[s])]) for s in sources}
    root, upper = plain_tree([trees[s][0] for s in sources])
    for s, above in zip(sources, upper, strict=True):
        for (_, _, own, other, doc_id), path in zip(sorted(by[s]), trees[s][1], strict=True):
            node = other
            for left, right in path + above:
                node = digest(left + node + right)
            tops.append((str(doc_id), own, trees[s][0], root, digest("".join(a + b for a, b in path + above)), node, node == root))
    return sorted(tops)


def manifest_rows(frame, **options):
    return sorted((str(a), *rest) for a, *rest in merkle.manifest(frame, **options).collect())


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_against_plain_trees(spark, levels):
    """Sources of 1, 15, 16, 17, 256, 257 and more rows over many partitions; with small blocks the tiers are many."""
    sizes = {"a": 1, "b": 15, "c": 16, "d": 17, "é": 256, "Z": 257, None: 300, "": 4}
    rows, n = [], 0
    for source, size in sizes.items():
        for _ in range(size):
            rows.append((None if n % 97 == 0 else n * 7919 % 1009, source, None if n % 5 == 0 else "en", None if n % 11 == 0 else n, None if n % 13 == 0 else f"Text {n} É\n" * (n % 4)))
            n += 1
    rows += [rows[5], rows[5], (rows[5][0], rows[5][1], "fr", 1, "X")]
    frame = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, place int, id int, grp string").repartition(7)
    assert manifest_rows(frame, levels=levels) == plain_manifest(rows)


def test_manifest_of_many_sources(spark):
    rows = [(k, f"s{k % 290}", "en", k, f"T{k}") for k in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert manifest_rows(frame, levels=1) == plain_manifest(rows) == manifest_rows(frame)


def test_manifest_of_one_and_none(spark, nothing):
    assert merkle.manifest(nothing).count() == 0
    one = [(1, "s", None, None, "A" * 300_000)]
    got = manifest_rows(spark.createDataFrame(one, "doc_id long, source string, lang string, n_chars long, text string"))
    assert got == plain_manifest(one) and got[0][1] == got[0][2] == got[0][3]
