"""op9: scores and slopes against plain versions, and steps without any feature."""

import math
import re

import numpy as np
import pytest

from annolith.llm import toxicity
from annolith.llm.common import mix, prefix_sums, span_hash

TEXTS = ["Bad words here. All is fine!\nVERY bad", "fine", "", "?!.", None, "bad bad bad. é bad", "a " * 50 + "."]


def cells_of(word: str) -> list[int]:
    data = np.frombuffer(word.lower().encode(), np.uint8)
    sums, room = prefix_sums(data), np.uint64(toxicity.SPACE - 1)
    hashed = lambda n: span_hash(sums, np.array([0]), np.array([n]))[0]
    found = [int(hashed(len(data)) & room)]
    return found + [int(mix(np.array([hashed(n) + np.uint64(n)]))[0] & room) for n in toxicity.PREFIXES if len(data) >= n]


def plain_score(text: str | None, weights: dict[int, float], bias: float) -> float:
    none = 1.0
    for sentence in re.split(r"[.!?\n]", text or ""):
        words = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", sentence)
        if words:
            none *= 1 - 1 / (1 + math.exp(-(bias + sum(weights.get(c, 0.0) for w in words for c in cells_of(w)))))
    return 1 - none


def test_scores_from_given_weights(spark):
    chosen = sorted({cells_of("bad")[0], cells_of("fine")[0], cells_of("very")[0], cells_of("words")[-1]})
    values = np.linspace(-1.5, 2.5, len(chosen)).astype(np.float32)
    model = (np.array(chosen, np.int64), values, -1.0)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for k, text in enumerate(TEXTS):
        assert got[k] == pytest.approx(plain_score(text, dict(zip(chosen, values.tolist(), strict=True)), -1.0), abs=1e-6)


def test_gradient_against_differences():
    r = np.random.default_rng(0)
    labels, plain = np.array([1, 0, 1, 0]), np.array([0, 2, 1, 0])
    doc = np.array([0, 0, 1, 2, 3])
    sentence, feature = np.array([0, 0, 1, 2, 3, 3, 4]), np.array([0, 1, 2, 1, 0, 3, 2])
    decay, at = 0.01, r.normal(size=5)

    def loss(x):
        total = 0.0
        for d in range(4):
            s = plain[d] * math.log1p(math.exp(x[4]))
            for k in np.flatnonzero(doc == d):
                s += math.log1p(math.exp(x[4] + sum(x[f] for f in feature[sentence == k])))
            total += -math.log(1 - math.exp(-s)) if labels[d] else s
        return total / 4 + decay * float(x[:4] @ x[:4]) / 20

    slope = toxicity.gradient(at[:4], at[4], labels, plain, doc, sentence, feature, decay)
    for k in range(5):
        step = np.eye(5)[k] * 1e-6
        assert slope[k] == pytest.approx((loss(at + step) - loss(at - step)) / 2e-6, abs=1e-6)


def test_fit_where_a_step_has_no_chosen_feature(spark):
    """Labelled texts without words, each in a step of its own."""
    rows = [(k, "awful stuff here. fine words" if k % 2 else "fine words only") for k in range(40)] + [(k, "" if k % 2 else None) for k in range(40, 60)]
    labels = spark.createDataFrame([(k, int(k % 2 and k < 40)) for k in range(60)], "doc_id long, toxic int")
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(60, "doc_id"), labels)
    assert len(model[0]) and np.isfinite(model[2])
