"""op7 where prefixes are hard: windows of few common words, short items of every length, very long texts."""

import random
import re
import time

from annolith.llm.decontam import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = words_of(text)
        for k in range(max(len(w) - size, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(item)
    out = {}
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                owners = windows.get(tuple(w[k : k + n]))
                if owners:
                    hit |= set(range(k, k + n))
                    found |= owners
        out[doc] = (len(w), len(hit), sorted(map(str, found)))
    return out


def test_items_of_every_length(spark):
    r = random.Random(1)
    pool = ["a", "B", "É", "é", "İx", "i", "9", "zz"]
    text = lambda n: " ".join(r.choice(pool) for _ in range(n))
    docs = [(k, text(r.randrange(0, 60))) for k in range(80)] + [(100, None), (101, ""), (102, "a"), (103, "a b")]
    items = [(k, text(k % 13)) for k in range(40)] + [(50, "a"), (51, "a B"), (52, None)]
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert {x.doc_id: (x.n_words, x.n_hit, x["items"]) for x in got.collect()} == plain(docs, items)


def test_templated_windows_of_common_words(spark):
    """4,000 windows of eleven words that every document is made of."""
    r = random.Random(2)
    pool = [f"w{k}" for k in range(11)]
    docs = [(k, " ".join(r.choice(pool) for _ in range(400))) for k in range(2000)]
    own = [(k, " ".join(r.choice(pool) for _ in range(10))) for k in range(3990)]
    items = own + [(9000 + k, " ".join(docs[k * 7][1].split()[50:60])) for k in range(10)]
    began = time.monotonic()
    rows = contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert time.monotonic() - began < 60
    found = {x.doc_id: set(x["items"]) for x in rows if x.contaminated}
    assert all(str(9000 + k) in found[k * 7] for k in range(10))
    want = plain(docs[:200], items)
    assert {x.doc_id: (x.n_words, x.n_hit, x["items"]) for x in rows if x.doc_id < 200} == want


def test_a_text_of_a_million_words(spark):
    passage = "one passage of the benchmark that stands deep inside a text"
    docs = spark.range(3, numPartitions=3).selectExpr("id as doc_id", f"concat(repeat('filler words here ', 170000), case when id = 1 then '{passage} ' else '' end, repeat('more of them ', 170000)) as text")
    got = {x.doc_id: (x.n_words, x.n_hit) for x in contamination(docs, spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()}
    n = len(passage.split())
    assert got == {0: (1_020_000, 0), 1: (1_020_000 + n, n), 2: (1_020_000, 0)}
