"""The pipeline and the registered queries on the driver's smallest tables, against plain Python and SQL."""

import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from annolith.llm import packing
from annolith.llm.queries import ORACLE_SQL, QUERIES

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from test_corpus_ops import brute_components, brute_hits  # noqa: E402
from test_linededup import brute_line_dedup  # noqa: E402
from tests_oracle import oracle_rows, spark_rows  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SMALL)) == oracle_rows(SMALL, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_whole_table(spark, name):
    out = QUERIES[name](spark, SMALL)
    tables = {"page_id": "pages", "vec_id": "embeddings", "doc_id": "documents"}
    key = next(k for k in tables if k in out.columns)
    table = spark.read.parquet(f"{SMALL}/{tables[key]}.parquet")
    assert {r[0] for r in out.select(key).collect()} == {r[0] for r in table.select(key).collect()}


def test_pipeline_against_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in rows if any(c.isalpha() for c in r.text or "")}
    texts = {i: t for i, (t, words) in brute_line_dedup(texts).items() if not words or t.split()}
    kept = {i for i, v in brute_components(texts.items()).items() if v[2]}
    clean = {i: t for i, t in texts.items() if i in kept and not brute_hits(t, items)[-1]}
    encode = packing.Encoder(None, None)
    want = {i: [*encode.exact.encode(t or "", add_special_tokens=False).ids, 1] for i, t in clean.items()}

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        docs = out
    assert {r.doc_id: r.text for r in docs.collect()} == clean
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, SMALL).collect():
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    import zlib

    assert set(pieces) == set(want)
    for i, own in pieces.items():
        at = 0
        for start, length, crc, tokens in sorted(own):
            assert start == at and tokens == len(want[i])
            assert crc == zlib.crc32(np.array(want[i][start : start + length], "<u4").tobytes())
            at += length
        assert at == len(want[i])
