"""Every registered corpus query on odd rows and on empty tables."""

import pyarrow as pa
import pytest

import corpus_pipeline
from annolith.llm.common import BATCH_BYTES, BATCH_KEY, map_arrow
from annolith.llm.queries import QUERIES

LONG = " ".join(f"w{k % 977} a@b{k}.com" for k in range(4000))
DOCS = [
    (1, None, None, None, None, "x"),
    (2, "", "en", "s", 0, "x"),
    (None, "hello there a@b.co", None, None, 1, "x"),
    (3, LONG, "en", "s", 1, "x"),
    (3, LONG, "en", "s", 1, "x"),
    (4, "é" * 50_000, "fr", "s", 1, "x"),
    (5, "\n" * 2000, "fr", "s", 1, None),
    (6, "a " * 20_000, "en", "s", 1, "x"),
]
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long, key string",
    "benchmark": "item_id long, text string, words int",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}
ROWS = {
    "documents": DOCS,
    "benchmark": [(1, None, 9), (2, "hello there", 9), (None, "a a", 9)],
    "labels": [(1, None, 1), (None, 1, None), (3, 1, 0), (6, 0, 1)],
    "embeddings": [(1, [0.5] * 64, 1), (1, [0.5] * 64, 1), (None, [0.25] * 64, None), (2, [0.5] * 63, 1), (3, None, 1), (4, [None] * 64, 1), (5, [float("nan")] * 64, 1)],
    "pages": [(1, None, None), (None, "http://x.net/" + "a/" * 2000, "<p>" * 5000 + "x"), (2, "", "")],
}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    odd, empty = str(tmp_path_factory.mktemp("odd")), str(tmp_path_factory.mktemp("empty"))
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(ROWS[name], schema).write.parquet(f"{odd}/{name}.parquet")
        spark.createDataFrame([], schema).write.parquet(f"{empty}/{name}.parquet")
    return odd, empty


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_and_empty(spark, folders, name):
    odd, empty = folders
    rows = QUERIES[name](spark, odd).collect()
    assert QUERIES[name](spark, empty).count() == 0
    if name == "op2_packing":
        assert {r.doc_id for r in rows} == {r[0] for r in DOCS}
    elif name == "op11_centroids":
        assert sorted(str(r.vec_id) for r in rows) == ["1", "1", "None"]
    else:
        assert len(rows) == len(ROWS["pages" if "page_id" in rows[0] else "documents"])


def test_pipeline_on_odd_and_empty(spark, folders):
    odd, empty = folders
    assert {r.doc_id for r in corpus_pipeline.run(spark, odd).collect()} == {3, 4}
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_batches_are_bounded_by_bytes(spark):
    """Long texts reach a worker a few at a time; a bound that the session sets itself stays."""
    docs = spark.range(200, numPartitions=1).selectExpr("id as doc_id", "repeat('word ', 20000) as text")
    before = spark.conf.get(BATCH_KEY, None)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    try:
        spark.conf.unset(BATCH_KEY)
        rows = [row.n for row in map_arrow(docs, sizes, "n long").collect()]
        assert sum(rows) == 200 and max(rows) * 100_000 <= BATCH_BYTES + 200_000
        spark.conf.set(BATCH_KEY, 500_000)
        rows = [row.n for row in map_arrow(docs, sizes, "n long").collect()]
        assert sum(rows) == 200 and max(rows) * 100_000 <= 700_000
        assert spark.conf.get(BATCH_KEY) == "500000"
    finally:
        spark.conf.set(BATCH_KEY, before) if before else spark.conf.unset(BATCH_KEY)
