"""Registered queries of sources and sinks: driver tables written in each format, read back by its reader, with SQL on the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annolith.functions import text
from annolith.operators import joins, order, ranking
from annolith.plans import pipelines
from annolith.plans.queries import SPECS, _evaluation, _metrics_sql, _read, _reviews, query
from annolith.plans.text_queries import _SPECS, _TRAIN, _train
from annolith.session import scratch_path, spread
from annolith.sources import images, prune, specs, tables
from annolith.sources.specs import specs_frame
from annolith.sources.versions import VersionedTable


def _lines(df: DataFrame, line: Column, name: str, **options: str) -> str:
    """Writes a text line a row; the folder's path."""
    path = scratch_path(df.sparkSession, name)
    df.select(line.alias("value")).write.options(**options).text(path)
    return path


def _documents(df: DataFrame, key: str, document: Column, name: str, ending: str = "", size: int = 500) -> str:
    """Writes JSON documents, each a file, of the rows with up to `size` neighbouring keys; document: an aggregate."""
    path = scratch_path(df.sparkSession, name) + ending
    shards = df.groupBy(F.floor(F.col(key) / size).alias("shard")).agg(document.alias("value"))
    shards.select("value", "shard").write.option("maxRecordsPerFile", 1).partitionBy("shard").text(path)
    return path


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer")


def _record(name: str) -> Column:
    """A record as JSON text: id, split, caption and a nested group."""
    groups = F.struct(F.struct(F.col("c_mktsegment").alias("main_material")).alias("intrinsic"))
    return F.to_json(F.struct(F.when(F.col("c_custkey") % 9 != 0, F.concat(F.lit(" "), F.col("c_name"))).alias(name), F.lit("val").alias("split"), F.col("c_mktsegment").alias("caption"), groups.alias("groups")))


@query("SELECT c_name AS image_id, 'val' AS split, c_mktsegment AS caption, c_mktsegment AS material FROM customer WHERE c_custkey % 9 <> 0")
def annotations_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with blank lines and rows without an id, by the dataset's kind."""
    rows = _customers(spark, sf_dir)
    path = _lines(rows, F.when(F.col("c_custkey") % 10 == 3, F.concat(_record("obj_id"), F.lit("\n \n"))).otherwise(_record("obj_id")), "annotations")
    root, _, folder = path.rpartition("/")
    specs.register_dataset("written", "annotations", folder, "", None)
    out = tables.samples(spark, specs.dataset_context("written", root))
    return out.select("image_id", "split", "caption", F.try_variant_get("record", "$.groups.intrinsic.main_material", "string").alias("material"))


@query("SELECT c_name AS image_id, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer WHERE c_custkey % 9 <> 0")
def id_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in the order of several files."""
    rows = _customers(spark, sf_dir).repartitionByRange(5, "c_custkey").sortWithinPartitions("c_custkey")
    ids = tables.id_scan(spark, _lines(rows, _record("obj_id"), "ids"))
    return order.row_index(ids, "ord").select("image_id", F.col("index").alias("place"))


@query("SELECT 'i' || n_nationkey AS image_id, 'p/' || n_name AS path, n_name AS caption, 'thing' AS primary_object FROM nation WHERE n_nationkey % 4 <> 0")
def meta_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON arrays, one a file, with items that lack an id or a path."""
    rows = _read(spark, sf_dir, "nation")
    item = F.struct(F.when(F.col("n_nationkey") % 4 != 0, F.concat(F.lit("i"), F.col("n_nationkey").cast("string"))).alias("image_id"), F.concat(F.lit("p/"), "n_name").alias("path"), F.col("n_name").alias("notes"), F.lit("thing").alias("primary_object"))
    path = _documents(rows, "n_nationkey", F.to_json(F.collect_list(item)), "meta", size=10)
    return tables.meta(spark, path).select("image_id", "path", "caption", "primary_object")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS item_id, 'i' || p_size AS main_image_id, CASE WHEN p_partkey % 3 = 1 THEN NULL ELSE p_name END AS title FROM part WHERE p_partkey % 7 <> 5""")
def listing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gzip shards with bad lines; text fields of several shapes."""
    rows = _read(spark, sf_dir, "part")
    n = F.col("p_partkey") % 3
    name = F.when(n == 0, F.to_json(F.struct(F.col("p_name").alias("x")))).when(n == 1, F.lit('{"x": []}')).otherwise(F.concat(F.lit('{"x": [{"value": "'), "p_name", F.lit('"}]}')))
    item = F.concat(F.lit('{"item_id": "'), F.col("p_partkey").cast("string"), F.lit('", "main_image_id": "i'), F.col("p_size").cast("string"), F.lit('", "item_name": '), F.regexp_extract(name, r'^\{"x": ?(.*)\}$', 1), F.lit("}"))
    path = _lines(rows, F.when(F.col("p_partkey") % 7 == 5, F.lit("{bad")).otherwise(item), "listings", compression="gzip")
    return tables.listings(spark, path).select("item_id", "main_image_id", text.pick_value(F.col("item_name")).alias("title"))


@query("SELECT 'i' || (o_custkey % 100) AS image_id, arg_max('f/' || o_orderkey, o_orderkey) AS path FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1")
def image_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gzip CSVs in which the last row of an id counts, whatever the files' sizes, and blanks don't."""
    path = scratch_path(spark, "index")
    rows = _read(spark, sf_dir, "orders").repartitionByRange(6, "o_orderkey").sortWithinPartitions("o_orderkey").select(F.concat(F.lit("i"), (F.col("o_custkey") % 100).cast("string")).alias("image_id"), F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("f/"), F.col("o_orderkey").cast("string"))).alias("path"))
    rows.write.csv(path, header=True, compression="gzip")
    return tables.image_index(spark, path)


@query("SELECT 'txt' AS kind, c_name AS image_id FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'json', n_name FROM nation")
def id_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allow-lists as lines (with blanks) and as a JSON object."""
    lines = _lines(_customers(spark, sf_dir), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), "c_name")).otherwise(" "), "allowed")
    path = _documents(_read(spark, sf_dir, "nation"), "n_nationkey", F.to_json(F.struct(F.lit("x").alias("image_ids"), F.collect_list(F.concat("n_name", F.lit(" "))).alias("ids"))), "allowed", ".json", size=10)
    pick = lambda kind, p: tables.allowed_ids(spark, p).select(F.lit(kind).alias("kind"), "image_id")
    return pick("txt", lines).union(pick("json", path))


_ROW = "c_name AS image_id, 'm' AS model, {variant} AS variant, 'k' AS property_key, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS gt_value, CAST(c_nationkey AS VARCHAR) AS pred_value"


@query(f"SELECT 'csv' AS kind, {_ROW.format(variant="'raw'")} FROM customer UNION ALL SELECT 'jsonl', {_ROW.format(variant="'default'")} FROM customer UNION ALL SELECT 'json', {_ROW.format(variant="'default'")} FROM customer")
def prediction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long predictions from CSV, JSON lines and JSON objects."""
    rows = _customers(spark, sf_dir)
    own = rows.select(F.col("c_name").alias("image_id"), F.lit("m").alias("model"), F.lit("k").alias("property_key"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("gt_value"), F.col("c_nationkey").alias("pred_value"), "c_custkey")
    base = scratch_path(spark, "predictions")
    own.drop("c_custkey").withColumns({"variant": F.lit("raw"), "gt_value": F.coalesce("gt_value", F.lit("NaN"))}).write.csv(base + ".csv", header=True)
    own.drop("c_custkey").write.json(base + ".jsonl", ignoreNullFields=False)
    names = [c for c in own.columns if c != "c_custkey"]
    objects = _documents(own, "c_custkey", F.to_json(F.struct(F.collect_list(F.struct(*names)).alias("rows")), {"ignoreNullFields": "false"}), "predictions", ".json")
    out = None
    for kind, path in (("csv", base + ".csv"), ("jsonl", base + ".jsonl"), ("json", objects)):
        part = tables.predictions(spark, path).select(F.lit(kind).alias("kind"), "*")
        out = part if out is None else out.union(part)
    return out


@query("SELECT CAST(doc_id AS VARCHAR) AS image_id, CASE quality WHEN 1 THEN 'approved' ELSE 'rejected' END AS decision, 't0' AS reviewed_at FROM labels")
def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects keyed by id, one a file."""
    rows = _read(spark, sf_dir, "labels").select("doc_id", F.col("doc_id").cast("string").alias("k"), F.struct(F.when(F.col("quality") == 1, "approved").otherwise("rejected").alias("decision"), F.lit("t0").alias("reviewed_at")).alias("v"))
    path = _documents(rows, "doc_id", F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))), "decisions")
    return tables.decisions(spark, path).select("image_id", "decision", "reviewed_at")


# ------------------------------------------------------------------ sinks


@query(_metrics_sql("model, variant, "))
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written property metrics."""
    from annolith.operators import metrics

    rows = _evaluation(spark, sf_dir)
    measured = metrics.property_metrics(rows, specs_frame(spark, SPECS), ["model", "variant"])
    root = scratch_path(spark, "report")
    tables.write_report(rows, measured, measured.groupBy("model").count(), root)
    return spark.read.schema(measured.schema).csv(f"{root}/property_metrics", header=True)


@query("SELECT o_orderstatus AS method, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'ids', CAST(count(*) AS BIGINT) FROM nation")
def table_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several tables as CSV, each under its name."""
    root = scratch_path(spark, "tables")
    counts = _read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("method")).agg(F.count("*").cast("long").alias("n"))
    tables.write_tables({"by_status": counts, "ids": _read(spark, sf_dir, "nation").agg(F.lit("ids").alias("method"), F.count("*").cast("long").alias("n"))}, root)
    read = lambda name: spark.read.schema("method string, n long").csv(f"{root}/{name}", header=True)
    return read("by_status").union(read("ids"))


@query(f"""WITH {_TRAIN}, x AS (SELECT image_id, 'toxic' AS property_key, toxic AS gt_value FROM t WHERE toxic <> 'unknown' UNION ALL SELECT image_id, 'mood', mood FROM t), v AS (SELECT image_id FROM (SELECT DISTINCT image_id FROM t) ORDER BY md5(image_id || ':42'), image_id LIMIT 20)
    SELECT CASE WHEN image_id IN (FROM v) THEN 'val' ELSE 'train' END AS part, image_id, property_key, gt_value FROM x UNION ALL SELECT 'manifest', 'train', CAST(count(*) AS VARCHAR), CAST(count(DISTINCT image_id) AS VARCHAR) FROM x WHERE image_id NOT IN (FROM v) UNION ALL SELECT 'manifest', 'val', CAST(count(*) AS VARCHAR), CAST(count(DISTINCT image_id) AS VARCHAR) FROM x WHERE image_id IN (FROM v)""")
def training_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training and validation rows written as JSON lines and read back, 20 images held out, and their manifest."""
    examples = pipelines.training_examples(_train(spark, sf_dir), _SPECS)
    ids = _read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("image_id"), F.col("doc_id").alias("ord"))
    train, val, manifest = pipelines.training_split(examples, ids, 20, shuffle=ranking.shuffled_md5)
    root = scratch_path(spark, "training")
    tables.write_json(train, f"{root}/train")
    tables.write_json(val, f"{root}/val")
    back = [tables.training_rows(spark, f"{root}/{part}").select(F.lit(part).alias("part"), "image_id", "property_key", "gt_value") for part in ("train", "val")]
    counts = manifest.select(F.lit("manifest"), "part", F.col("examples").cast("string"), F.col("images").cast("string"))
    return back[0].union(back[1]).union(counts)


@query("SELECT CAST(c_custkey AS VARCHAR) AS image_id, c_mktsegment AS caption, row_number() OVER (ORDER BY CAST(c_custkey AS VARCHAR)) - 1 AS place FROM customer")
def sorted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written in the order of their ids, and the places at which they stand in the files."""
    root = scratch_path(spark, "sorted")
    tables.write_json(_customers(spark, sf_dir).select(F.col("c_custkey").cast("string").alias("image_id"), F.col("c_mktsegment").alias("caption")), root, "image_id")
    rows = spark.read.schema("image_id string, caption string").json(root).select("image_id", "caption", tables.file_order().alias("ord"))
    return order.row_index(rows, "ord").select("image_id", "caption", F.col("index").alias("place"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS image_id, CASE c_custkey % 5 WHEN 0 THEN '/abs/r' || c_nationkey || '/p' || c_custkey || '.png' WHEN 1 THEN 'd/r' || c_nationkey || '/p' || c_custkey || '.png' WHEN 2 THEN 'd/panels/p' || c_custkey || '.png' ELSE 'd/panels/' || c_custkey || '.png' END AS path FROM customer""")
def panel_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the places where a panel may lie, the first that holds it."""
    kind, name = F.col("c_custkey") % 5, F.concat(F.lit("p"), F.col("c_custkey").cast("string"), F.lit(".png"))
    given = F.concat(F.when(kind == 0, "/abs/r").otherwise("r"), F.col("c_nationkey").cast("string"), F.lit("/"), name)
    rows = _customers(spark, sf_dir).select(F.col("c_custkey").cast("string").alias("image_id"), kind.alias("kind"), F.when(kind < 4, given).alias("panel"), name.alias("name"))
    own = F.concat(F.lit("d/panels/"), "image_id", F.lit(".png"))
    # Each kind is found at its own place; ID.png is there for all, and comes last.
    first = F.when(F.col("kind") == 0, F.col("panel")).when(F.col("kind") == 1, F.concat(F.lit("d/"), "panel")).when(F.col("kind") == 2, F.concat(F.lit("d/panels/"), "name"))
    files = rows.select(F.explode(F.array_compact(F.array(first, own))).alias("path"))
    return tables.panel_paths(rows.select("image_id", "panel"), files, "d", "d/panels").select("image_id", "path")


@query("SELECT 'row' AS kind, CAST(d.doc_id AS VARCHAR) AS image_id, CASE WHEN toxic = 1 AND lang <> '' THEN lang ELSE source END AS mask_path FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1 UNION ALL SELECT 'id', CAST(d.doc_id AS VARCHAR), NULL FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1")
def review_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved rows as JSON and their ids as lines, read back."""
    made = pipelines.review_export(*_reviews(spark, sf_dir))
    root = scratch_path(spark, "review")
    tables.write_json(made["approved"], f"{root}/meta", "review_ord")
    tables.write_ids(made["ids"].withColumn("image_id", F.col("image_id").cast("string")), f"{root}/ids")
    rows = spark.read.schema("image_id string, mask_path string").json(f"{root}/meta").select(F.lit("row").alias("kind"), "image_id", "mask_path")
    return rows.union(tables.allowed_ids(spark, f"{root}/ids").select(F.lit("id"), "image_id", F.lit(None).cast("string")))


@query("SELECT 'new' AS version, c_custkey, upper(c_name) AS c_name FROM customer UNION ALL SELECT 'old', c_custkey, c_name FROM customer")
def rewritten_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table rewritten beside its old version, which stays."""
    path = scratch_path(spark, "table")
    _customers(spark, sf_dir).select("c_custkey", "c_name").write.parquet(path)
    new = tables.rewrite(spark.read.parquet(path).withColumn("c_name", F.upper("c_name")), path)
    return spark.read.parquet(new).select(F.lit("new").alias("version"), "c_custkey", "c_name").union(spark.read.parquet(path).select(F.lit("old"), "c_custkey", "c_name"))


@query("""SELECT 0 AS version, c_custkey, c_name, c_acctbal, CAST(NULL AS VARCHAR) AS tier FROM customer UNION ALL SELECT 1, c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name || '!') ELSE c_name END, c_acctbal, CASE WHEN c_acctbal > 5000 THEN 'gold' END FROM customer
    UNION ALL SELECT 2, c_custkey, c_name, c_acctbal, NULL FROM customer""")
def versioned_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table rewritten bucket by bucket, and restored from its backup; all its versions."""
    table = VersionedTable(spark, scratch_path(spark, "versions"), "c_custkey", buckets=4)
    table.create(_customers(spark, sf_dir).select("c_custkey", "c_name", "c_acctbal"))
    table.rewrite(_upgraded)
    table.restore()
    out = None
    for number in (0, 1, 2):
        rows = table.read(number)
        rows = rows if "tier" in rows.columns else rows.withColumn("tier", F.lit(None).cast("string"))
        part = rows.select(F.lit(number).alias("version"), "c_custkey", "c_name", "c_acctbal", "tier")
        out = part if out is None else out.union(part)
    return out


def _upgraded(rows: DataFrame) -> DataFrame:
    name = F.when(F.col("c_custkey") % 3 == 0, F.upper(F.concat("c_name", F.lit("!")))).otherwise(F.col("c_name"))
    return rows.withColumns({"c_name": name, "tier": F.when(F.col("c_acctbal") > 5000, "gold")})


@query("SELECT 'dry' AS run, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE c_custkey % 3 = 0 OR c_acctbal > 5000) AS BIGINT) AS changed, CAST(1 AS BIGINT) AS versions FROM customer UNION ALL SELECT 'real', CAST(count(*) AS BIGINT), CAST(count(*) FILTER (WHERE c_custkey % 3 = 0 OR c_acctbal > 5000) AS BIGINT), 2 FROM customer")
def rewrite_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a dry run says, and what the run then does."""
    table = VersionedTable(spark, scratch_path(spark, "versions"), "c_custkey", buckets=4)
    table.create(_customers(spark, sf_dir).select("c_custkey", "c_name", "c_acctbal"))
    rows = []
    for name in ("dry", "real"):
        report = table.rewrite(_upgraded, dry_run=name == "dry")
        rows.append((name, report.rows, report.changed, len(table.entries())))
    return spark.createDataFrame(rows, "run string, rows long, changed long, versions long")


_KEPT = "c_custkey % 3 = 0 OR c_nationkey = 3"


@query(f"""WITH f AS (SELECT 'n' || c_nationkey || '/d' || c_custkey % 2 || '/m' || c_custkey || '.png' AS relative, {_KEPT} AS used FROM customer)
    SELECT relative, 'deleted' AS status FROM f WHERE NOT used UNION ALL SELECT relative, 'left' FROM f WHERE used""")
def pruned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that nothing names are deleted; what the folder then holds."""
    root = scratch_path(spark, "prune")
    relative = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("/d"), (F.col("c_custkey") % 2).cast("string"), F.lit("/m"), F.col("c_custkey").cast("string"), F.lit(".png"))
    rows = spread(_customers(spark, sf_dir).select(relative.alias("path"), "c_custkey", "c_nationkey"), "c_custkey")
    pixel = rows.select("path", F.lit(1).alias("width"), F.lit(1).alias("height"), F.lit(1).alias("channels"), F.unhex(F.lit("FF")).alias("data"))
    images.write_png(pixel, root)
    done = prune.prune(spark, root, rows.filter(_KEPT).select(F.col("path").alias("relative")))
    return done.union(prune.listed(spark, root).select("relative", F.lit("left")))


@query("SELECT 'f' || c_custkey AS path FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def unreferenced_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("f"), F.col(c).cast("string")).alias("path")
    return tables.unreferenced(_customers(spark, sf_dir).select(name("c_custkey")), _read(spark, sf_dir, "orders").select(name("o_custkey")))


@query("SELECT c_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) GROUP BY 1")
def last_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each key, for an allow-list."""
    rows = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return joins.allow_list(tables.keep_last(rows, ["c_custkey"], "o_orderkey"), _customers(spark, sf_dir).filter("c_nationkey < 5"), "c_custkey")
