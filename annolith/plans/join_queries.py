"""Registered queries of joins, merges, measures, masks, selection and inference, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolith.functions import masks, text
from annolith.operators import inference, joins, kg, metrics, order, ranking
from annolith.plans import pipelines
from annolith.plans.queries import _BUNDLE, LABELS, PRIORS, SPECS, _bundle_rows, _evaluation, _pct, _read, query
from annolith.sources import tables
from annolith.sources.specs import PropertySpec, specs_frame

# ------------------------------------------------------------------ evaluation rows

_TWO = [PropertySpec("line.flag", "line", "flag", "categorical", LABELS), PropertySpec("line.tags", "line", "tags", "multi_categorical", ("a", "b"))]
_MAPS = """m AS (SELECT o_orderkey AS image_id, CASE o_orderstatus WHEN 'F' THEN 'a' WHEN 'O' THEN 'r' ELSE 'unknown' END AS flag_gt, CASE WHEN o_totalprice < 100000 THEN 'a' WHEN o_totalprice < 300000 THEN 'r' ELSE 'unknown' END AS flag_pred,
    CASE WHEN o_custkey % 2 = 0 THEN '["a"]' ELSE '[]' END AS tags_gt, CASE WHEN o_custkey % 3 = 0 THEN '["a"]' ELSE '[]' END AS tags_pred FROM orders),
    e AS (SELECT image_id, 'line.flag' AS property_key, 0 AS ord, flag_gt AS gt, flag_pred AS pred FROM m UNION ALL SELECT image_id, 'line.tags', 1, tags_gt, tags_pred FROM m),
    ev2 AS (SELECT *, gt NOT IN ('unknown', '[]') AS gt_known, pred NOT IN ('unknown', '[]') AS pred_known, gt NOT IN ('unknown', '[]') AND pred IN ('unknown', '[]') AS missed_when_gt_known, gt NOT IN ('unknown', '[]') AND gt = pred AS exact_match FROM e)"""


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with maps of truth and prediction; what is unknown is NULL in the truth."""
    rows = _read(spark, sf_dir, "orders")
    flag = F.when(F.col("o_orderstatus") == "F", "a").when(F.col("o_orderstatus") == "O", "r")
    said = F.when(F.col("o_totalprice") < 100000, "a").when(F.col("o_totalprice") < 300000, "r").otherwise("unknown")
    pairs = lambda one, two: F.map_from_arrays(F.array(F.lit("line.flag"), F.lit("line.tags")), F.array(one, two))
    gt = pairs(flag, F.when(F.col("o_custkey") % 2 == 0, '["a"]'))
    pred = pairs(said, F.when(F.col("o_custkey") % 3 == 0, '["a"]').otherwise("[]"))
    return rows.select(F.col("o_orderkey").alias("image_id"), gt.alias("gt"), pred.alias("pred"))


@query(f"WITH {_MAPS} SELECT * FROM ev2")
def long_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.long_evaluation(_mapped(spark, sf_dir), specs_frame(spark, _TWO))


_PARTS = ["gt", "pred", "gt_known", "pred_known", "missed_when_gt_known", "exact_match"]


@query(f"WITH {_MAPS} SELECT a.image_id, " + ", ".join(f"{side}.{p} AS line__{name}_{p}" for side, name in (("a", "flag"), ("b", "tags")) for p in _PARTS) + " FROM ev2 a JOIN ev2 b ON a.image_id = b.image_id WHERE a.ord = 0 AND b.ord = 1")
def wide_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six columns a property, named by its key."""
    return joins.wide_evaluation(joins.long_evaluation(_mapped(spark, sf_dir), specs_frame(spark, _TWO)), ["image_id"], [s.key for s in _TWO])


@query(f"WITH {_MAPS} SELECT image_id, property_key, gt AS gt_value, pred AS pred_value FROM ev2")
def narrow_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.narrow_evaluation(wide_evaluation(spark, sf_dir), ["image_id"], [s.key for s in _TWO])


@query("SELECT doc_id, array_to_string(CASE WHEN len(k) > 0 THEN k ELSE ['lang', 'mood'] END, ',') AS keys FROM (SELECT doc_id, list_filter([CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality = 1 THEN 'quality' END], lambda x: x IS NOT NULL) AS k FROM labels)")
def requested_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.array_compact(F.array(F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 1, "quality")))
    every = F.array(*map(F.lit, ("lang", "mood", "toxic", "quality")))
    return _read(spark, sf_dir, "labels").select("doc_id", F.array_join(joins.requested_keys(known, every, 2), ",").alias("keys"))


@query(f"""WITH ev AS (SELECT 'm' || CAST(l_suppkey % 3 AS VARCHAR) AS model, lower(l_linestatus) AS variant, CASE WHEN l_quantity < 40 THEN 'a' ELSE 'unknown' END AS pred FROM lineitem)
    SELECT variant, {_pct("count(*) FILTER (WHERE pred <> 'unknown')", "count(*)")} AS coverage_pct, CAST(count(*) AS BIGINT) AS total FROM ev GROUP BY 1""")
def union_of_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics measured a variant at a time, put together."""
    rows, parts = _evaluation(spark, sf_dir), []
    for variant in ("f", "o"):
        measured = metrics.property_metrics(rows.filter(F.col("variant") == variant), specs_frame(spark, SPECS))
        parts.append(measured.select(F.lit(variant).alias("variant"), "coverage_pct", (F.col("pred_yes_count") + F.col("pred_no_count")).alias("total")))
    return joins.union_variants(*parts)


@query("SELECT * FROM (VALUES ('raw', CAST(0 AS INT)), ('mask_overlay', 1), ('masked', 2)) AS t(variant, ord) WHERE ord = 0 OR (SELECT count(*) FROM customer WHERE c_custkey % 7 = 0) > 0")
def variants_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _read(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 7 == 0, F.col("c_name")).otherwise("").alias("mask_path"))
    return joins.variants_frame(samples, ["masked", "raw", "mask_overlay", "other"])


# ------------------------------------------------------------------ merges


@query("""SELECT c_custkey AS image_id, CASE WHEN c_custkey % 3 = 0 THEN 'new' || c_custkey ELSE 'old' END AS mask_path, CASE WHEN c_custkey % 3 = 0 THEN 'ok' WHEN c_custkey % 3 = 1 THEN 'failed' ELSE 'none' END AS seg_status,
    CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS seg_score, 'keep' AS note FROM customer""")
def merged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata updated by results; a failure changes the status alone."""
    rows = _read(spark, sf_dir, "customer").withColumn("image_id", F.col("c_custkey"))
    meta = rows.select("image_id", F.lit("old").alias("mask_path"), F.lit("none").alias("seg_status"), F.lit("keep").alias("note"))
    good = F.col("c_custkey") % 3 == 0
    results = rows.filter("c_custkey % 3 < 2").select("image_id", F.when(good, F.concat(F.lit("new"), F.col("c_custkey").cast("string"))).alias("mask_path"), F.when(good, "ok").otherwise("failed").alias("seg_status"), F.when(good, F.col("c_acctbal")).alias("seg_score"))
    return joins.merge_results(meta, results)


@query("SELECT c_custkey AS image_id, 'old' AS mask_path, CASE WHEN c_custkey % 3 = 0 THEN 'new' END AS mask_path_hint FROM customer")
def merged_with_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "customer").withColumn("image_id", F.col("c_custkey"))
    suffix = text.field_suffix("hint")
    return joins.merge_results(rows.select("image_id", F.lit("old").alias("mask_path")), rows.filter("c_custkey % 3 = 0").select("image_id", F.lit("new").alias("mask_path")), suffix)


@query("""WITH meta AS (SELECT c_name AS meta_key, c_custkey FROM customer WHERE c_custkey % 2 = 0), f AS (SELECT 'd/' || c_name AS path, c_name AS one, 'Customer#' || lpad(CAST(c_custkey // 2 AS VARCHAR), 9, '0') AS two FROM customer)
    SELECT path, coalesce(a.meta_key, b.meta_key) AS meta_key, coalesce(a.c_custkey, b.c_custkey) AS c_custkey FROM f LEFT JOIN meta a ON a.meta_key = one LEFT JOIN meta b ON b.meta_key = two""")
def meta_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with the first of two candidate keys that the metadata has."""
    rows = _read(spark, sf_dir, "customer")
    two = F.concat(F.lit("Customer#"), F.lpad(F.floor(F.col("c_custkey") / 2).cast("string"), 9, "0"))
    files = rows.select(F.concat(F.lit("d/"), "c_name").alias("path"), F.array("c_name", two).alias("keys"))
    meta = rows.filter("c_custkey % 2 = 0").select(F.col("c_name").alias("meta_key"), "c_custkey")
    return joins.meta_by_path(files, meta, F.col("keys")).select("path", "meta_key", "c_custkey")


_VIEWS = "v AS (SELECT c_custkey AS image_id, 0 AS view, 'mask_path' AS mask_field, 'm' || c_custkey % 40 AS mask_path, 'p' || c_custkey % 50 AS preview_path, 'sam' AS mask_source FROM customer UNION ALL SELECT c_custkey, 1, 'mask_path_hint', 'h' || c_custkey % 30, 'p' || c_custkey % 60, NULL FROM customer)"


@query(f"""WITH {_VIEWS}, files AS (SELECT DISTINCT x || (n_nationkey) AS path FROM nation, (VALUES ('m'), ('h'), ('p')) AS t(x))
    SELECT image_id, view, mask_field, mask_path, CASE WHEN preview_path IN (SELECT path FROM files) THEN preview_path ELSE mask_path END AS preview_path, mask_source FROM v WHERE mask_path IN (SELECT path FROM files)""")
def mask_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masks of each image that exist, with their previews."""
    key = F.col("c_custkey")
    name = lambda x, n: F.concat(F.lit(x), (key % n).cast("string"))
    meta = _read(spark, sf_dir, "customer").select(key.alias("image_id"), name("m", 40).alias(text.field_choice("masks", text.MASK_FIELDS)), name("p", 50).alias(text.preview_field("mask_path")), F.lit("sam").alias("mask_source"), name("h", 30).alias(text.field_choice("masks_hint", text.MASK_FIELDS)), name("p", 60).alias(text.preview_field("mask_path_hint")))
    files = _read(spark, sf_dir, "nation").select(F.explode(F.array(*(F.concat(F.lit(x), F.col("n_nationkey").cast("string")) for x in ("m", "h", "p")))).alias("path"))
    return joins.mask_views(meta, files)


@query("SELECT c_custkey AS image_id, CASE WHEN c_custkey % 5 = 0 THEN 'sam:x' WHEN c_custkey % 5 = 1 THEN 'seg' END AS mask_source FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
def pending_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images without a refined mask and without an output."""
    key = F.col("c_custkey")
    meta = _read(spark, sf_dir, "customer").select(key.alias("image_id"), F.when(key % 5 == 0, "sam:x").when(key % 5 == 1, "seg").alias("mask_source"))
    return joins.pending(meta, _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("image_id")))


@query("""WITH w AS (SELECT c_custkey AS image_id, 'a/' || c_custkey AS stem FROM customer), f AS (SELECT 'a/' || o_custkey || (['.png', '.jpg', '.gif'])[1 + CAST(o_orderkey % 3 AS INT)] AS path FROM orders UNION SELECT c_custkey || '.bmp' FROM customer WHERE c_custkey % 4 = 0),
    c AS (SELECT image_id, e.rank, CASE WHEN e.rank < 6 THEN stem || e.ending ELSE substr(stem, 3) || e.ending END AS path FROM w, (SELECT k AS rank, (['.png', '.jpg', '.jpeg', '.bmp', '.tif', '.tiff'])[1 + k % 6] AS ending FROM range(12) AS t(k)) e)
    SELECT image_id, arg_min(c.path, rank) AS path FROM c JOIN f ON c.path = f.path GROUP BY 1""")
def mask_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the names that a mask may have, the first that is there."""
    wanted = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("image_id"), F.concat(F.lit("a/"), F.col("c_custkey").cast("string"), F.lit(".webp")).alias("relative"))
    orders = _read(spark, sf_dir, "orders")
    ending = F.array(*map(F.lit, (".png", ".jpg", ".gif")))[(F.col("o_orderkey") % 3).cast("int")]
    files = orders.select(F.concat(F.lit("a/"), F.col("o_custkey").cast("string"), ending).alias("path")).union(_read(spark, sf_dir, "customer").filter("c_custkey % 4 = 0").select(F.concat(F.col("c_custkey").cast("string"), F.lit(".bmp"))))
    return tables.first_existing(wanted, tables.mask_candidates(F.col("relative")), files)


@query("""SELECT 'f' || c_custkey AS path, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'exists' WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') THEN 'copied_local' WHEN c_custkey % 2 = 0 THEN 'downloaded' ELSE 'download_failed' END AS status FROM customer""")
def image_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = lambda c: F.concat(F.lit("f"), F.col(c).cast("string")).alias("path")
    wanted, orders = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "orders")
    return tables.materialisation(wanted.select(path("c_custkey")), orders.filter("o_orderstatus = 'F'").select(path("o_custkey")), orders.filter("o_orderstatus = 'O'").select(path("o_custkey")), wanted.filter("c_custkey % 2 = 0").select(path("c_custkey")))


# ------------------------------------------------------------------ measures


@query("SELECT round_even(avg(l_discount), 6) AS mean, min(l_discount) AS min, max(l_discount) AS max FROM lineitem")
def score_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.spread(_read(spark, sf_dir, "lineitem"), "l_discount")


@query("SELECT o_orderstatus AS status, CAST(count(*) AS BIGINT) AS n, round_even(avg(o_totalprice), 6) AS mean_o_totalprice FROM orders GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders").withColumn("status", F.col("o_orderstatus"))
    return metrics.status_summary(rows, ["o_totalprice"])


@query("SELECT CAST(count(*) AS BIGINT) AS processed, CAST(count(*) FILTER (WHERE c_custkey % 4 = 1) AS BIGINT) AS changed, CAST(count(*) FILTER (WHERE c_custkey % 4 = 2) AS BIGINT) AS missing FROM customer")
def path_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.when(F.col("c_custkey") % 4 == 1, F.upper("c_name")).when(F.col("c_custkey") % 4 != 2, F.col("c_name"))
    return metrics.rewrite_counters(_read(spark, sf_dir, "customer").withColumn("new", new), "c_name", "new")


@query("""SELECT 'm' AS model, 'raw' AS variant, o_custkey AS image_id, string_agg(p || '=' || v, ';' ORDER BY p) AS bundle FROM (SELECT o_custkey, o_orderstatus AS p, arg_max(o_orderpriority, o_orderkey) AS v FROM orders GROUP BY 1, 2) GROUP BY 3""")
def last_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles of an image's properties; the last of duplicates counts."""
    rows = _read(spark, sf_dir, "orders").select(F.lit("m").alias("model"), F.lit("raw").alias("variant"), F.col("o_custkey").alias("image_id"), F.col("o_orderstatus").alias("property_key"), F.col("o_orderpriority").alias("pred_value"), F.col("o_orderkey").alias("ord"))
    pairs = F.array_sort(F.map_entries("bundle"))
    return metrics.bundles(rows, order="ord").select("model", "variant", "image_id", F.array_join(F.transform(pairs, lambda x: F.concat(x.key, F.lit("="), x.value)), ";").alias("bundle"))


_AREAS = "SELECT l_orderkey AS image_name, 'm' || l_linenumber AS method, l_linenumber % 3 AS i, CAST(l_quantity AS BIGINT) % 9 + l_linenumber % 3 - 1 + 1 AS p, CASE WHEN l_returnflag <> 'A' THEN CAST(l_quantity AS BIGINT) % 5 + l_linenumber % 3 END AS g, l_discount, l_tax FROM lineitem"


def _ratio(a: str, b: str) -> str:
    return f"round_even(CASE WHEN g IS NOT NULL THEN CASE WHEN p = 0 AND g = 0 THEN 1.0e0 ELSE coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0.0e0) END END, 9)"


@query(f"SELECT image_name, method, {_ratio('i', 'p + g - i')} AS iou, {_ratio('2 * i', 'p + g')} AS dice, {_ratio('i', 'p')} AS precision, {_ratio('i', 'g')} AS recall, p AS mask_area, round_even(p / 64.0e0, 9) AS area_ratio, l_discount AS dino_score, l_tax AS sam_score, 0.5e0 AS inference_time FROM ({_AREAS})")
def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows from pixel counts; no metrics without a true mask."""
    n, q = F.col("l_linenumber") % 3, F.col("l_quantity").cast("long")
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_name"), F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("method"), n.alias("intersection"), (q % 9 + n).alias("pred_area"), F.when(F.col("l_returnflag") != "A", q % 5 + n).alias("gt_area"), F.lit(64).alias("size"), F.col("l_discount").alias("dino_score"), F.col("l_tax").alias("sam_score"), F.lit(0.5).alias("inference_time"))
    out = metrics.result_rows(rows)
    return out.withColumns({c: F.bround(c, 9) for c in ("iou", "dice", "precision", "recall", "area_ratio")})


@query("SELECT status, 'mean_' || k AS metric_name, v AS value FROM (SELECT o_orderstatus AS status, round_even(avg(o_totalprice), 6) AS o_totalprice FROM orders GROUP BY 1) UNPIVOT (v FOR k IN (o_totalprice)) UNION ALL SELECT o_orderstatus, 'n', CAST(count(*) AS DOUBLE) FROM orders GROUP BY 1")
def flat_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary as (key, metric, value) rows."""
    return tables.flat_metrics(status_counts(spark, sf_dir), ["status"])


# ------------------------------------------------------------------ masks

_PIXELS = """px AS (SELECT vec_id, unnest(a) AS x, unnest(b) AS y, unnest(range(len(a))) AS k FROM (SELECT vec_id, embedding AS a, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings) WHERE b IS NOT NULL),
    c AS (SELECT vec_id, count(*) FILTER (WHERE x > 0.1 AND y > 0.1) AS i, count(*) FILTER (WHERE x > 0.1) AS p, count(*) FILTER (WHERE y > 0.1) AS g, count(*) AS n FROM px GROUP BY 1)"""


def _mask_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two masks of 8 x 8 pixels from neighbouring vectors."""
    from pyspark.sql import Window

    rows = _read(spark, sf_dir, "embeddings").withColumn("next", F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).filter("next is not null")
    packed = lambda c: F.unhex(F.array_join(F.transform(c, lambda x: F.when(x.cast("double") > 0.1, "01").otherwise("00")), ""))
    return rows.select("vec_id", packed("embedding").alias("a"), packed("next").alias("b"), F.lit(8).alias("w"), F.lit(8).alias("h"))


@query(f"""WITH {_PIXELS} SELECT vec_id, round_even(CASE WHEN p = 0 AND g = 0 THEN 1.0e0 ELSE coalesce(i * 1.0e0 / nullif(p + g - i, 0), 0) END, 9) AS iou, round_even(CASE WHEN p = 0 AND g = 0 THEN 1.0e0 ELSE coalesce(2.0e0 * i / nullif(p + g, 0), 0) END, 9) AS dice,
    round_even(CASE WHEN p = 0 AND g = 0 THEN 1.0e0 ELSE coalesce(i * 1.0e0 / nullif(p, 0), 0) END, 9) AS precision, round_even(CASE WHEN p = 0 AND g = 0 THEN 1.0e0 ELSE coalesce(i * 1.0e0 / nullif(g, 0), 0) END, 9) AS recall, CAST(p AS BIGINT) AS mask_area, round_even(p * 1.0e0 / n, 9) AS area_ratio,
    round_even(coalesce(i * 1.0e0 / nullif(p + g - i, 0), 0), 9) AS binary_iou FROM c""")
def mask_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IoU, Dice, precision, recall, area and plain IoU of mask pairs, by the array kernels."""
    rows = _mask_pairs(spark, sf_dir)
    area = masks.masks_udf(_areas, "mask_area long, area_ratio double")
    plain = masks.masks_udf(_plain_iou, "binary_iou double")
    rows = rows.select("vec_id", masks.metrics_column(F.col("a"), F.col("b"), F.col("w"), F.col("h")).alias("m"), area("a", "w", "h").alias("s"), plain("a", "b", "w", "h").alias("o"))
    rounded = lambda c, name: F.bround(c, 9).alias(name)
    return rows.select("vec_id", *(rounded(f"m.{c}", c) for c in ("iou", "dice", "precision", "recall")), "s.mask_area", rounded("s.area_ratio", "area_ratio"), rounded("o.binary_iou", "binary_iou"))


def _areas(mask) -> dict:  # noqa: ANN001
    return dict(zip(("mask_area", "area_ratio"), masks.mask_area(mask), strict=True))


def _plain_iou(a, b) -> dict:  # noqa: ANN001
    return {"binary_iou": masks.binary_iou(a, b)}


def _placed(mask) -> dict:  # noqa: ANN001
    y, x = masks.centroid(mask)
    return {"box": masks.mask_box(mask), "cy": y, "cx": x, "touch": masks.border_touch(mask, 2)}


@query(f"""WITH {_PIXELS}, q AS (SELECT vec_id, k % 8 AS x, k // 8 AS y FROM px WHERE x > 0.1)
    SELECT c.vec_id, CASE WHEN p > 0 THEN greatest(min(q.x) - 2, 0) || ',' || greatest(min(q.y) - 2, 0) || ',' || least(max(q.x) + 3, 8) || ',' || least(max(q.y) + 3, 8) END AS box, round_even(coalesce(avg(q.y), 4.0e0), 6) AS cy, round_even(coalesce(avg(q.x), 4.0e0), 6) AS cx,
    round_even(coalesce(count(q.x) FILTER (WHERE q.x < 2 OR q.x > 5 OR q.y < 2 OR q.y > 5) * 1.0e0 / nullif(any_value(p), 0), 0.0e0), 6) AS touch FROM c LEFT JOIN q ON c.vec_id = q.vec_id GROUP BY c.vec_id, p""")
def mask_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded box, centroid and share on the frame."""
    place = masks.masks_udf(_placed, "box array<int>, cy double, cx double, touch double")
    rows = _mask_pairs(spark, sf_dir).select("vec_id", place("a", "w", "h").alias("m"))
    return rows.select("vec_id", F.array_join(masks.box_text(F.col("m.box")), ",").alias("box"), *(masks.score_text(F.col(f"m.{c}")).alias(c) for c in ("cy", "cx", "touch")))


# ------------------------------------------------------------------ selection


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_tax > 0.02 THEN l_discount END DESC NULLS LAST, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def best_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("idx"), F.when(F.col("l_tax") > 0.02, F.col("l_discount")).alias("score"))
    return ranking.best_detection(rows, ["l_orderkey"]).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 25")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.first_n(_read(spark, sf_dir, "orders"), "o_orderkey", 25).select("o_orderkey", "o_custkey")


@query("""SELECT CASE WHEN place <= 50 THEN 'val' ELSE 'train' END AS part, image_id, ord FROM (SELECT CAST(c_custkey AS VARCHAR) AS image_id, c_custkey AS ord, row_number() OVER (ORDER BY md5(c_custkey || ':42'), CAST(c_custkey AS VARCHAR)) AS place FROM customer)""")
def holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a holdout's two parts."""
    ids = _read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("image_id"), F.col("c_custkey").alias("ord"))
    train, val = ranking.holdout_split(ids, 50, shuffle=ranking.shuffled_md5)
    return train.select(F.lit("train").alias("part"), "image_id", "ord").union(val.select(F.lit("val"), "image_id", "ord"))


@query()
def drawn_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of a fifth of the customers as random.Random(42).sample draws it; tests hold it against that."""
    rows = _read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return order.exact_sample(rows, rows.count() // 5, "c_custkey")


@query("SELECT CAST(coalesce((SELECT min(c_custkey) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)), 0) AS BIGINT) AS start UNION ALL SELECT CAST(7 AS BIGINT)")
def review_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a review begins: at the first image without a decision, or at the one asked for."""
    ids = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("image_id"), F.col("c_custkey").alias("ord"))
    done = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("image_id"))
    return ranking.review_start(ids, done).union(ranking.review_start(ids, done, "7"))


# ------------------------------------------------------------------ inference and re-ranking


class Moody:
    """A backend that fails on batches with a 7 in a prompt, answers nothing to an even one in a batch, and never answers a 13."""

    def answer(self, asked: list[str], paths: list[str | None]) -> list[str]:
        if len(asked) > 1 and any("7" in p for p in asked) or any(p == "13" for p in asked):
            raise ValueError("not this")
        return [" " if len(asked) > 1 and int(p) % 2 == 0 else f'{{"n": {p}}}' for p in asked]


inference.register("moody", Moody)


@query("""SELECT c_custkey, CASE WHEN c_custkey <> 13 THEN '{"n": ' || c_custkey || '}' END AS raw_output, CASE WHEN c_custkey = 13 THEN 'ValueError: not this' END AS infer_error FROM customer""")
def batch_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches with single calls for what a batch fails at or leaves blank, and errors in their rows."""
    asked = _read(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("prompt"))
    return inference.infer(asked, "moody", batch=4).select("c_custkey", "raw_output", "infer_error")


def _rerank_sql() -> str:
    """Coordinate ascent over the different bundles, pass by pass: the material given the transparency, then the other way."""
    score = """(CASE WHEN m = m0 THEN 0.75 ELSE -0.55 END + CASE WHEN t = t0 THEN 0.75 ELSE -0.55 END + CASE WHEN m = 'glass' THEN CASE t WHEN 'clear' THEN 2.5 WHEN 'opaque' THEN -1.5 ELSE 0 END WHEN m = 'a' AND t = 'opaque' THEN 0.6 ELSE 0 END
        + CASE WHEN t = 'clear' AND m = 'glass' THEN 1.0 WHEN t = 'clear' AND m = 'a' THEN -2.0 WHEN t = 'opaque' AND m = 'a' THEN 0.5 ELSE 0 END)"""
    out = f"{_BUNDLE}, s0 AS (SELECT DISTINCT m AS m0, t AS t0, m, t FROM b)"
    for k in range(PRIORS.passes):
        out += f""",
        x{k} AS (SELECT m0, t0, t, unnest(list_distinct([m, 'a', 'glass'])) AS m FROM s{k}), y{k} AS (SELECT * FROM x{k} QUALIFY row_number() OVER (PARTITION BY m0, t0 ORDER BY {score} DESC, m) = 1),
        z{k} AS (SELECT m0, t0, m, unnest(list_distinct([t, 'clear', 'opaque'])) AS t FROM y{k}), s{k + 1} AS (SELECT m0, t0, m, t FROM z{k} QUALIFY row_number() OVER (PARTITION BY m0, t0 ORDER BY {score} DESC, t) = 1)"""
    last = f"s{PRIORS.passes}"
    return f"""{out} SELECT model, variant, image_id, 'intrinsic.main_material' AS property_key, CASE b.m WHEN 'glass' THEN 'R' ELSE b.m END AS pred_value, s.m AS pred_value_kg FROM b JOIN {last} s ON b.m = s.m0 AND b.t = s.t0
        UNION ALL SELECT model, variant, image_id, 'intrinsic.transparency_class', b.t, s.t FROM b JOIN {last} s ON b.m = s.m0 AND b.t = s.t0"""


@query(_rerank_sql())
def kg_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles re-ranked by priors."""
    return kg.rerank(_bundle_rows(spark, sf_dir), PRIORS)


@query(f"""WITH p AS ({_rerank_sql()}), r AS (SELECT model, variant, property_key, lower(pred_value) AS a, pred_value_kg AS b, CASE property_key WHEN 'intrinsic.main_material' THEN 'glass' ELSE 'clear' END AS gt FROM p)
    SELECT model, variant, property_key, CAST(count(*) AS BIGINT) AS n, {_pct("count(*) FILTER (WHERE gt = a)", "count(*)")} AS accuracy_raw, {_pct("count(*) FILTER (WHERE gt = b)", "count(*)")} AS accuracy_kg FROM r GROUP BY 1, 2, 3""")
def kg_posthoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy before and after re-ranking."""
    gt = F.when(F.col("property_key") == kg.MATERIAL, "Glass").otherwise("clear")
    rows = _bundle_rows(spark, sf_dir).withColumn("gt_value", gt)
    return pipelines.kg_posthoc(rows, PRIORS)["delta"].select("model", "variant", "property_key", "n", "accuracy_raw", "accuracy_kg")

