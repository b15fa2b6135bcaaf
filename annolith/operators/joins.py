"""Filters, joins and merges of samples, listings, results and review decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from annolith.functions.keywords import known_count, with_properties
from annolith.functions.text import UNKNOWN, column_prefix, is_known, once, primary_object, safe_strip, values_equal
from annolith.operators.metrics import funnel, funnel_counters

FIVE = ["material", "rigidity", "transparency", "surface", "fragility"]


def allow_list(rows: DataFrame, ids: DataFrame, key: str = "image_id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def without(rows: DataFrame, ids: DataFrame, key: str = "image_id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_anti")


def exclude_types(rows: DataFrame, types: list[str], column: str = "product_type") -> DataFrame:
    return rows.filter(~F.col(column).isin(types)) if types else rows


def candidates(listings: DataFrame, index: DataFrame, texts: dict[str, Column], min_known: int = 3, excluded: list[str] | None = None, local: DataFrame | None = None, observation: Observation | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(candidates, funnel counters) of listing rows with item_id and main_image_id.

    With an observation the counters are taken on the candidates' own pass (metrics.observed reads them, once the candidates
    are written) and the second result is None; without, they are a job of their own.

    texts: the listing's text fields as Columns.  A listing needs both ids, an image path, the file itself if
    local (path) is given, and min_known known properties; excluded product types go last.
    """
    rows = listings.withColumns({"item_id": safe_strip(F.col("item_id")), "main_image_id": safe_strip(F.col("main_image_id"))})
    rows = rows.join(index.select(F.col("image_id").alias("main_image_id"), F.col("path").alias("image_rel")), "main_image_id", "left")
    present = F.lit(True)
    if local is not None:
        rows = rows.join(local.select(F.col("path").alias("image_rel"), F.lit(True).alias("_here")).distinct(), "image_rel", "left")
        present = F.coalesce("_here", F.lit(False))
    own = [c for c in rows.columns if c in (*FIVE, "product_kind", "material_source")]
    rows = rows.withColumns({f"_text_{k}": once(c) for k, c in texts.items()}).withColumn("_present", present).drop(*own)
    rows = with_properties(rows, {k: F.col(f"_text_{k}") for k in texts})
    rows = rows.withColumn("title", F.col("_text_item_name") if "item_name" in texts else F.lit(None).cast("string"))
    rows = rows.withColumn("known_count", known_count([F.col(c) for c in FIVE]))
    stages = [
        ("records_with_ids", F.col("item_id").isNotNull() & F.col("main_image_id").isNotNull()),
        ("records_with_image_rel", F.coalesce(F.col("image_rel"), F.lit("")) != ""),
        ("records_with_local_image", F.col("_present")),
        ("records_with_min_known", F.col("known_count") >= min_known),
        ("candidates", ~F.col("product_kind").isin(excluded or [""])),
    ]
    passed = F.lit(True)
    for _, condition in stages:
        passed = passed & condition
    if observation is not None:
        rows = rows.observe(observation, *funnel_counters(stages))
    out = rows.filter(passed).select("item_id", "main_image_id", "image_rel", F.col("product_kind").alias("product_type"), primary_object(F.col("product_kind")).alias("primary_object"), *FIVE, "known_count", "title")
    return out, None if observation is not None else with_excluded(funnel(rows, stages))


#: Counters of candidates(), in the order of its stages.
FUNNEL = ["records_total", "records_with_ids", "records_with_image_rel", "records_with_local_image", "records_with_min_known", "candidates"]


def with_excluded(counters: DataFrame) -> DataFrame:
    return counters.withColumn("records_excluded_by_product_type", F.col("records_with_min_known") - F.col("candidates"))


def long_evaluation(samples: DataFrame, specs: DataFrame) -> DataFrame:
    """A row an image and property from samples with maps gt and pred; what a map lacks is unknown (lists: [])."""
    missing = F.when(F.col("value_type") == "multi_categorical", "[]").otherwise(UNKNOWN)
    keys = [c for c in samples.columns if c not in ("gt", "pred")]
    rows = samples.crossJoin(F.broadcast(specs.select(F.col("key").alias("property_key"), "value_type", "ord")))
    value = lambda m: F.coalesce(F.col(m)[F.col("property_key")], missing)
    rows = rows.select(*keys, "property_key", "ord", value("gt").alias("gt"), value("pred").alias("pred"))
    gt, pred = is_known(F.col("gt")), is_known(F.col("pred"))
    return rows.withColumns({"gt_known": gt, "pred_known": pred, "missed_when_gt_known": gt & ~pred, "exact_match": values_equal(F.col("gt"), F.col("pred"))})


def wide_evaluation(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Six columns a property, prefixed by its key with __ for dots; order: the property keys."""
    parts = ["gt", "pred", "gt_known", "pred_known", "missed_when_gt_known", "exact_match"]
    wide = rows.groupBy(*keys).pivot("property_key", order).agg(F.first(F.struct(*parts)))
    return wide.select(*keys, *(F.col(f"`{k}`.{p}").alias(f"{column_prefix(k)}_{p}") for k in order for p in parts))


def narrow_evaluation(wide: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, property_key, gt_value, pred_value) of the wide form."""
    pairs = F.array(*(F.struct(F.lit(k).alias("property_key"), F.col(f"{column_prefix(k)}_gt").alias("gt_value"), F.col(f"{column_prefix(k)}_pred").alias("pred_value")) for k in order))
    return wide.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.*")


def requested_keys(known: Column, keys: Column, least: int = 12) -> Column:
    """Keys whose gt is known; the first `least` keys if none is."""
    return F.when(F.size(known) > 0, known).otherwise(F.slice(keys, 1, least))


def approved_rows(meta: DataFrame, decisions: DataFrame) -> DataFrame:
    """meta rows of approved decisions, in their order (the last of an id counts), with paths taken from the selected columns."""
    last = decisions.groupBy("image_id").agg(F.max_by(F.struct(*decisions.columns), "ord").alias("d")).select("image_id", "d")
    rows = meta.join(last.filter("d.decision = 'approved'"), "image_id")
    text = lambda c: F.nullif(F.col(c), F.lit(""))

    def chosen(field: str, default: str) -> Column:
        out = text(default) if default in meta.columns else F.lit(None).cast("string")
        for name in (c for c, kind in meta.dtypes if kind == "string"):
            out = F.when((F.col(f"d.{field}") == name) & text(name).isNotNull(), F.col(name)).otherwise(out)
        return out

    new = {"mask_path": chosen("selected_mask_field", "mask_path"), "mask_source": chosen("selected_source_field", "mask_source"), "seg_preview_path": chosen("selected_preview_field", "seg_preview_path")}
    audit = {"review_decision": F.lit("approved"), "review_selected_mask_field": F.col("d.selected_mask_field"), "review_selected_mask_source_field": F.col("d.selected_source_field"), "review_selected_preview_field": F.col("d.selected_preview_field"), "review_timestamp": F.col("d.reviewed_at"), "review_ord": F.col("d.ord")}
    return rows.withColumns({**new, **audit}).drop("d")


def kept_rows(meta: DataFrame, decisions: DataFrame) -> DataFrame:
    """meta rows of decisions to keep, with two audit columns."""
    last = decisions.groupBy("image_id").agg(F.max_by("decision", "ord").alias("final_review_decision"), F.max_by("reviewed_at", "ord").alias("final_review_timestamp"))
    return meta.join(last.filter("final_review_decision = 'keep'"), "image_id")


def meta_by_path(files: DataFrame, meta: DataFrame, keys: Column) -> DataFrame:
    """files (path) with the meta row of the first of their candidate keys that meta (meta_key) has; rows without stay."""
    found = files.select("path", F.posexplode(keys).alias("rank", "meta_key")).join(meta, "meta_key")
    best = found.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("rank"))).filter("_n = 1").drop("_n", "rank")
    return files.join(best, "path", "left")


def merge_results(meta: DataFrame, results: DataFrame, suffix: str = "") -> DataFrame:
    """meta updated by segmentation results (image_id, columns): named with the suffix, what a result lacks keeps its value.
    A result with a status alone (a failure) changes the status only."""
    names = [c for c in results.columns if c != "image_id"]
    new = results.select("image_id", *(F.col(c).alias(f"_new_{c}") for c in names))
    rows = meta.join(new, "image_id", "left")
    for c in names:
        target = f"{c}{suffix}"
        rows = rows.withColumn(target, F.coalesce(f"_new_{c}", target) if target in meta.columns else F.col(f"_new_{c}"))
    return rows.drop(*(f"_new_{c}" for c in names))


MASK_VIEWS = [("mask_path", "seg_preview_path", "mask_source"), ("mask_path_hint", "seg_preview_path_hint", "mask_source_hint"), ("mask_path_hint_title", "seg_preview_path_hint_title", "mask_source_hint_title")]


def mask_views(meta: DataFrame, files: DataFrame) -> DataFrame:
    """(image_id, view, mask_field, mask_path, preview_path, mask_source): a row a mask that exists; previews that don't exist fall back to the mask."""
    here = set(meta.columns)
    get = lambda c: (F.col(c) if c in here else F.lit(None)).cast("string")
    views = F.array(*(F.struct(F.lit(m).alias("mask_field"), get(m).alias("mask_path"), get(p).alias("preview_path"), get(s).alias("mask_source")) for m, p, s in MASK_VIEWS))
    rows = meta.select("image_id", F.posexplode(views).alias("view", "v")).select("image_id", "view", "v.*")
    known = files.select("path").distinct()
    rows = rows.join(known.withColumnRenamed("path", "mask_path"), "mask_path", "left_semi")
    rows = rows.join(known.select(F.col("path").alias("preview_path"), F.lit(True).alias("_seen")), "preview_path", "left")
    return rows.select("image_id", "view", "mask_field", "mask_path", F.when(F.col("_seen"), F.col("preview_path")).otherwise(F.col("mask_path")).alias("preview_path"), "mask_source")


def pending(meta: DataFrame, done: DataFrame | None = None, overwrite: bool = False) -> DataFrame:
    """Rows that still need a mask: none refined before (source sam:...) and no output (image_id) there."""
    if overwrite:
        return meta
    rows = meta.filter(~F.coalesce(F.col("mask_source").startswith("sam:"), F.lit(False)))
    return without(rows, done) if done is not None else rows


VARIANTS = ["raw", "mask_overlay", "masked"]


def variants_frame(samples: DataFrame, wanted: list[str]) -> DataFrame:
    """variant and ord of the known names in wanted, in their fixed order; mask variants only if a sample has a mask."""
    masked = F.coalesce(F.max(F.coalesce("mask_path", F.lit("")) != ""), F.lit(False))
    names = F.array(*(F.struct(F.lit(v).alias("variant"), F.lit(k).alias("ord"), F.lit(v == "raw").alias("always")) for k, v in enumerate(v for v in VARIANTS if v in wanted)))
    return samples.agg(masked.alias("masked")).select("masked", F.inline(names)).filter("always or masked").select("variant", "ord")


def available_variants(samples: DataFrame, wanted: list[str]) -> list[str]:
    """The names of variants_frame (three at most)."""
    return [r["variant"] for r in variants_frame(samples, wanted).orderBy("ord").collect()]


def union_variants(*metrics: DataFrame) -> DataFrame:
    out = metrics[0]
    for other in metrics[1:]:
        out = out.unionByName(other)
    return out
