"""Evaluation metrics over long rows: one row an image and property.

A long frame has model, variant, image_id, property_key, gt and pred (texts; unknown is a
value).  Confusion counts come first, so that whatever follows works on label pairs, not rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from annolith.functions.text import UNKNOWN, is_known

RUN = ["model", "variant"]


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, half-even to two places; NULL for nothing."""
    return F.bround(F.try_divide(F.lit(100.0) * part, whole), 2)


def confusion(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "gt", "pred").agg(F.count("*").alias("n"))


def label_f1(pairs: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, f1 for labels (keys, label) from confusion counts; labels without support count 0."""
    hits = pairs.groupBy(*keys, F.col("gt").alias("label")).agg(F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("is_gt"))
    said = pairs.groupBy(*keys, F.col("pred").alias("label")).agg(F.sum("n").alias("is_pred"))
    out = labels
    for side in (hits, said):
        renamed = side.toDF(*[f"_{c}" if c in (*keys, "label") else c for c in side.columns])
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*keys, "label")]
        out = out.join(renamed, same, "left").drop(*(f"_{c}" for c in (*keys, "label")))
    tp, gt, pred = (F.coalesce(c, F.lit(0)).cast("double") for c in ("tp", "is_gt", "is_pred"))
    precision, recall = F.coalesce(F.try_divide(tp, pred), F.lit(0.0)), F.coalesce(F.try_divide(tp, gt), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return out.select(*keys, "label", f1.alias("f1"))


def property_metrics(rows: DataFrame, specs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The 15 columns of each property (and each of keys), in one pass over the rows.

    Accuracy, selective accuracy and macro-F1 are over rows with known gt; macro-F1 averages over the whole
    vocabulary but unknown, for scalar kinds.
    """
    by = [*(keys or []), "property_key"]
    pairs = confusion(rows, by).withColumn("gt_known", is_known(F.col("gt"))).withColumn("pred_known", is_known(F.col("pred")))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    gt, pred, same = F.col("gt_known"), F.col("pred_known"), F.col("gt") == F.col("pred")
    counts = pairs.groupBy(*by).agg(
        F.sum("n").cast("long").alias("total"),
        total(pred).alias("pred_yes_count"),
        total(gt).alias("gt_known_count"),
        total(gt & ~pred).alias("missed_when_gt_known"),
        total(gt & same).alias("_right"),
        total(gt & (F.col("pred") != UNKNOWN)).alias("_covered"),
        total(gt & same & (F.col("pred") != UNKNOWN)).alias("_covered_right"),
    )
    dims = specs.select(F.col("key").alias("property_key"), "group", "value_type", "allowed", "ord")
    labels = counts.select(*by).join(F.broadcast(dims), "property_key").filter(F.col("value_type").isin("categorical", "boolean")).select(*by, F.explode("allowed").alias("label")).filter(F.col("label") != UNKNOWN)
    f1 = label_f1(pairs.filter("gt_known"), labels, by).groupBy(*by).agg(F.avg("f1").alias("_f1"))
    out = counts.join(F.broadcast(dims), "property_key").join(f1, by, "left")
    known = F.col("gt_known_count")
    extracted = known - F.col("missed_when_gt_known")
    return out.select(
        *(keys or []),
        F.col("property_key").alias("property"),
        "group",
        "value_type",
        "pred_yes_count",
        (F.col("total") - F.col("pred_yes_count")).alias("pred_no_count"),
        percent(F.col("pred_yes_count"), F.col("total")).alias("pred_yes_pct"),
        percent(F.col("pred_yes_count"), F.col("total")).alias("coverage_pct"),
        "gt_known_count",
        extracted.alias("extracted_when_gt_known"),
        "missed_when_gt_known",
        percent(extracted, known).alias("coverage_on_gt_known_pct"),
        percent(F.col("_right"), known).alias("accuracy_pct"),
        F.when(known > 0, F.bround(100.0 * F.col("_f1"), 2)).alias("macro_f1_pct"),
        percent(F.col("_covered_right"), F.col("_covered")).alias("selective_accuracy_pct"),
        percent(F.col("_right"), known).alias("exact_match_on_gt_known_pct"),
    )


def run_summary(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row a model and variant: counts and shares over images, means over properties of rounded metrics."""
    share = lambda c: percent(F.sum(F.col(c).cast("int")), F.count("*"))
    flags = {"has_valid_json": "valid_json", "has_valid_json_all": "valid_json_all", "image_id_matched": "image_id_match", "image_id_matched_all": "image_id_match_all"}
    exprs = [F.count("*").cast("long").alias("num_samples")]
    for flag, name in flags.items():
        exprs += [F.sum(F.col(flag).cast("int")).cast("long").alias(f"{name}_count"), share(flag).alias(f"{name}_pct")]
    exprs.append(percent(F.sum("valid_json_count"), F.nullif(F.sum("expected_response_count"), F.lit(0))).alias("valid_json_per_response_pct"))
    means = [F.bround(F.avg(c), 2).alias(f"mean_{c}") for c in ("coverage_pct", "accuracy_pct", "macro_f1_pct", "selective_accuracy_pct")]
    return runs.groupBy(*RUN).agg(*exprs).join(metrics.groupBy(*RUN).agg(*means), RUN, "left")


def response_stats(responses: DataFrame, threshold: float = 1.0, id_threshold: float | None = None) -> DataFrame:
    """One row a model, variant and image from its responses (ord, valid, id_matched, primary_object, notes, error)."""
    least = threshold if id_threshold is None else id_threshold
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("ord"))).alias(f"{c}_pred")
    errors = F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("ord", "error"))))
    out = responses.groupBy(*RUN, "image_id").agg(
        F.count_if("valid").alias("valid_json_count"),
        F.count_if("id_matched").alias("image_id_match_count"),
        F.count("*").alias("expected_response_count"),
        first("primary_object"),
        first("notes"),
        errors.alias("_errors"),
    )
    whole = F.col("expected_response_count")
    valid, matched = F.col("valid_json_count") / whole, F.col("image_id_match_count") / whole
    return out.select(
        *RUN,
        "image_id",
        "valid_json_count",
        "image_id_match_count",
        "expected_response_count",
        F.bround(valid, 6).alias("valid_json_ratio"),
        F.bround(matched, 6).alias("image_id_match_ratio"),
        (valid >= threshold).alias("has_valid_json"),
        (F.col("valid_json_count") == whole).alias("has_valid_json_all"),
        (matched >= least).alias("image_id_matched"),
        (F.col("image_id_match_count") == whole).alias("image_id_matched_all"),
        "primary_object_pred",
        "notes_pred",
        F.nullif(F.array_join(F.transform(F.slice("_errors", 1, 30), lambda e: e.error), " | "), F.lit("")).alias("parse_error"),
    )


def observed_metrics(rows: DataFrame) -> DataFrame:
    """accuracy, macro_f1 and selective_accuracy a model, variant and property over every row.

    Labels are those that occur: every gt (unknown too), and every pred but unknown.
    """
    by = [*RUN, "property_key"]
    pairs = confusion(rows, by)
    labels = pairs.select(*by, F.col("gt").alias("label")).union(pairs.filter(F.col("pred") != UNKNOWN).select(*by, "pred")).distinct()
    f1 = label_f1(pairs, labels, by).groupBy(*by).agg(F.avg("f1").alias("_f1"))
    same, said = F.col("gt") == F.col("pred"), F.col("pred") != UNKNOWN
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    sums = pairs.groupBy(*by).agg(F.sum("n").cast("long").alias("n"), total(same).alias("right"), total(said).alias("covered"), total(said & same).alias("covered_right"))
    f1 = f1.toDF(*(f"_{c}" for c in by), "_f1")
    out = sums.join(f1, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    return out.select(*by, "n", percent(F.col("right"), F.col("n")).alias("accuracy"), F.bround(100.0 * F.col("_f1"), 2).alias("macro_f1"), percent(F.col("covered_right"), F.col("covered")).alias("selective_accuracy"))


def delta_table(raw: DataFrame, other: DataFrame, suffix: str = "kg") -> DataFrame:
    """Metrics of two observed_metrics frames side by side with their differences."""
    by, names = [*RUN, "property_key", "n"], ["accuracy", "macro_f1", "selective_accuracy"]
    left = raw.select(*by, *(F.col(c).alias(f"{c}_raw") for c in names))
    right = other.select(*by, *(F.col(c).alias(f"{c}_{suffix}") for c in names))
    return left.join(right, by).select("*", *((F.col(f"{c}_{suffix}") - F.col(f"{c}_raw")).alias(f"{c}_delta") for c in names))


def variant_pivot(metrics: DataFrame, variants: tuple[str, str] = ("raw", "masked"), value: str = "coverage_pct") -> DataFrame:
    """A metric of each property by variant, and the second variant less the first."""
    wide = metrics.groupBy("property").pivot("variant", list(variants)).agg(F.first(value))
    return wide.withColumn("delta", F.bround(F.col(variants[1]) - F.col(variants[0]), 2))


NUMERIC = ["iou", "dice", "precision", "recall", "mask_area", "area_ratio", "dino_score", "sam_score", "inference_time"]


def without_nan(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c)) for c in columns})


def summary_by_method(results: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows, images, and mean, sample deviation and median of each measure a method; NaN is missing."""
    names = columns or NUMERIC
    exprs = [F.count("*").cast("long").alias("num_rows"), F.countDistinct("image_name").cast("long").alias("num_images")]
    for suffix, f in (("mean", F.avg), ("std", F.stddev_samp), ("median", F.median)):
        exprs += [f(c).alias(f"{c}_{suffix}") for c in names]
    return without_nan(results, names).groupBy("method").agg(*exprs)


def value_distribution(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(property, value, n) of each column."""
    return rows.select(*columns).unpivot([], columns, "property", "value").groupBy("property", "value").agg(F.count("*").cast("long").alias("n"))


def top_values(rows: DataFrame, column: str, n: int = 20) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").cast("long").alias("n")).orderBy(F.desc("n"), column).limit(n)


def funnel_counters(stages: list[tuple[str, Column]]) -> list[Column]:
    """Aggregates: how many rows there are, and how many pass each stage and all before it."""
    exprs, so_far = [F.count("*").cast("long").alias("records_total")], F.lit(True)
    for name, passed in stages:
        so_far = so_far & F.coalesce(passed, F.lit(False))
        exprs.append(F.count_if(so_far).cast("long").alias(name))
    return exprs


def funnel(rows: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """One row: funnel_counters of rows, in a job of its own."""
    return rows.agg(*funnel_counters(stages))


def observed(spark: SparkSession, observation: Observation, names: list[str]) -> DataFrame:
    """The counters of an observation as one row, once an action has run on the frame that it observes."""
    found = observation.get
    return spark.createDataFrame([tuple(found[n] for n in names)], ", ".join(f"{n} long" for n in names))


def spread(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.bround(F.avg(column), 6).alias("mean"), F.min(column).alias("min"), F.max(column).alias("max"))


def status_summary(rows: DataFrame, measures: list[str]) -> DataFrame:
    """Rows and mean measures (6 places) a status."""
    return rows.groupBy("status").agg(F.count("*").cast("long").alias("n"), *(F.bround(F.avg(c), 6).alias(f"mean_{c}") for c in measures))


def rewrite_counters(rows: DataFrame, old: str, new: str) -> DataFrame:
    changed = F.coalesce(F.col(old) != F.col(new), F.lit(False))
    return rows.agg(F.count("*").cast("long").alias("processed"), F.count_if(changed).cast("long").alias("changed"), F.count_if(F.col(new).isNull()).cast("long").alias("missing"))


def review_progress(ids: DataFrame, decisions: DataFrame) -> DataFrame:
    """Images a decision; `undecided` for those without."""
    return ids.join(decisions.select("image_id", "decision"), "image_id", "left").groupBy(F.coalesce("decision", F.lit("undecided")).alias("decision")).agg(F.count("*").cast("long").alias("n"))


def bundles(rows: DataFrame, value: str = "pred_value", order: str | None = None) -> DataFrame:
    """(model, variant, image_id, bundle: property -> value); of duplicates the last by order."""
    by = [*RUN, "image_id", "property_key"]
    last = rows.groupBy(*by).agg((F.max_by(value, order) if order else F.max(value)).alias("v"))
    return last.groupBy(*by[:-1]).agg(F.map_from_entries(F.collect_list(F.struct("property_key", "v"))).alias("bundle"))


def result_rows(pairs: DataFrame) -> DataFrame:
    """Result rows of predictions (image_name, method, intersection, pred_area, gt_area or NULL, size, scores, time)."""
    i, p, g = F.col("intersection"), F.col("pred_area"), F.col("gt_area")
    empty = (p == 0) & (g == 0)
    ratio = lambda a, b: F.when(g.isNotNull(), F.when(empty, 1.0).otherwise(F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))))
    return pairs.select(
        "image_name",
        "method",
        ratio(i, p + g - i).alias("iou"),
        ratio(2 * i, p + g).alias("dice"),
        ratio(i, p).alias("precision"),
        ratio(i, g).alias("recall"),
        p.alias("mask_area"),
        F.coalesce(F.try_divide(p.cast("double"), F.col("size")), F.lit(0.0)).alias("area_ratio"),
        "dino_score",
        "sam_score",
        "inference_time",
    )


def share_of_total(counts: DataFrame, column: str = "win_count") -> DataFrame:
    """counts with win_ratio; the counts are a row a method."""
    return counts.withColumn("win_ratio", F.col(column) / F.sum(column).over(Window.partitionBy(F.lit(1))))
