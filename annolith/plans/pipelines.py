"""Whole runs as plain functions: evaluate a model, build a subset, re-rank, prepare training rows, split, review, compare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from annolith.functions import prompts, text
from annolith.functions.text import UNKNOWN, is_known
from annolith.operators import inference, joins, kg, metrics, ranking
from annolith.session import kept
from annolith.sources import specs as specs_
from annolith.sources import tables


def evaluate_model(samples: DataFrame, specs: list, backend: str, model: str, variant: str = "raw", only_known: bool = True, few_shot: int = 0, threshold: float = 1.0, batch: int = 8, least: int = 12) -> dict[str, DataFrame]:
    """Ask a backend for each image and property and measure the answers.

    samples: image_id, path, gt (map).  Returns responses, evaluation (long), runs (a row an image), metrics and summary.
    With only_known, an image is asked for the properties whose gt is known, or for the first `least` if none is.
    """
    spark = samples.sparkSession
    dims = F.broadcast(specs_.specs_frame(spark, specs))
    missing = F.when(F.col("value_type") == "multi_categorical", "[]").otherwise(UNKNOWN)
    rows = samples.crossJoin(dims).withColumn("property_key", F.col("key")).withColumn("gt", F.coalesce(F.col("gt")[F.col("key")], missing))
    if only_known:
        some = samples.select("image_id", F.size(F.filter(F.map_values("gt"), is_known)).alias("_known"))
        rows = rows.join(some, "image_id").filter(is_known(F.col("gt")) | ((F.col("_known") == 0) & (F.col("ord") < least))).drop("_known")
    question = prompts.property_prompt(F.col("image_id"), F.col("key"), F.col("value_type"), F.col("allowed"), F.col("description"))
    asked = rows.select(F.lit(model).alias("model"), F.lit(variant).alias("variant"), "image_id", "path", "property_key", "value_type", "ord", "gt", question.alias("prompt"))
    if few_shot:
        asked = with_demos(asked, few_shot)
    responses = inference.infer(asked, backend, batch=batch) if backend != "mock" else asked.withColumn("raw_output", inference.mock_output(F.col("image_id"), F.col("property_key"))).withColumn("infer_error", F.lit(None).cast("string"))
    # Asked once: all that follows reads the written answers.
    responses = kept(responses, "responses")
    evaluation, runs = inference.evaluate(responses, specs, threshold)
    measured = metrics.property_metrics(evaluation, specs_.specs_frame(spark, specs), ["model", "variant"])
    return {"responses": responses, "evaluation": evaluation, "runs": runs, "metrics": measured, "summary": metrics.run_summary(runs, measured)}


def with_demos(asked: DataFrame, k: int) -> DataFrame:
    """Prompts as few-shot chats: the first k other images with the property known, by id, as demos."""
    picks = ranking.few_shot_dynamic(asked.select("image_id", "property_key", "gt"), k)
    value = F.when(F.col("value_type") == "multi_categorical", F.col("gt")).otherwise(prompts.json_string(F.col("gt")))
    shown = asked.select(F.col("image_id").alias("demo"), "property_key", F.struct(F.col("prompt"), prompts.demo_response(F.col("image_id"), F.col("property_key"), value).alias("response")).alias("d"))
    wanted = picks.select("image_id", "property_key", F.posexplode("demos").alias("n", "demo"))
    # Few images serve as demos: the table of demos is k + 1 rows a property, which Spark broadcasts by its size.
    demos = shown.join(wanted.select("demo", "property_key").distinct(), ["demo", "property_key"], "left_semi")
    chats = wanted.join(demos, ["demo", "property_key"]).groupBy("image_id", "property_key").agg(F.array_sort(F.collect_list(F.struct("n", "d"))).alias("demos"))
    out = asked.join(chats, ["image_id", "property_key"], "left")
    turns = F.transform(F.coalesce("demos", F.array().cast("array<struct<n:int,d:struct<prompt:string,response:string>>>")), lambda x: x.d)
    return out.withColumn("prompt", prompts.fallback_text(prompts.few_shot_messages(turns, F.col("prompt")))).drop("demos")


def build_subset(spark: SparkSession, listings: list[str] | str, index: str, n: int, per_type: int, min_known: int = 3, excluded: list[str] | None = None, seed: int = 42) -> dict[str, DataFrame]:
    """Candidates of listing shards, one an image, a balanced selection of n, the funnel and the value distributions."""
    rows = tables.listings(spark, listings)
    texts = {c: text.pick_value(F.col(c)) for c in tables.LISTING_TEXTS}
    seen = Observation("funnel")
    found, _ = joins.candidates(rows, tables.image_index(spark, index), texts, min_known, excluded, observation=seen)
    found = kept(found, "candidates")
    counters = joins.with_excluded(metrics.observed(spark, seen, joins.FUNNEL))
    best = ranking.dedup_best(found.withColumn("key", F.coalesce("main_image_id", "item_id")), ["key"], "known_count", "item_id")
    selected = kept(ranking.quota_select(best, n, per_type, seed), "selected")
    return {"candidates": found, "selected": selected, "funnel": counters, "distribution": metrics.value_distribution(selected, joins.FIVE), "types": metrics.top_values(selected, "product_type")}


def kg_posthoc(predictions: DataFrame, priors: specs_.KnowledgePriors) -> dict[str, DataFrame]:
    """Re-ranked predictions, metrics before and after, and their differences.

    Of predictions for one property the last counts, by the column ord (file order, as predictions(ordered=True) reads it);
    without that column different ones raise.
    """
    order = "ord" if "ord" in predictions.columns else None
    rows = predictions.withColumns({"gt_value": text.norm_knowledge(F.col("gt_value")), "pred_value": text.norm_knowledge(F.col("pred_value"))})
    corrected = kept(kg.rerank(rows, priors, order), "corrected")
    measure = lambda c: metrics.observed_metrics(corrected.select("model", "variant", "image_id", "property_key", F.col("gt_value").alias("gt"), F.col(c).alias("pred")))
    before, after = measure("pred_value"), measure("pred_value_kg")
    return {"corrected": corrected, "raw": before, "kg": after, "delta": metrics.delta_table(before, after)}


def training_examples(samples: DataFrame, specs: list, include_unknown: bool = False) -> DataFrame:
    """A row an image and property: image_id, image_path, property_key, prompt, response, gt_value."""
    rows = joins.long_evaluation(samples.withColumn("pred", F.lit(None).cast("map<string,string>")), specs_.specs_frame(samples.sparkSession, specs))
    dims = F.broadcast(specs_.specs_frame(samples.sparkSession, specs).select(F.col("key").alias("property_key"), "value_type", "allowed", "description"))
    rows = rows.join(dims, "property_key")
    if not include_unknown:
        rows = rows.filter("gt_known")
    value = F.when(F.col("value_type") == "multi_categorical", F.col("gt")).otherwise(prompts.json_string(F.col("gt")))
    question = prompts.property_prompt(F.col("image_id"), F.col("property_key"), F.col("value_type"), F.col("allowed"), F.col("description"))
    return rows.select("image_id", F.col("path").alias("image_path"), "property_key", question.alias("prompt"), prompts.demo_response(F.col("image_id"), F.col("property_key"), value).alias("response"), F.col("gt").alias("gt_value"))


def training_split(examples: DataFrame, ids: DataFrame, n: int, seed: int = 42, shuffle: Callable[[str, int], Column] = ranking.shuffled) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, val, manifest) of examples by a holdout of n image ids."""
    train_ids, val_ids = ranking.holdout_split(ids, n, seed, shuffle)
    train, val = joins.allow_list(examples, train_ids), joins.allow_list(examples, val_ids)
    count = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").cast("long").alias("examples"), F.countDistinct("image_id").cast("long").alias("images"))
    return train, val, count(train, "train").union(count(val, "val"))


def segmentation_tables(results: DataFrame) -> dict[str, DataFrame]:
    """Summary by method, winners, win counts, main object against the best class, and its summary; the models run once."""
    results = kept(results.drop("mask"), "results")
    winners = ranking.prompt_winners(results)
    compared = ranking.main_vs_best(results)
    return {"summary_by_method": metrics.summary_by_method(results), "prompt_winners": winners, "prompt_win_counts": ranking.win_counts(winners), "main_object_vs_best_class": compared, "main_object_vs_best_class_summary": ranking.main_vs_best_summary(compared)}


def review_export(meta: DataFrame, decisions: DataFrame) -> dict[str, DataFrame]:
    approved = joins.approved_rows(meta, decisions)
    return {"approved": approved, "ids": approved.select("image_id", F.col("review_ord").alias("ord")), "progress": metrics.review_progress(meta.select("image_id"), decisions)}
