"""Readers of annotations, metadata, listings, predictions and image files, and the sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annolith.functions.text import NULL_TOKENS, UNKNOWN, strip
from annolith.sources.specs import DatasetContext

IMAGE_ENDINGS = [".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tif", ".tiff"]
MASK_ENDINGS = [".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff"]
#: Words that the usual CSV reader of such tables takes as missing.
NA_WORDS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def file_order() -> Column:
    """A key that sorts rows as their files do: path, first byte of the block, and row in the block.

    The number of a row rises inside a task, and a task reads a block from its start to its end; how blocks are packed
    into tasks does not matter.  operators.order.row_index turns the key into positions.
    """
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))


def _ordered(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file order."""
    return spark.read.text(path).select(F.col("value"), file_order().alias("ord"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """JSONL records (ord: file_order, image_id, split, caption, record: variant).  Blank lines and rows without obj_id are skipped; bad JSON raises."""
    rows = _ordered(spark, path).filter(strip(F.col("value")) != "").select("ord", F.parse_json("value").alias("record"))
    text = lambda name: F.try_variant_get("record", f"$.{name}", "string")
    out = rows.select("ord", strip(text("obj_id")).alias("image_id"), text("split").alias("split"), text("caption").alias("caption"), "record")
    return out.filter(F.coalesce(F.col("image_id"), F.lit("")) != "")


def meta(spark: SparkSession, path: str, required: bool = True) -> DataFrame:
    """A JSON array's objects with image_id and path (ord, image_id, path, caption, primary_object, record: variant).

    Each file is one array, read by one task (2 GB at most); ord sorts by file, then place.  JSON lines go through annotations().
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = whole.select("file", F.posexplode(F.from_json("value", "array<string>")).alias("place", "text")).select(F.struct("file", "place").alias("ord"), "text")
    rows = rows.select("ord", F.try_parse_json("text").alias("record")).filter(F.schema_of_variant("record").startswith("OBJECT"))
    text = lambda name: F.try_variant_get("record", f"$.{name}", "string")
    out = rows.select("ord", text("image_id").alias("image_id"), text("path").alias("path"), text("notes").alias("caption"), text("primary_object").alias("primary_object"), "record")
    out = out.filter((F.coalesce("image_id", F.lit("")) != "") & (F.coalesce("path", F.lit("")) != ""))
    if required and not out.limit(1).count():
        raise ValueError(f"no samples in {path}")
    return out


def samples(spark: SparkSession, context: DatasetContext, meta_path: str | None = None) -> DataFrame:
    if context.kind == "meta_json":
        return meta(spark, meta_path or context.annotations)
    if meta_path:
        raise ValueError("another meta file is for meta_json datasets only")
    return annotations(spark, context.annotations)


LISTING_TEXTS = ["product_type", "item_name", "material", "fabric_type", "finish_type", "color", "bullet_point", "product_description"]


def listings(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Listing shards (gzip or plain JSONL); bad lines are skipped.  Text fields stay variants (see functions.text.pick_value)."""
    rows = spark.read.text(paths).select(F.try_parse_json("value").alias("record")).filter(F.schema_of_variant("record").startswith("OBJECT"))
    ids = [F.try_variant_get("record", f"$.{c}", "string").alias(c) for c in ("item_id", "main_image_id", "domain_name")]
    return rows.select(*ids, *(F.try_variant_get("record", f"$.{c}", "variant").alias(c) for c in LISTING_TEXTS))


def image_index(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, path) of a CSV, or of several in the order of their paths; of rows with one image_id the last, without blanks."""
    rows = spark.read.csv(path, header=True).select("image_id", "path", file_order().alias("ord"))
    rows = rows.filter((F.coalesce(strip(F.col("image_id")), F.lit("")) != "") & (F.coalesce(strip(F.col("path")), F.lit("")) != ""))
    return rows.groupBy("image_id").agg(F.max_by("path", "ord").alias("path"))


def allowed_ids(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, ord): lines of a text file, a JSON list, or a JSON object's image_ids, ids or samples (the first that is a list).

    A JSON file is read by one task (2 GB at most), lines in parallel; ord sorts by file, then place.
    """
    if not path.endswith(".json"):
        return _ordered(spark, path).select(strip(F.col("value")).alias("image_id"), "ord").filter("image_id <> ''")
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    found = F.coalesce(*(F.try_variant_get("v", p, "array<string>") for p in ("$", "$.image_ids", "$.ids", "$.samples")))
    return whole.select("file", F.posexplode(found).alias("place", "image_id")).select(strip(F.col("image_id")).alias("image_id"), F.struct("file", "place").alias("ord")).filter("image_id <> ''")


PREDICTION_COLUMNS = ["image_id", "model", "property_key", "gt_value", "pred_value"]


def predictions(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """Long predictions as strings, from CSV, a JSON list, {"rows": [...]} or JSONL; variant defaults to `default`.
    ordered: also ord, the file order.

    A JSON list or object is one file and read by one task (2 GB at most); JSON lines are read in parallel.
    """
    if path.endswith(".csv"):
        rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
        rows = rows.select(*(F.when(~F.col(c).isin(NA_WORDS), F.col(c)).alias(c) for c in rows.columns), file_order().alias("_ord"))
    elif path.endswith(".jsonl"):
        rows = spark.read.json(path, primitivesAsString=True, mode="FAILFAST").select("*", file_order().alias("_ord"))
    else:
        rows = spark.read.json(path, primitivesAsString=True, multiLine=True, mode="FAILFAST")
        if "rows" in rows.columns and "image_id" not in rows.columns:
            rows = rows.select(F.posexplode("rows").alias("_at", "r"), file_order().alias("_file")).select("r.*", F.struct("_file", "_at").alias("_ord"))
        else:
            rows = rows.select("*", file_order().alias("_ord"))
    missing = [c for c in PREDICTION_COLUMNS if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    kind = F.coalesce("variant", F.lit("default")) if "variant" in rows.columns else F.lit("default")
    return rows.withColumn("variant", kind).select("image_id", "model", "variant", "property_key", "gt_value", "pred_value", *([F.col("_ord").alias("ord")] if ordered else []))


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, relative, length) of image files below root, by relative path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    base = root.rstrip("/") + "/"
    relative = F.regexp_replace(F.substring_index(F.col("path"), base, -1), "^/+", "")
    ending = F.concat(F.lit("."), F.lower(F.substring_index("path", ".", -1)))
    return files.select("path", relative.alias("relative"), "length").filter(ending.isin(IMAGE_ENDINGS)).orderBy("relative")


def images(spark: SparkSession, root: str) -> DataFrame:
    """Decoded images (origin, height, width, channels, data: rows of BGR bytes)."""
    return spark.read.format("image").option("recursiveFileLookup", "true").load(root).select("image.origin", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def first_existing(wanted: DataFrame, candidates: Column, files: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, path): of each row's candidate paths (in order) the first that files (path) holds; rows without one are left out."""
    rows = wanted.select(key, F.posexplode(candidates).alias("rank", "path"))
    # Both sides are dealt by path: the size that Spark expects of the exploded rows is that of the rows before, so that it would broadcast millions of paths.
    return rows.join(files.select("path").distinct().hint("merge"), "path").groupBy(key).agg(F.min_by("path", "rank").alias("path"))


def mask_candidates(relative: Column) -> Column:
    """Mirrored path with each mask ending, then the bare stem with each."""
    stem = F.regexp_replace(relative, r"\.[^./]+$", "")
    name = F.element_at(F.split(stem, "/"), -1)
    return F.array(*(F.concat(s, F.lit(e)) for s in (stem, name) for e in MASK_ENDINGS))


def panel_candidates(raw: Column, image_id: Column, root: str, panels: str) -> Column:
    """Where a panel may lie: the path as it stands (below root unless it is absolute), its name in the panels folder, ID.png there."""
    name = F.concat(F.lit(f"{panels}/"), F.element_at(F.split(raw, "/"), -1))
    whole = F.when(raw.startswith("/"), raw).otherwise(F.concat(F.lit(f"{root}/"), raw))
    given = F.when(F.coalesce(raw, F.lit("")) != "", F.array(whole, name)).otherwise(F.array().cast("array<string>"))
    return F.concat(given, F.array(F.concat(F.lit(f"{panels}/"), image_id, F.lit(".png"))))


def panel_paths(samples: DataFrame, files: DataFrame, root: str, panels: str) -> DataFrame:
    """samples (image_id, panel) with path, the first of panel_candidates that files (path) holds; one without any raises."""
    found = first_existing(samples, panel_candidates(F.col("panel"), F.col("image_id"), root, panels), files)
    missing = F.raise_error(F.concat(F.lit("panel image not found for "), F.col("image_id")))
    return samples.join(found, "image_id", "left").withColumn("path", F.coalesce("path", missing.cast("string")))


def training_rows(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.json(path, mode="FAILFAST")
    if not rows.limit(1).count():
        raise ValueError(f"no rows in {path}")
    return rows


def id_scan(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, ord) of a JSONL file's non-blank obj_id, in file order; none raises."""
    out = annotations(spark, path).select("image_id", "ord")
    if not out.limit(1).count():
        raise ValueError(f"no ids in {path}")
    return out


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """(ord, image_id, decision, ...) of JSON objects keyed by id, one a file, in the order of paths and keys; a file is read
    by one task (2 GB at most)."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "map<string,string>").alias("m"))
    rows = whole.select("file", F.posexplode(F.map_entries("m")).alias("place", "e")).select(F.struct("file", "place").alias("ord"), F.col("e.key").alias("key"), F.try_parse_json("e.value").alias("v"))
    names = ["decision", "reviewed_at", "selected_mask_field", "selected_preview_field", "selected_source_field", "selected_mask_path", "selected_preview_path", "selected_mask_source"]
    text = lambda name: F.try_variant_get("v", f"$.{name}", "string")
    return rows.select("ord", F.coalesce(text("image_id"), F.col("key")).alias("image_id"), *(text(n).alias(n) for n in names))


def materialisation(wanted: DataFrame, present: DataFrame, local: DataFrame, fetched: DataFrame | None = None) -> DataFrame:
    """wanted (path) with status exists, copied_local, downloaded, download_failed or missing_local, by path listings."""
    flag = lambda df, name: df.select("path", F.lit(True).alias(name)).distinct()
    out = wanted.join(flag(present, "_here"), "path", "left").join(flag(local, "_local"), "path", "left")
    rest = F.lit("missing_local")
    if fetched is not None:
        out = out.join(flag(fetched, "_got"), "path", "left")
        rest = F.when(F.col("_got"), "downloaded").otherwise("download_failed")
    return out.withColumn("status", F.when(F.col("_here"), "exists").when(F.col("_local"), "copied_local").otherwise(rest)).drop("_here", "_local", "_got")


# ------------------------------------------------------------------ sinks


def write_report(evaluations: DataFrame, metrics: DataFrame, summary: DataFrame, root: str) -> None:
    """Predictions by model and variant, property metrics and the run summary."""
    evaluations.write.mode("overwrite").partitionBy("model", "variant").parquet(f"{root}/per_sample_predictions")
    metrics.coalesce(1).write.mode("overwrite").csv(f"{root}/property_metrics", header=True)
    summary.coalesce(1).write.mode("overwrite").json(f"{root}/summary")


def write_tables(tables: dict[str, DataFrame], root: str) -> None:
    """Each table as CSV with a header under its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").csv(f"{root}/{name}", header=True)


def write_json(df: DataFrame, path: str, order: str | None = None) -> None:
    (df.orderBy(order) if order else df).write.mode("overwrite").json(path)


def write_ids(ids: DataFrame, path: str) -> None:
    """One id a line, in the order of ord."""
    ids.orderBy("ord").select("image_id").coalesce(1).write.mode("overwrite").text(path)


def rewrite(df: DataFrame, path: str) -> str:
    """A new version of a table beside the old one; never writes where it reads."""
    target = f"{path.rstrip('/')}.v{uuid.uuid4().hex[:12]}"
    df.write.parquet(target)
    return target


def unreferenced(files: DataFrame, used: DataFrame) -> DataFrame:
    """Files (path) that used (path) does not name."""
    return files.join(used.select("path").distinct(), "path", "left_anti")


def flat_metrics(summary: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric_name, value) of a one-row-a-run summary."""
    names = [c for c, kind in summary.dtypes if c not in keys and kind in ("double", "float", "int", "bigint")]
    out = summary.select(*keys, *(F.col(c).cast("double").alias(c) for c in names)).unpivot(keys, names, "metric_name", "value")
    return out.withColumn("metric_name", F.regexp_replace("metric_name", "[^a-zA-Z0-9_]+", "_"))


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


__all__ = [n for n in dir() if not n.startswith("_")] + ["NULL_TOKENS", "UNKNOWN"]
