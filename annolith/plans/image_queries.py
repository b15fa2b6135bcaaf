"""Registered queries of image files, mask regions, backgrounds and rendering, over images made from embeddings, with SQL that gives the same rows.

A vector of 64 components is an image of 8 x 8 pixels: brightness falls with a component's size, a pixel's three colours come from
neighbouring components, and its mask holds the components over 0.1.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annolith.functions import masks
from annolith.operators import order, segmentation
from annolith.plans.queries import _read, query
from annolith.session import scratch_path, spread
from annolith.sources import images, tables
from annolith.sources.versions import WorkLog

_LEVEL = "CAST(greatest(255 - floor(abs(CAST({} AS DOUBLE)) * 1000), 0) AS INT)"
_PX = f"""px AS MATERIALIZED (SELECT vec_id, k, k % 8 AS x, k // 8 AS y, e[k + 1] > 0.1 AS m, {_LEVEL.format("e[k + 1]")} AS r, {_LEVEL.format("e[(k + 1) % 64 + 1]")} AS g, {_LEVEL.format("e[(k + 2) % 64 + 1]")} AS b
    FROM (SELECT vec_id, unnest(range(64)) AS k, embedding AS e FROM embeddings WHERE len(embedding) = 64))"""
#: Neighbours of four, in SQL.
_NEXT = "abs(p.x - q.x) + abs(p.y - q.y) = 1"


_RIM = f"rim AS (SELECT *, m AND n < 4 AS edge FROM (SELECT p.vec_id, p.k, p.m, p.r, p.g, p.b, count(*) FILTER (WHERE q.m) AS n FROM px p LEFT JOIN px q ON p.vec_id = q.vec_id AND {_NEXT} GROUP BY ALL))"


def _hex(values: Column) -> Column:
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), 2, "0")), ""))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, relative, width, height, data (RGB bytes), mask."""
    rows = spread(_read(spark, sf_dir, "embeddings").filter(F.size("embedding") == 64), "vec_id")
    level = lambda k: F.greatest(F.lit(255) - F.floor(F.abs(F.get("embedding", k % 64).cast("double")) * 1000), F.lit(0))
    data = _hex(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.array(level(k), level(k + 1), level(k + 2)))))
    mask = _hex(F.transform("embedding", lambda x: F.when(x.cast("double") > 0.1, F.lit(1)).otherwise(F.lit(0)).cast("long")))
    relative = F.concat(F.lit("set"), (F.col("vec_id") % 3).cast("string"), F.lit("/v"), F.col("vec_id").cast("string"), F.lit(".jpg"))
    return rows.select("vec_id", relative.alias("relative"), F.lit(8).alias("width"), F.lit(8).alias("height"), data.alias("data"), mask.alias("mask"))


def _number(relative: str = "relative") -> Column:
    return F.regexp_extract(relative, "v([0-9]+)", 1).cast("long").alias("vec_id")


# ------------------------------------------------------------------ files


@query(f"""WITH {_PX}, big AS (SELECT vec_id, i, j, m FROM px JOIN (SELECT unnest(range(5)) AS i) o ON px.y = (2 * i + 1) * 8 // 10 JOIN (SELECT unnest(range(20)) AS j) c ON px.x = (2 * j + 1) * 8 // 40)
    SELECT vec_id, 'own' AS size, CAST(count(*) FILTER (WHERE m) AS BIGINT) AS area, md5(string_agg(CASE WHEN m THEN '01' ELSE '00' END, '' ORDER BY k)) AS bytes FROM px GROUP BY 1
    UNION ALL SELECT vec_id, 'resized', CAST(count(*) FILTER (WHERE m) AS BIGINT), md5(string_agg(CASE WHEN m THEN '01' ELSE '00' END, '' ORDER BY i * 20 + j)) FROM big GROUP BY 1""")
def written_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks as PNG files, read back in their own size and resized to 20 x 5 pixels."""
    root = scratch_path(spark, "mask-files")
    rows = _images(spark, sf_dir)
    images.write_masks(rows, root)
    sizes = rows.select(images.png_name(F.col("relative")).alias("relative"), F.lit(20).alias("width"), F.lit(5).alias("height"))
    out = None
    for name, wanted in (("own", None), ("resized", sizes)):
        read = images.read_masks(spark, root, wanted)
        area = F.length(F.replace(F.hex("mask"), F.lit("00"), F.lit("")))
        part = read.select(_number(), F.lit(name).alias("size"), F.floor(area / 2).cast("long").alias("area"), F.md5(F.hex("mask")).alias("bytes"))
        out = part if out is None else out.union(part)
    return out


_BYTES = "md5(upper(string_agg(printf('%02x%02x%02x', r, g, b), '' ORDER BY k)))"


@query(f"WITH {_PX} SELECT vec_id, 'set' || vec_id % 3 || '/v' || vec_id || '.png' AS relative, 8 AS width, 8 AS height, {_BYTES} AS bytes FROM px GROUP BY 1")
def written_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour images as PNG files, read back."""
    root = scratch_path(spark, "image-files")
    rows = _images(spark, sf_dir)
    images.write_png(rows.select(images.png_name(F.col("relative")).alias("path"), "width", "height", F.lit(3).alias("channels"), "data"), root)
    return images.read_images(spark, root).select(_number(), "relative", "width", "height", F.md5(F.hex("data")).alias("bytes"))


@query("WITH f AS (SELECT 'set' || vec_id % 3 || '/v' || vec_id || '.png' AS relative FROM embeddings WHERE len(embedding) = 64) SELECT relative, row_number() OVER (ORDER BY relative) - 1 AS place FROM f")
def listed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image files below a folder, by relative path; files of other kinds beside them are not listed."""
    root = scratch_path(spark, "listed")
    rows = _images(spark, sf_dir)
    images.write_masks(rows, root)
    rows.select(F.col("relative").alias("value")).write.text(f"{root}/notes")
    return order.row_index(tables.image_files(spark, root), "relative").select("relative", F.col("index").alias("place"))


@query(f"WITH {_PX} SELECT vec_id, CASE WHEN vec_id % 3 = 1 THEN NULL ELSE md5(string_agg(CASE WHEN CASE WHEN vec_id % 3 = 2 THEN NOT m ELSE m END THEN '01' ELSE '00' END, '' ORDER BY k)) END AS gt FROM px GROUP BY 1")
def found_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The true mask of each image: in the same folder, else by its bare name, else none."""
    root = scratch_path(spark, "true-masks")
    rows = _images(spark, sf_dir)
    images.write_masks(rows.filter("vec_id % 3 = 0"), root)
    turned = F.pandas_udf(lambda m: m.map(lambda d: (np.frombuffer(d, np.uint8) == 0).astype(np.uint8).tobytes()), "binary")
    bare = F.element_at(F.split("relative", "/"), -1)
    images.write_masks(rows.filter("vec_id % 3 = 2").withColumns({"mask": turned("mask"), "relative": bare}), root)
    return images.true_masks(rows.select("vec_id", "relative", "width", "height"), root).select("vec_id", F.md5(F.hex("gt")).alias("gt"))


# ------------------------------------------------------------------ regions


def _around(source: str, name: str, radius: int, both: str) -> str:
    """SQL of a square window over the pixels inside the image: bool_or or bool_and of m."""
    return f"{name} AS MATERIALIZED (SELECT p.vec_id, p.x, p.y, {both}(q.m) AS m FROM {source} p JOIN {source} q ON p.vec_id = q.vec_id AND abs(p.x - q.x) <= {radius} AND abs(p.y - q.y) <= {radius} GROUP BY 1, 2, 3)"


def _filled(source: str, name: str) -> str:
    """SQL that fills holes: what the border does not reach through pixels outside the mask."""
    return f"""{name}_out(vec_id, x, y) AS (SELECT vec_id, x, y FROM {source} WHERE NOT m AND (x IN (0, 7) OR y IN (0, 7))
        UNION SELECT q.vec_id, q.x, q.y FROM {name}_out p JOIN {source} q ON p.vec_id = q.vec_id AND {_NEXT} WHERE NOT q.m),
    {name} AS MATERIALIZED (SELECT s.vec_id, s.x, s.y, o.vec_id IS NULL AS m FROM {source} s LEFT JOIN {name}_out o ON s.vec_id = o.vec_id AND s.x = o.x AND s.y = o.y)"""


def _labels(source: str, name: str) -> str:
    """SQL of regions: a pixel's label is the smallest pixel number that it reaches."""
    return f"""{name}_reach(vec_id, x, y, l) AS (SELECT vec_id, x, y, y * 8 + x FROM {source} WHERE m
        UNION SELECT q.vec_id, q.x, q.y, p.l FROM {name}_reach p JOIN {source} q ON p.vec_id = q.vec_id AND {_NEXT} WHERE q.m AND p.l < q.y * 8 + q.x),
    {name} AS MATERIALIZED (SELECT vec_id, x, y, min(l) AS l FROM {name}_reach GROUP BY 1, 2, 3)"""


_LEAST = 4


@query(f"""WITH RECURSIVE {_PX}, base AS (SELECT vec_id, x, y, m FROM px), {_labels("base", "region")}, {_filled("base", "solid")}, {_around("solid", "wide", 2, "bool_or")},
    {_around("wide", "eroded", 2, "bool_and")}, shut AS MATERIALIZED (SELECT vec_id, x, y, m AND x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5 AS m FROM eroded),
    {_labels("shut", "part")}, large AS (SELECT vec_id, l FROM part GROUP BY 1, 2 HAVING count(*) >= {_LEAST}),
    kept AS (SELECT s.vec_id, s.x, s.y, g.l IS NOT NULL AS m FROM shut s LEFT JOIN part p ON s.vec_id = p.vec_id AND s.x = p.x AND s.y = p.y LEFT JOIN large g ON p.vec_id = g.vec_id AND p.l = g.l), {_filled("kept", "done")},
    n AS (SELECT vec_id, count(*) AS regions, max(s) AS largest FROM (SELECT vec_id, l, count(*) AS s FROM region GROUP BY 1, 2) GROUP BY 1),
    f AS (SELECT vec_id, count(*) FILTER (WHERE m) AS filled FROM solid GROUP BY 1), c AS (SELECT vec_id, count(*) FILTER (WHERE m) AS cleaned, md5(string_agg(CASE WHEN m THEN '1' ELSE '0' END, '' ORDER BY y * 8 + x)) AS shape FROM done GROUP BY 1)
    SELECT f.vec_id, CAST(coalesce(regions, 0) AS BIGINT) AS regions, CAST(coalesce(largest, 0) AS BIGINT) AS largest, CAST(filled AS BIGINT) AS filled, CAST(cleaned AS BIGINT) AS cleaned, shape FROM f JOIN c ON f.vec_id = c.vec_id LEFT JOIN n ON f.vec_id = n.vec_id""")
def mask_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected regions, filled holes and cleaned masks by the kernels; the SQL spreads the smallest label between neighbours."""
    measured = masks.masks_udf(_regions, "regions long, largest long, filled long, cleaned long, shape string")
    return _images(spark, sf_dir).select("vec_id", measured("mask", "width", "height").alias("r")).select("vec_id", "r.regions", "r.largest", "r.filled", "r.cleaned", F.md5("r.shape").alias("shape"))


def _regions(mask: masks.Array) -> dict:
    labels, n = masks.components(mask)
    cleaned = masks.clean_mask(mask, least=_LEAST)
    return {"regions": n, "largest": int(np.bincount(labels.ravel())[1:].max()) if n else 0, "filled": int(masks.fill_holes(mask).sum()), "cleaned": int(cleaned.sum()), "shape": "".join(map(str, cleaned.astype(int).ravel()))}


# ------------------------------------------------------------------ backgrounds

_BG = f"""edge AS (SELECT *, r // 32 * 64 + g // 32 * 8 + b // 32 AS code FROM px WHERE x IN (0, 7) OR y IN (0, 7)),
    common AS (SELECT vec_id, arg_max(code, n * 1000 - code) AS code FROM (SELECT vec_id, code, count(*) AS n FROM edge GROUP BY 1, 2) GROUP BY 1),
    tone AS (SELECT e.vec_id, any_value(c.code) AS code, trunc(median(r)) AS mr, trunc(median(g)) AS mg, trunc(median(b)) AS mb FROM edge e JOIN common c ON e.vec_id = c.vec_id AND e.code = c.code GROUP BY 1),
    close AS (SELECT px.*, greatest(abs(r - mr), abs(g - mg), abs(b - mb)) <= 28 AS near, r // 32 * 64 + g // 32 * 8 + b // 32 = t.code AS same, x IN (0, 7) OR y IN (0, 7) AS rim FROM px JOIN tone t ON px.vec_id = t.vec_id),
    like_bg AS MATERIALIZED (SELECT *, CASE WHEN bool_or(rim AND near) OVER (PARTITION BY vec_id) THEN near ELSE same END AS ok FROM close),
    reach(vec_id, x, y) AS (SELECT vec_id, x, y FROM like_bg WHERE rim AND ok UNION SELECT q.vec_id, q.x, q.y FROM reach p JOIN like_bg q ON p.vec_id = q.vec_id AND {_NEXT} WHERE q.ok)"""


def _tone_sql(prefix: str) -> str:
    bright = "(0.299e0 * r + 0.587e0 * g + 0.114e0 * b)"
    top, low = "greatest(r, g, b)", "least(r, g, b)"
    parts = {"white_ratio": f"avg(CASE WHEN {low} >= 245 THEN 1.0e0 ELSE 0 END)", "dark_ratio": f"avg(CASE WHEN {top} <= 16 THEN 1.0e0 ELSE 0 END)", "std": f"stddev_pop({bright}) / 255", "saturation": f"avg(CASE WHEN {top} > 0 THEN ({top} - {low}) * 1.0e0 / {top} ELSE 0 END)", "neutral_ratio": f"avg(CASE WHEN {top} - {low} <= 12 THEN 1.0e0 ELSE 0 END)"}
    return ", ".join(f"{v} AS {prefix}_{k}" for k, v in parts.items())


def _spread_sql(source: str, prefix: str) -> str:
    return f"""{prefix}_bins AS (SELECT vec_id, n * 1.0e0 / sum(n) OVER (PARTITION BY vec_id) AS p FROM (SELECT vec_id, r // 32 * 64 + g // 32 * 8 + b // 32 AS code, count(*) AS n FROM {source} GROUP BY 1, 2)),
    {prefix}_spread AS (SELECT vec_id, max(p) AS {prefix}_dominant_bin_ratio, CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0.0e0 END AS {prefix}_color_entropy FROM {prefix}_bins GROUP BY 1)"""


_MEASURES = [f"{p}_{k}" for p in ("border", "background") for k in ("white_ratio", "dark_ratio", "std", "saturation", "neutral_ratio", "dominant_bin_ratio", "color_entropy")]
_ALL = ["global_white_ratio", "background_area_ratio", *_MEASURES, "context_score"]
_SCORE = "least(greatest(0.25e0 * (1 - background_dominant_bin_ratio) + 0.20e0 * background_color_entropy + 0.15e0 * background_std + 0.10e0 * background_saturation + 0.10e0 * (1 - background_white_ratio) + 0.10e0 * (1 - background_dark_ratio) + 0.10e0 * (1 - border_dominant_bin_ratio), 0), 1)"


@query(f"""WITH RECURSIVE {_PX}, {_BG}, back AS (SELECT px.* FROM px JOIN reach r ON px.vec_id = r.vec_id AND px.x = r.x AND px.y = r.y),
    behind AS (SELECT * FROM back UNION ALL SELECT * EXCLUDE (code) FROM edge WHERE vec_id NOT IN (SELECT vec_id FROM back)),
    a AS (SELECT vec_id, avg(CASE WHEN least(r, g, b) >= 245 THEN 1.0e0 ELSE 0 END) AS global_white_ratio FROM px GROUP BY 1), s AS (SELECT vec_id, count(*) / 64.0e0 AS background_area_ratio FROM back GROUP BY 1),
    e AS (SELECT vec_id, {_tone_sql("border")} FROM edge GROUP BY 1), k AS (SELECT vec_id, {_tone_sql("background")} FROM behind GROUP BY 1), {_spread_sql("edge", "border")}, {_spread_sql("behind", "background")},
    every AS (SELECT a.vec_id, global_white_ratio, coalesce(background_area_ratio, 0.0e0) AS background_area_ratio, e.* EXCLUDE (vec_id), k.* EXCLUDE (vec_id), border_dominant_bin_ratio, border_color_entropy, background_dominant_bin_ratio, background_color_entropy
        FROM a LEFT JOIN s USING (vec_id) JOIN e USING (vec_id) JOIN k USING (vec_id) JOIN border_spread USING (vec_id) JOIN background_spread USING (vec_id))
    SELECT vec_id, {", ".join(f"round_even({c if c != 'context_score' else _SCORE}, 6) AS {c}" for c in _ALL)} FROM every""")
def context_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Border and background measures of images; the SQL floods the background from the border."""

    @F.pandas_udf(", ".join(f"{c} double" for c in _ALL))
    def measured(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
        rows = [masks.context_metrics(np.frombuffer(d, np.uint8).reshape(h, w, 3)) for d, w, h in zip(data, width, height, strict=True)]
        return pd.DataFrame(rows, columns=_ALL)

    rows = _images(spark, sf_dir).select("vec_id", measured("data", "width", "height").alias("c"))
    return rows.select("vec_id", *(F.bround(f"c.{c}", 6).alias(c) for c in _ALL))


# ------------------------------------------------------------------ simple masks and rendering


@query(f"""WITH RECURSIVE {_PX}, fg AS (SELECT vec_id, x, y, CASE WHEN avg(CASE WHEN least(r, g, b) < 245 THEN 1.0e0 ELSE 0 END) OVER (PARTITION BY vec_id) < 0.005 THEN least(r, g, b) < 235 ELSE least(r, g, b) < 245 END AS m FROM px),
    {_around("fg", "wide", 2, "bool_or")}, {_around("wide", "shut", 2, "bool_and")}
    SELECT vec_id, 'generated_simple' AS status, round_even(count(*) FILTER (WHERE m) / 64.0e0, 6) AS area_ratio FROM shut WHERE vec_id % 4 <> 0 GROUP BY 1
    UNION ALL SELECT vec_id, 'mask_exists', round_even(count(*) FILTER (WHERE m) / 64.0e0, 6) FROM px WHERE vec_id % 4 = 0 GROUP BY 1""")
def simple_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks for images that have none: files after the run, with the area of each."""
    root = scratch_path(spark, "simple-masks")
    rows = _images(spark, sf_dir)
    images.write_masks(rows.filter("vec_id % 4 = 0"), root)
    done = images.materialise_masks(rows.select("relative", "width", "height", "data"), root)
    there = images.read_masks(spark, root).select("relative")
    # Each status comes with a file.
    out = done.withColumn("_file", images.png_name(F.col("relative"))).join(there.withColumnRenamed("relative", "_file"), "_file", "left_semi")
    return out.select(_number(), "status", F.bround("area_ratio", 6).alias("area_ratio"))


def _tint_sql(channel: str, tint: int) -> str:
    mixed = f"CAST(0.78 AS FLOAT) * CAST({channel} AS FLOAT) + CAST(0.22 AS FLOAT) * CAST({tint} AS FLOAT)"
    return f"CASE WHEN edge THEN {tint} WHEN m THEN CAST(floor({mixed}) AS INT) ELSE {channel} END"


@query(f"""WITH {_PX}, {_RIM},
    v AS (SELECT vec_id, k, 'raw' AS variant, r, g, b FROM rim UNION ALL SELECT vec_id, k, 'masked', CASE WHEN m THEN r ELSE 0 END, CASE WHEN m THEN g ELSE 0 END, CASE WHEN m THEN b ELSE 0 END FROM rim
      UNION ALL SELECT vec_id, k, 'mask_overlay', {_tint_sql("r", 255)}, {_tint_sql("g", 0)}, {_tint_sql("b", 0)} FROM rim)
    SELECT vec_id, variant, {_BYTES} AS bytes FROM v GROUP BY 1, 2""")
def variant_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image as it is, without its background, and with its mask tinted and outlined."""
    rows, out = _images(spark, sf_dir), None
    for variant in masks.IMAGE_VARIANTS:
        part = rows.select("vec_id", F.lit(variant).alias("variant"), F.md5(F.hex(masks.variant_column(variant)("data", "mask", "width", "height"))).alias("bytes"))
        out = part if out is None else out.union(part)
    return out


@query(f"""WITH {_PX}, {_RIM}
    SELECT 'masks/m/set' || vec_id % 3 || '/v' || vec_id || '.png' AS relative, md5(string_agg(CASE WHEN m THEN 'FFFFFF' ELSE '000000' END, '' ORDER BY k)) AS bytes FROM rim GROUP BY vec_id
    UNION ALL SELECT 'overlays/m/set' || vec_id % 3 || '/v' || vec_id || '.png', {_BYTES} FROM (SELECT vec_id, k, {_tint_sql("r", 255)} AS r, {_tint_sql("g", 0)} AS g, {_tint_sql("b", 0)} AS b FROM rim) GROUP BY vec_id""")
def saved_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask and overlay files of a method's results, read back as images."""
    root = scratch_path(spark, "predictions")
    images.save_predictions(_images(spark, sf_dir).withColumn("method", F.lit("m")), root)
    return images.read_images(spark, root).select("relative", F.md5(F.hex("data")).alias("bytes"))


# ------------------------------------------------------------------ segmentation and refinement runs


class Levels:
    """A segmenter by colour levels: dark reds for carpet, greens under the hint's number; it fails on some images."""

    def segment(self, image: masks.Array, method: str, query: str | None) -> tuple[masks.Array, list[float], float | None]:
        if method == "rug" and image[0, 0, 0] % 16 == 0:
            raise ValueError("not this one")
        found = image[..., 1] < int(query) if method == "hint" else image[..., 0] < (200 if method == "carpet" else 150)
        return found[None], [0.5], 0.25


_METHODS = {"hint": None, "carpet": "carpet.", "rug": "rug."}


def _part(a: str, b: str) -> str:
    return f"coalesce({a} * 1.0e0 / nullif({b}, 0), 0)"


@query(f"""WITH {_PX}, hinted AS (SELECT px.*, CASE vec_id % 3 WHEN 0 THEN 180 WHEN 1 THEN 120 END AS hint, max(CASE WHEN k = 0 THEN r END) OVER (PARTITION BY vec_id) AS corner FROM px),
    v AS (SELECT vec_id, m, 'hint' AS method, hint IS NOT NULL AS ok, coalesce(g < hint, false) AS p FROM hinted UNION ALL SELECT vec_id, m, 'carpet', true, r < 200 FROM hinted UNION ALL SELECT vec_id, m, 'rug', corner % 16 <> 0, corner % 16 <> 0 AND r < 150 FROM hinted),
    n AS (SELECT vec_id, method, any_value(ok) AS ok, count(*) FILTER (WHERE p) AS p, count(*) FILTER (WHERE m) AS g, count(*) FILTER (WHERE m AND p) AS i FROM v GROUP BY 1, 2)
    SELECT vec_id, method, round_even(CASE WHEN p + g = 0 THEN 1 ELSE {_part("i", "p + g - i")} END, 9) AS iou, round_even(CASE WHEN p + g = 0 THEN 1 ELSE {_part("2 * i", "p + g")} END, 9) AS dice, CAST(p AS BIGINT) AS mask_area, CASE WHEN ok THEN 0.25e0 END AS dino_score, CASE WHEN ok THEN 0.5e0 END AS sam_score,
      CASE WHEN ok THEN NULL WHEN method = 'hint' THEN 'LookupError: no hint prompt' ELSE 'ValueError: not this one' END AS error FROM n""")
def segmentation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A resumable run over two of three parts of the images, then over all: the log keeps the first results."""
    hint = F.when(F.col("vec_id") % 3 == 0, "180").when(F.col("vec_id") % 3 == 1, "120")
    rows = _images(spark, sf_dir).select(F.col("vec_id").cast("string").alias("image_name"), "data", "width", "height", F.col("mask").alias("gt"), hint.alias("hint_prompt"), "vec_id")
    log = WorkLog(spark, scratch_path(spark, "segmentation"), "image_name", buckets=2)
    segmentation.segmentation_run(log, rows.filter("vec_id % 3 <> 1"), _METHODS, Levels)
    done = segmentation.segmentation_run(log, rows, _METHODS, Levels)
    return done.select(F.col("image_name").cast("long").alias("vec_id"), "method", F.bround("iou", 9).alias("iou"), F.bround("dice", 9).alias("dice"), "mask_area", "dino_score", "sam_score", "error")


class Boxes:
    """A refiner that offers the whole box and its dark half; it fails on some images."""

    def refine(self, image: masks.Array, box: list[int]) -> tuple[masks.Array, list[float]]:
        if image[0, 0, 0] % 16 == 0:
            raise ValueError("not this one")
        whole = np.zeros(image.shape[:2], bool)
        whole[box[1] : box[3], box[0] : box[2]] = True
        return np.stack([whole, whole & (image[..., 0] < 180)]), [0.7, 0.9]


_ITEMS = f"""{_PX}, seed AS (SELECT vec_id, any_value(c) AS c, count(*) FILTER (WHERE m) AS s, greatest(min(x) FILTER (WHERE m) - 2, 0) AS x1, greatest(min(y) FILTER (WHERE m) - 2, 0) AS y1, least(max(x) FILTER (WHERE m) + 3, 8) AS x2, least(max(y) FILTER (WHERE m) + 3, 8) AS y2 FROM (SELECT px.*, max(CASE WHEN k = 0 THEN r END) OVER (PARTITION BY vec_id) AS c FROM px) GROUP BY 1),
    one AS (SELECT px.*, s.s, s.c, px.x >= x1 AND px.x < x2 AND px.y >= y1 AND px.y < y2 AS a, px.x >= x1 AND px.x < x2 AND px.y >= y1 AND px.y < y2 AND r < 180 AS b2 FROM px JOIN seed s ON px.vec_id = s.vec_id),
    fit AS (SELECT vec_id, any_value(s) AS s, any_value(c) AS c, count(*) FILTER (WHERE a) / 64.0e0 AS area1, count(*) FILTER (WHERE b2) / 64.0e0 AS area2, {_part("count(*) FILTER (WHERE a AND m)", "count(*) FILTER (WHERE a OR m)")} AS o1, {_part("count(*) FILTER (WHERE b2 AND m)", "count(*) FILTER (WHERE b2 OR m)")} AS o2 FROM one GROUP BY 1),
    pick AS (SELECT *, 0.65e0 * o2 + 0.30e0 * 0.9e0 - 0.05e0 * abs(area2 - s / 64.0e0) > 0.65e0 * o1 + 0.30e0 * 0.7e0 - 0.05e0 * abs(area1 - s / 64.0e0) AS second FROM fit),
    item AS (SELECT *, vec_id % 17 = 3 AS existing, CASE WHEN vec_id % 17 = 4 THEN 'missing_image_path' WHEN vec_id % 17 = 5 THEN 'missing_mask_path' WHEN vec_id % 17 = 6 THEN 'image_not_found' WHEN vec_id % 17 = 7 THEN 'seed_mask_not_found' WHEN s < 4 THEN 'seed_mask_too_small' WHEN c % 16 = 0 THEN 'failed:ValueError' ELSE 'written' END AS sam_status FROM pick)"""


def _refined(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = F.col("vec_id") % 17
    rows = _images(spark, sf_dir).select(
        F.col("vec_id").cast("string").alias("image_id"),
        F.when(n != 4, F.col("relative")).alias("path"),
        F.when(n != 5, F.lit("seed.png")).alias("seed_path"),
        F.when(n != 6, F.col("data")).alias("data"),
        F.when(n != 7, F.col("mask")).alias("seed"),
        "width",
        "height",
        F.lit("mask.png").alias("mask_field"),
        F.when(n == 3, "sam:x").otherwise("grounded").alias("mask_source"),
    )
    log = WorkLog(spark, scratch_path(spark, "refinement"), "image_id", buckets=2)
    return segmentation.refinement_run(log, rows, Boxes, least_seed=4 / 64)


@query(f"""WITH {_ITEMS} SELECT vec_id, sam_status, CASE WHEN ok THEN CASE WHEN second THEN 0.9e0 ELSE 0.7e0 END END AS predicted_iou, CASE WHEN ok THEN round_even(CASE WHEN second THEN o2 ELSE o1 END, 6) END AS overlap, CASE WHEN ok THEN round_even(CASE WHEN second THEN area2 ELSE area1 END, 6) END AS area_ratio
    FROM (SELECT *, sam_status = 'written' AS ok FROM item) WHERE NOT existing""")
def refinement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refined masks: the better of two candidates for each seed, and what kept the others from one."""
    return _refined(spark, sf_dir)[0].select(F.col("image_id").cast("long").alias("vec_id"), "sam_status", "predicted_iou", "overlap", "area_ratio")


@query(f"""WITH {_ITEMS}, n AS (SELECT * FROM item WHERE NOT existing) SELECT (SELECT CAST(count(*) AS BIGINT) FROM item) AS num_items, (SELECT CAST(count(*) AS BIGINT) FROM item WHERE existing) AS skipped_existing, CAST(count(*) FILTER (WHERE sam_status = 'written') AS BIGINT) AS written,
    CAST(count(*) FILTER (WHERE sam_status IN ('missing_mask_path', 'seed_mask_not_found')) AS BIGINT) AS skipped_missing_seed_mask, CAST(count(*) FILTER (WHERE sam_status IN ('missing_image_path', 'image_not_found')) AS BIGINT) AS skipped_missing_image,
    CAST(count(*) FILTER (WHERE sam_status = 'seed_mask_too_small') AS BIGINT) AS skipped_small_seed_mask, CAST(count(*) FILTER (WHERE sam_status LIKE 'failed:%') AS BIGINT) AS failures FROM n""")
def refinement_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven counters of a refinement run."""
    return _refined(spark, sf_dir)[1]
