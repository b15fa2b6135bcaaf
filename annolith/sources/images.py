"""Image and mask files: decoding readers, and a sink for PNG files.

Files are decoded by Spark's own image source (JVM, one task a group of files); grey values, colour order and
resizing are Arrow functions on the decoded bytes.  Files are written by a Python data source: a task writes
its files into a staging folder of its own and moves them to their places when it is done, so that a task that
fails or runs twice leaves nothing half-written.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType, StructType

from annolith.functions.masks import Array, collage, mask_as_rgb, mask_of, nearest, overlay, simple_mask
from annolith.session import kept, many_files
from annolith.sources.prune import listed
from annolith.sources.tables import IMAGE_ENDINGS, first_existing, mask_candidates

#: A pixel of a mask file counts from this grey value on.
MASK_LEVEL = 128


# ------------------------------------------------------------------ readers


def _relative(path: Column, root: str) -> Column:
    """A path below root, whatever scheme either has."""
    plain = lambda text: re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", text)
    return F.substr(F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/"), F.lit(len(plain(root).rstrip("/")) + 2))


def gray(pixels: Array) -> Array:
    """Grey values of h x w, h x w x 3 or h x w x 4 pixels in the order blue, green, red; alpha is ignored."""
    if pixels.ndim == 2 or pixels.shape[-1] == 1:
        return pixels.reshape(pixels.shape[:2])
    b, g, r = (pixels[..., k].astype(np.uint32) for k in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.uint8)


def _pixels(data: bytes, width: int, height: int, channels: int) -> Array:
    return np.frombuffer(data, np.uint8, count=width * height * channels).reshape(height, width, channels)


@F.pandas_udf(BinaryType())
def _as_rgb(data: pd.Series, width: pd.Series, height: pd.Series, channels: pd.Series) -> pd.Series:
    out = []
    for d, w, h, c in zip(data, width, height, channels, strict=True):
        if d is None or w <= 0:
            out.append(None)
            continue
        p = _pixels(d, w, h, c)
        out.append((np.repeat(p, 3, axis=2) if c == 1 else p[..., 2::-1]).tobytes())
    return pd.Series(out)


@F.pandas_udf(BinaryType())
def _as_mask(data: pd.Series, width: pd.Series, height: pd.Series, channels: pd.Series, to_width: pd.Series, to_height: pd.Series) -> pd.Series:
    out = []
    for d, w, h, c, tw, th in zip(data, width, height, channels, to_width, to_height, strict=True):
        if d is None or w <= 0:
            out.append(None)
            continue
        grey = gray(_pixels(d, w, h, c))
        if not (pd.isna(tw) or pd.isna(th)):
            grey = nearest(grey, int(th), int(tw))
        out.append((grey >= MASK_LEVEL).astype(np.uint8).tobytes())
    return pd.Series(out)


def _decoded(spark: SparkSession, root: str) -> DataFrame:
    """relative, width, height, channels, data of all image files below root; width is -1 where decoding failed."""
    many_files(spark)
    files = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "false").load(root)
    origin = F.url_decode(F.replace(F.col("image.origin"), F.lit("+"), F.lit("%2B")))  # a URI with escapes
    rows = files.select(_relative(origin, root).alias("relative"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")
    ending = F.concat(F.lit("."), F.lower(F.substring_index("relative", ".", -1)))
    return rows.filter(ending.isin(IMAGE_ENDINGS))


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """relative, width, height, data (RGB bytes) of the image files below root; data is NULL where decoding failed."""
    rows = _decoded(spark, root)
    return rows.select("relative", "width", "height", _as_rgb("data", "width", "height", "channels").alias("data"))


def read_masks(spark: SparkSession, root: str, sizes: DataFrame | None = None) -> DataFrame:
    """relative, width, height, mask (a byte a pixel, grey values over 127 count) of the mask files below root.

    sizes: relative, width, height wanted; masks are resized to them by the nearest pixel.  Masks without a wanted size
    keep their own; mask is NULL where decoding failed.
    """
    rows = _decoded(spark, root)
    if sizes is None:
        rows = rows.withColumns({"_width": F.lit(None).cast("int"), "_height": F.lit(None).cast("int")})
    else:
        rows = rows.join(sizes.select("relative", F.col("width").cast("int").alias("_width"), F.col("height").cast("int").alias("_height")), "relative", "left")
    mask = _as_mask("data", "width", "height", "channels", "_width", "_height")
    return rows.select("relative", F.coalesce("_width", "width").alias("width"), F.coalesce("_height", "height").alias("height"), mask.alias("mask"))


def true_masks(images: DataFrame, root: str) -> DataFrame:
    """images (relative, width, height, ...) with gt: the mask of the first file below root that may be its mask, in the image's size."""
    spark = images.sparkSession
    files = _decoded(spark, root)
    # Names come from a listing, which opens no file.
    found = first_existing(images.select("relative"), mask_candidates(F.col("relative")), listed(spark, root).select(F.col("relative").alias("path")), "relative")
    own = files.select(F.col("relative").alias("path"), F.col("width").alias("_w"), F.col("height").alias("_h"), F.col("channels").alias("_c"), F.col("data").alias("_d"))
    out = images.join(found, "relative", "left").join(own, "path", "left")
    return out.withColumn("gt", _as_mask("_d", F.coalesce("_w", F.lit(-1)), F.coalesce("_h", F.lit(-1)), F.coalesce("_c", F.lit(1)), "width", "height")).drop("path", "_w", "_h", "_c", "_d")


# ------------------------------------------------------------------ the PNG sink


def png(pixels: Array) -> bytes:
    """A PNG file of h x w grey or h x w x 3 RGB bytes."""
    height, width = pixels.shape[:2]
    lines = np.zeros((height, 1 + width * (1 if pixels.ndim == 2 else 3)), np.uint8)  # each line begins with its filter, none
    lines[:, 1:] = pixels.reshape(height, -1)
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if pixels.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines.tobytes(), 6)) + part(b"IEND", b"")


@dataclass
class Written(WriterCommitMessage):
    files: int
    bytes: int


class PngWriter(DataSourceArrowWriter):
    def __init__(self, root: str) -> None:
        self.root, self.run = root, uuid.uuid4().hex

    def _place(self):  # noqa: ANN202
        from pyarrow import fs

        local = re.sub("^file:/*", "/", self.root)  # Spark writes file:/x for file:///x
        found, root = fs.FileSystem.from_uri("file://" + local if local.startswith("/") else self.root)
        return found, root.rstrip("/"), fs

    def write(self, iterator: Iterator) -> Written:
        files, root, _ = self._place()
        staging = f"{root}/_staging-{self.run}/{uuid.uuid4().hex}"
        files.create_dir(staging, recursive=True)
        names, size = [], 0
        for batch in iterator:
            for row in batch.to_pylist():
                pixels = _pixels(row["data"], row["width"], row["height"], row["channels"])
                body = png(pixels[..., 0] if row["channels"] == 1 else pixels)
                with files.open_output_stream(f"{staging}/{len(names)}") as out:
                    out.write(body)
                names.append(row["path"])
                size += len(body)
        for folder in {name.rpartition("/")[0] for name in names}:
            files.create_dir(f"{root}/{folder}", recursive=True)
        for k, name in enumerate(names):
            files.move(f"{staging}/{k}", f"{root}/{name}")
        files.delete_dir(staging)
        return Written(len(names), size)

    def _clear(self) -> None:
        files, root, fs = self._place()
        staging = f"{root}/_staging-{self.run}"
        if files.get_file_info(staging).type == fs.FileType.Directory:
            files.delete_dir(staging)

    def commit(self, messages: list) -> None:
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()


class PngSink(DataSource):
    """Writes rows (path below the folder, width, height, channels: 1 or 3, data: bytes) as PNG files; option path: the folder, which all
    executors reach by its URI."""

    @classmethod
    def name(cls) -> str:
        return "annolith_png"

    def schema(self) -> str:
        return "path string, width int, height int, channels int, data binary"

    def writer(self, schema: StructType, overwrite: bool) -> PngWriter:
        return PngWriter(self.options["path"])


def write_png(rows: DataFrame, root: str) -> None:
    """rows: path, width, height, channels, data.  Files with the same path are replaced."""
    rows.sparkSession.dataSource.register(PngSink)
    kinds = {"path": "string", "width": "int", "height": "int", "channels": "int", "data": "binary"}
    rows.select(*(F.col(c).cast(t).alias(c) for c, t in kinds.items())).write.format("annolith_png").mode("append").save(root)


def write_masks(masks: DataFrame, root: str) -> None:
    """masks: relative, width, height, mask (0 or not, a byte a pixel), as black and white PNG files with the ending .png."""
    level = F.pandas_udf(lambda m: m.map(lambda d: ((np.frombuffer(d, np.uint8) > 0) * np.uint8(255)).tobytes()), "binary")
    write_png(masks.select(png_name(F.col("relative")).alias("path"), "width", "height", F.lit(1).alias("channels"), level("mask").alias("data")), root)


def png_name(relative: Column, folder: str = "") -> Column:
    return F.concat(F.lit(folder), F.regexp_replace(relative, r"\.[^./]+$", ""), F.lit(".png"))


OUTPUT = "path string, width int, height int, channels int, data binary"


def save_predictions(results: DataFrame, root: str, alpha: float = 0.22) -> None:
    """Mask and overlay files of results (relative, method, width, height, data: RGB bytes, mask): masks/METHOD/... and overlays/METHOD/..."""

    def made(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples(index=False):
                stem = re.sub(r"\.[^./]+$", "", r.relative)
                image, mask = _pixels(r.data, r.width, r.height, 3), mask_of(r.mask, r.width, r.height)
                rows.append((f"masks/{r.method}/{stem}.png", r.width, r.height, 1, (mask * np.uint8(255)).tobytes()))
                rows.append((f"overlays/{r.method}/{stem}.png", r.width, r.height, 3, overlay(image, mask, alpha).tobytes()))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "channels", "data"])

    write_png(results.select("relative", "method", "width", "height", "data", "mask").mapInPandas(made, OUTPUT), root)


def save_collages(results: DataFrame, root: str, methods: list[str], columns: int = 3, width: int = 420, height: int = 320) -> None:
    """collages/...: of each image the image, its true mask (the image again without one) and an overlay for each method.

    results: relative, method, width, height, data, gt (NULL without), mask.  A row an image is gathered: its methods are few.
    Panels carry no text.
    """
    own = results.groupBy("relative").agg(F.first("width").alias("width"), F.first("height").alias("height"), F.first("data").alias("data"), F.first("gt").alias("gt"), F.map_from_entries(F.collect_list(F.struct("method", "mask"))).alias("masks"))

    def made(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples(index=False):
                image = _pixels(r.data, r.width, r.height, 3)
                panels = [image, image if r.gt is None else mask_as_rgb(mask_of(r.gt, r.width, r.height))]
                found = dict(r.masks)
                panels += [overlay(image, mask_of(found[m], r.width, r.height)) if found.get(m) is not None else image for m in methods]
                sheet = collage(panels, columns, width, height)
                rows.append(("collages/" + re.sub(r"\.[^./]+$", "", r.relative) + ".png", sheet.shape[1], sheet.shape[0], 3, sheet.tobytes()))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "channels", "data"])

    write_png(own.mapInPandas(made, OUTPUT), root)


def _exists(spark: SparkSession, root: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def materialise_masks(images: DataFrame, root: str, overwrite: bool = False) -> DataFrame:
    """relative, status, area_ratio after each image (relative, width, height, data) has a mask file below root.

    status: mask_exists (its own area counts) or generated_simple; the simple mask is made for images without a file, or for all
    with overwrite.  The files are there when the function returns.
    """
    spark = images.sparkSession
    ratio = F.pandas_udf(lambda m: m.map(lambda d: float((np.frombuffer(d, np.uint8) > 0).mean())), "double")
    wanted = images.withColumn("path", png_name(F.col("relative")))
    there = None
    if not overwrite and _exists(spark, root):
        there = read_masks(spark, root).filter("mask is not null").select(F.col("relative").alias("path"), F.lit("mask_exists").alias("status"), ratio("mask").alias("area_ratio"))
        # Listed before anything is written, so that new files do not count.
        there = kept(there, "there")
        wanted = wanted.join(there.select("path"), "path", "left_anti")

    @F.pandas_udf("binary")
    def simple(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        return pd.Series([simple_mask(_pixels(d, w, h, 3)).astype(np.uint8).tobytes() for d, w, h in zip(data, width, height, strict=True)])

    made = kept(wanted.filter("data is not null").select("relative", "path", "width", "height", simple("data", "width", "height").alias("mask")), "masks")
    write_masks(made, root)
    out = made.select("relative", F.lit("generated_simple").alias("status"), ratio("mask").alias("area_ratio"))
    if there is not None:
        out = out.union(images.select("relative").withColumn("path", png_name(F.col("relative"))).join(there, "path").select("relative", "status", "area_ratio"))
    return out
