"""Segmentation runs and mask refinement with pluggable models, one row an image and method."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolith.functions.masks import binary_iou, border_touch, center_score, clean_mask, mask_area, mask_box, mask_metrics, mask_of, squeeze_candidates
from annolith.operators.ranking import blended
from annolith.sources.versions import WorkLog


class Segmenter(Protocol):
    """masks, scores and detector score (or None) of an image for a method."""

    def segment(self, image: np.ndarray, method: str, query: str | None) -> tuple[np.ndarray, list[float], float | None]: ...


RESULT = "image_name string, method string, iou double, dice double, precision double, recall double, mask_area long, area_ratio double, dino_score double, sam_score double, inference_time double, mask binary, error string"


def main_object(masks: np.ndarray, scores: list[float]) -> int:
    """The candidate with the best blend of area, place, border and predicted iou; the first on ties."""
    best, top = 0, -np.inf
    for k, mask in enumerate(masks):
        value = -1e9 if not mask.any() else 0.60 * float(mask.mean()) + 0.30 * center_score(mask) - 0.20 * border_touch(mask)
        value += 0.05 * scores[k] if k < len(scores) else 0.0
        if value > top:
            best, top = k, value
    return best


#: The method whose query text is the image's own.
HINT = "hint"


def segment(images: DataFrame, methods: dict[str, str | None], load: Callable[[], Segmenter], clean: dict[str, int] | None = None) -> DataFrame:
    """RESULT rows of images (image_name, data: RGB bytes, width, height, gt: mask bytes or NULL, and hint_prompt if HINT is among the
    methods), one for each method.

    methods: name to query text.  A failing method gives a row with its error and an empty mask, an image without a hint an
    empty mask; metrics are NULL without gt.  clean: radius and least of masks.clean_mask, which then runs over each mask.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = load()
        for part in parts:
            rows = []
            for row in part.itertuples(index=False):
                image = np.frombuffer(row.data, np.uint8, count=row.width * row.height * 3).reshape(row.height, row.width, 3)
                gt = None if row.gt is None else mask_of(row.gt, row.width, row.height)
                for method, text in methods.items():
                    query = row.hint_prompt if method == HINT else text
                    began, error, dino, score, mask = time.perf_counter(), None, None, None, np.zeros((row.height, row.width), bool)
                    try:
                        if method == HINT and not (query or "").strip():
                            raise LookupError("no hint prompt")
                        found, scores, dino = engine.segment(image, method, query)
                        found = squeeze_candidates(found)
                        if len(found):
                            k = main_object(found, scores) if query is None else int(np.argmax(scores)) if scores else 0
                            mask, score = found[k], scores[k] if k < len(scores) else None
                            mask = clean_mask(mask, **clean) if clean else mask
                    except Exception as problem:  # noqa: BLE001 - reported in the row
                        error = f"{type(problem).__name__}: {problem}"
                    spent = time.perf_counter() - began
                    measured = mask_metrics(mask, gt) if gt is not None else dict.fromkeys(("iou", "dice", "precision", "recall"))
                    rows.append((row.image_name, method, *measured.values(), *mask_area(mask), dino, score, spent, mask.astype(np.uint8).tobytes(), error))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in RESULT.split(", ")])

    return images.select("image_name", "data", "width", "height", "gt", *(["hint_prompt"] if HINT in methods else [])).mapInPandas(run, RESULT)


class Refiner(Protocol):
    """Candidate masks and their predicted iou for a box."""

    def refine(self, image: np.ndarray, box: list[int]) -> tuple[np.ndarray, list[float]]: ...


REFINED = "image_id string, status string, box array<int>, predicted_iou double, overlap double, area_ratio double, mask binary"


def refine(images: DataFrame, load: Callable[[], Refiner], least: float = 0.0, most: float = 1.0) -> DataFrame:
    """REFINED rows of images (image_id, data, width, height, seed: mask bytes or NULL).

    status: written, missing_seed, empty_seed, no_candidates, area_out_of_range or failed.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = load()
        for part in parts:
            rows = []
            for row in part.itertuples(index=False):
                status, box, iou, overlap, area, mask = "written", None, None, None, None, None
                seed = None if row.seed is None else mask_of(row.seed, row.width, row.height)
                if seed is None:
                    status = "missing_seed"
                elif (box := mask_box(seed)) is None:
                    status = "empty_seed"
                else:
                    try:
                        image = np.frombuffer(row.data, np.uint8, count=row.width * row.height * 3).reshape(row.height, row.width, 3)
                        found, scores = engine.refine(image, box)
                        found, top = squeeze_candidates(found), -1e9
                        for k, candidate in enumerate(found):
                            same, model = binary_iou(candidate, seed), float(scores[k]) if k < len(scores) else 0.0
                            value = blended(same, model, abs(float(candidate.mean()) - float(seed.mean())))
                            if value > top:
                                top, mask, iou, overlap, area = value, candidate, model, same, float(candidate.mean())
                        status = "no_candidates" if mask is None else "written" if least <= area <= most else "area_out_of_range"
                    except Exception:  # noqa: BLE001 - counted by status
                        status, mask = "failed", None
                rows.append((row.image_id, status, box, iou, overlap, area, mask.astype(np.uint8).tobytes() if mask is not None and status == "written" else None))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in REFINED.split(", ")])

    return images.select("image_id", "data", "width", "height", "seed").mapInPandas(run, REFINED)


# ------------------------------------------------------------------ whole runs


def segmentation_run(log: WorkLog, images: DataFrame, methods: dict[str, str | None], load: Callable[[], Segmenter], clean: dict[str, int] | None = None) -> DataFrame:
    """segment over images that the log (by image_name) has no results of; all results so far."""
    return log.run(images, lambda rows: segment(rows, methods, load, clean))


ITEM = "image_id string, sam_status string, box array<int>, predicted_iou double, overlap double, seed_area double, area_ratio double, mask binary, sam_error string"


def refine_items(items: DataFrame, load: Callable[[], Refiner], field: str = "mask_path", least_seed: float = 0.0, share: float = 0.08) -> DataFrame:
    """ITEM rows of items (image_id, path, seed_path, data: RGB bytes or NULL, seed: mask bytes or NULL, width, height).

    sam_status: missing_image_path, missing_FIELD, image_not_found and seed_mask_not_found without a model; then
    seed_mask_too_small, seed_box_failed, failed:ERROR or written.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    status = F.when(blank("path"), "missing_image_path").when(blank("seed_path"), f"missing_{field}").when(F.col("data").isNull(), "image_not_found").when(F.col("seed").isNull(), "seed_mask_not_found")
    names = [x.split()[0] for x in ITEM.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = None
        for part in parts:
            rows = []
            for row in part.itertuples(index=False):
                out = dict.fromkeys(names) | {"image_id": row.image_id, "sam_status": row.sam_status}
                rows.append(out)
                if out["sam_status"] is not None:
                    continue
                try:
                    seed = mask_of(row.seed, row.width, row.height)
                    out["seed_area"] = mask_area(seed)[1]
                    out["sam_status"] = "seed_mask_too_small" if out["seed_area"] < least_seed else "seed_box_failed" if (box := mask_box(seed, share)) is None else None
                    if out["sam_status"] is not None:
                        continue
                    engine = engine or load()
                    image = np.frombuffer(row.data, np.uint8, count=row.width * row.height * 3).reshape(row.height, row.width, 3)
                    found, scores = engine.refine(image, box)
                    best = None
                    for k, mask in enumerate(squeeze_candidates(found)):
                        model, same = float(scores[k]) if k < len(scores) else 0.0, binary_iou(mask, seed)
                        value = blended(same, model, abs(mask_area(mask)[1] - out["seed_area"]))
                        if best is None or value > best[0]:
                            best = (value, model, same, mask)
                    _, model, same, mask = best
                    out |= {"sam_status": "written", "box": box, "predicted_iou": round(model, 6), "overlap": round(same, 6), "area_ratio": round(mask_area(mask)[1], 6), "mask": mask.astype(np.uint8).tobytes()}
                except Exception as problem:  # noqa: BLE001 - counted by status
                    out |= {"sam_status": f"failed:{type(problem).__name__}", "sam_error": str(problem)[:500]}
            yield pd.DataFrame(rows, columns=names)

    return items.select("image_id", "data", "seed", "width", "height", status.alias("sam_status")).mapInPandas(run, ITEM)


def refinement_run(log: WorkLog, items: DataFrame, load: Callable[[], Refiner], same_field: bool = True, overwrite: bool = False, **options: object) -> tuple[DataFrame, DataFrame]:
    """(results, counters) of refining items (those of refine_items, with mask_field and mask_source of what is there).

    Items that have a refined mask already (the field is set and, where the seed's own field is written, its source begins with
    sam:) are left alone unless overwrite; the log (by image_id) keeps what earlier runs did.
    """
    there = F.coalesce(F.col("mask_field"), F.lit("")) != ""
    if same_field:
        there = there & F.coalesce(F.col("mask_source"), F.lit("")).startswith("sam:")
    there = there & F.lit(not overwrite)
    results = log.run(items.filter(~there), lambda rows: refine_items(rows, load, **options))
    said, count = F.col("sam_status"), lambda condition, name: F.count_if(condition).cast("long").alias(name)
    done = results.agg(
        count(said == "written", "written"),
        count(said.isin("seed_mask_not_found") | said.startswith("missing_") & (said != "missing_image_path"), "skipped_missing_seed_mask"),
        count(said.isin("missing_image_path", "image_not_found"), "skipped_missing_image"),
        count(said == "seed_mask_too_small", "skipped_small_seed_mask"),
        count((said == "seed_box_failed") | said.startswith("failed:"), "failures"),
    )
    all_items = items.agg(F.count("*").cast("long").alias("num_items"), count(there, "skipped_existing"))
    return results, all_items.crossJoin(done)  # one row each
