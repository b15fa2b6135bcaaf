"""Masks and images as arrays.

Masks are binary columns of one byte a pixel (0 or not) with a width and a height; images are rows
of three bytes a pixel.  Kernels take and return NumPy arrays; column functions wrap them in Arrow
batches.  What is plain arithmetic on measured numbers is a Column expression.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Array = np.ndarray


def mask_of(data: bytes, width: int, height: int) -> Array:
    return (np.frombuffer(data, np.uint8, count=width * height) > 0).reshape(height, width)


def mask_metrics(pred: Array, gt: Array) -> dict[str, float]:
    """iou, dice, precision and recall; all 1 for two empty masks."""
    p, g, both = int(pred.sum()), int(gt.sum()), int((pred & gt).sum())
    if p == 0 and g == 0:
        return dict.fromkeys(("iou", "dice", "precision", "recall"), 1.0)
    part = lambda a, b: a / b if b else 0.0
    return {"iou": part(both, p + g - both), "dice": part(2 * both, p + g), "precision": part(both, p), "recall": part(both, g)}


def mask_area(mask: Array) -> tuple[int, float]:
    return int(mask.sum()), float(mask.mean()) if mask.size else 0.0


def binary_iou(a: Array, b: Array) -> float:
    """0 for an empty union."""
    union = int((a | b).sum())
    return int((a & b).sum()) / union if union else 0.0


def mask_box(mask: Array, share: float = 0.08) -> list[int] | None:
    """x1, y1, x2, y2 around the mask (ends exclusive), padded by a share of its size (2 pixels at least), inside the image."""
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return None
    box = []
    for places, limit in ((xs, mask.shape[1]), (ys, mask.shape[0])):
        low, high = int(places.min()), int(places.max()) + 1
        pad = max(2, round((high - low) * share))
        box.append((max(0, low - pad), min(limit, high + pad)))
    return [box[0][0], box[1][0], box[0][1], box[1][1]]


def _shifted(mask: Array, radius: int, outside: bool | None, combine: Callable) -> Array:
    """Square window of 2 * radius + 1 pixels, one axis after the other; outside: what lies beyond the image (None: its edge)."""
    out = mask
    for axis in (0, 1):
        around = [(radius, radius) if k == axis else (0, 0) for k in (0, 1)]
        padded = np.pad(out, around, mode="edge") if outside is None else np.pad(out, around, constant_values=outside)
        n = mask.shape[axis]
        parts = [np.take(padded, range(k, k + n), axis) for k in range(2 * radius + 1)]
        out = combine.reduce(parts)
    return out


def dilate(mask: Array, radius: int) -> Array:
    return _shifted(mask, radius, False, np.logical_or)


def erode(mask: Array, radius: int) -> Array:
    return _shifted(mask, radius, False, np.logical_and)


def components(mask: Array) -> tuple[Array, int]:
    """Labels from 1 of 4-connected regions, by runs of rows joined with union-find."""
    height, width = mask.shape
    labels, parent = np.zeros((height, width), np.int64), [0]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for y in range(height):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask[y].astype(np.int8), [0]])))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            above = {find(int(v)) for v in np.unique(labels[y - 1, a:b]) if v} if y else set()
            own = min(above, default=len(parent))
            if own == len(parent):
                parent.append(own)
            for v in above:
                parent[v] = own
            labels[y, a:b] = own
    roots = np.array([find(k) for k in range(len(parent))])
    names, flat = np.unique(roots[labels], return_inverse=True)
    flat = flat.reshape(labels.shape)
    return (flat if names[0] == 0 else flat + 1), len(names) - (names[0] == 0)


def fill_holes(mask: Array) -> Array:
    """Background that the image's border does not reach becomes mask."""
    labels, _ = components(~mask)
    outer = np.unique(np.concatenate([labels[0], labels[-1], labels[:, 0], labels[:, -1]]))
    return mask | ((labels > 0) & ~np.isin(labels, outer))


def clean_mask(mask: Array, radius: int = 2, least: int = 500) -> Array:
    """Holes filled, closed with a 5 x 5 window (what lies beyond the image is outside, so the frame is lost), small regions
    dropped, holes filled again."""
    closed = erode(dilate(fill_holes(mask), radius), radius)
    labels, n = components(closed)
    sizes = np.bincount(labels.ravel(), minlength=n + 1)
    return fill_holes((labels > 0) & (sizes[labels] >= least))


def apply_mask(image: Array, mask: Array, background: int = 0) -> Array:
    return np.where(mask[..., None], image, np.uint8(background))


def boundary(mask: Array) -> Array:
    """Mask pixels with a neighbour (of four) outside."""
    padded = np.pad(mask, 1)
    inner = padded[:-2, 1:-1] & padded[2:, 1:-1] & padded[1:-1, :-2] & padded[1:-1, 2:]
    return mask & ~inner


def overlay(image: Array, mask: Array, alpha: float = 0.22, tint: tuple[int, int, int] = (255, 0, 0), edge: tuple[int, int, int] = (255, 0, 0)) -> Array:
    out = image.astype(np.float32)
    out[mask] = (1 - alpha) * out[mask] + alpha * np.array(tint, np.float32)
    out[boundary(mask)] = edge
    return np.clip(out, 0, 255).astype(np.uint8)


def border_mask(height: int, width: int, share: float = 0.08) -> Array:
    edge = max(1, int(min(height, width) * share))
    out = np.ones((height, width), bool)
    out[edge : height - edge, edge : width - edge] = False
    return out


def _colour_codes(pixels: Array, step: int) -> Array:
    bins = -(-256 // step)
    q = np.minimum(pixels.astype(np.int64) // step, bins - 1)
    return (q[..., 0] * bins + q[..., 1]) * bins + q[..., 2]


def colour_distribution(pixels: Array, step: int = 32) -> tuple[float, float]:
    """(share of the largest quantised colour, entropy over that of equal shares of the colours there)."""
    if not len(pixels):
        return 1.0, 0.0
    counts = np.bincount(_colour_codes(pixels, step))
    share = counts[counts > 0] / len(pixels)
    return float(share.max()), float(-(share * np.log(share)).sum() / np.log(len(share))) if len(share) > 1 else 0.0


def background_region(image: Array, tolerance: int = 28, step: int = 32) -> Array:
    """Pixels that the border reaches, four-connected, through colours near the median of its commonest quantised colour;
    if no border pixel is near, through that quantised colour itself."""
    edge = border_mask(*image.shape[:2])
    codes = _colour_codes(image, step)
    common = int(np.bincount(codes[edge]).argmax())
    middle = np.median(image[edge & (codes == common)], axis=0).astype(np.int16)
    near = np.abs(image.astype(np.int16) - middle).max(-1) <= tolerance
    if not (edge & near).any():
        near = codes == common
    labels, _ = components(near)
    return (labels > 0) & np.isin(labels, np.unique(labels[edge & near]))


def _tone(pixels: Array, white: int, dark: int, neutral: int) -> dict[str, float]:
    p = pixels.astype(np.float64)
    top, low = p.max(1), p.min(1)
    gray = 0.299 * p[:, 0] + 0.587 * p[:, 1] + 0.114 * p[:, 2]
    return {"white_ratio": float((low >= white).mean()), "dark_ratio": float((top <= dark).mean()), "std": float(gray.std() / 255), "saturation": float(np.where(top > 0, (top - low) / np.maximum(top, 1), 0).mean()), "neutral_ratio": float((top - low <= neutral).mean())}


def context_metrics(image: Array, white: int = 245, dark: int = 16, neutral: int = 12, step: int = 32, tolerance: int = 28) -> dict[str, float]:
    """The 16 measures of border and background, and context_score; without a background the border stands for it."""
    edge, region = image[border_mask(*image.shape[:2])], background_region(image, tolerance, step)
    behind = image[region] if region.any() else edge
    out = {"global_white_ratio": float((image.min(-1) >= white).mean()), "background_area_ratio": float(region.mean())}
    for name, pixels in (("border", edge), ("background", behind)):
        dominant, entropy = colour_distribution(pixels, step)
        out.update({f"{name}_{k}": v for k, v in _tone(pixels, white, dark, neutral).items()}, **{f"{name}_dominant_bin_ratio": dominant, f"{name}_color_entropy": entropy})
    b = {k.removeprefix("background_"): v for k, v in out.items() if k.startswith("background_")}
    score = 0.25 * (1 - b["dominant_bin_ratio"]) + 0.20 * b["color_entropy"] + 0.15 * b["std"] + 0.10 * b["saturation"] + 0.10 * (1 - b["white_ratio"]) + 0.10 * (1 - b["dark_ratio"]) + 0.10 * (1 - out["border_dominant_bin_ratio"])
    return {**out, "context_score": float(np.clip(score, 0, 1))}


def context_score(columns: dict[str, Column]) -> Column:
    """The same score from measured columns."""
    c = columns
    total = (
        0.25 * (1.0 - c["background_dominant_bin_ratio"])
        + 0.20 * c["background_color_entropy"]
        + 0.15 * c["background_std"]
        + 0.10 * c["background_saturation"]
        + 0.10 * (1.0 - c["background_white_ratio"])
        + 0.10 * (1.0 - c["background_dark_ratio"])
        + 0.10 * (1.0 - c["border_dominant_bin_ratio"])
    )
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def context_kept(c: dict[str, Column], score: float, border_white: float, border_dominant: float, background_white: float, least_area: float) -> Column:
    """Score and border limits; the background limit only where the background is large enough."""
    return (c["context_score"] >= score) & (c["border_white_ratio"] <= border_white) & (c["border_dominant_bin_ratio"] <= border_dominant) & ((c["background_area_ratio"] < least_area) | (c["background_white_ratio"] <= background_white))


def simple_mask(image: Array, threshold: int = 245, again: int = 235, least: float = 0.005) -> Array:
    """Pixels that are not near white (by a lower threshold if those are hardly any), closed with a 5 x 5 window."""
    mask = image.min(-1) < threshold
    if mask.mean() < least:
        mask = image.min(-1) < again
    return _shifted(_shifted(mask, 2, None, np.logical_or), 2, None, np.logical_and)


def centroid(mask: Array) -> tuple[float, float]:
    ys, xs = np.nonzero(mask)
    return (float(ys.mean()), float(xs.mean())) if len(ys) else (mask.shape[0] / 2, mask.shape[1] / 2)


def border_touch(mask: Array, width: int = 4) -> float:
    """Share of the mask's pixels that lie on the image's frame."""
    frame = np.ones(mask.shape, bool)
    frame[width:-width, width:-width] = False
    return float((mask & frame).sum() / mask.sum()) if mask.any() else 0.0


def center_score(mask: Array) -> float:
    """1 less the centroid's distance from the image's centre over the largest."""
    cy, cx = centroid(mask)
    hy, hx = (mask.shape[0] - 1) / 2, (mask.shape[1] - 1) / 2
    return 1.0 - float(np.hypot(cy - hy, cx - hx)) / (float(np.hypot(hy, hx)) or 1.0)


def masks_udf(kernel: Callable[..., dict], schema: str) -> Callable[..., Column]:
    """A column function of (mask, [mask,] width, height) from a kernel on arrays."""

    @F.pandas_udf(schema)
    def run(*columns: pd.Series) -> pd.DataFrame:
        *masks, widths, heights = columns
        return pd.DataFrame([kernel(*(mask_of(m, w, h) for m in some)) for *some, w, h in zip(*masks, widths, heights, strict=True)])

    return run


def metrics_column(pred: Column, gt: Column, width: Column, height: Column) -> Column:
    return masks_udf(mask_metrics, "iou double, dice double, precision double, recall double")(pred, gt, width, height)


def array_counts(a: Column, b: Column) -> dict[str, Column]:
    """Pixels of two boolean arrays: in both, in either, and in each."""
    count = lambda arr: F.aggregate(arr, F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long"))
    return {"both": count(F.zip_with(a, b, lambda x, y: x & y)), "either": count(F.zip_with(a, b, lambda x, y: x | y)), "a": count(a), "b": count(b)}


def box_text(box: Column) -> Column:
    """Rounded integers of a box of four, else NULL."""
    return F.when(F.size(box) == 4, F.transform(box, lambda x: F.bround(x).cast("int")))


def score_text(value: Column) -> Column:
    return F.bround(value, 6)


IMAGE_VARIANTS = ("raw", "mask_overlay", "masked")


def variant_image(image: Array, mask: Array | None, variant: str) -> Array:
    """An image as a model sees it: as it is, with its mask tinted, or with the background black."""
    if variant not in IMAGE_VARIANTS:
        raise ValueError(f"unknown variant {variant!r}")
    if variant == "raw":
        return image
    if mask is None:
        raise ValueError(f"{variant} needs a mask")
    return overlay(image, mask) if variant == "mask_overlay" else apply_mask(image, mask)


def mask_as_rgb(mask: Array) -> Array:
    return np.repeat((mask[..., None] * np.uint8(255)), 3, axis=2)


def nearest(array: Array, height: int, width: int) -> Array:
    """Resized by the nearest pixel: that in which the new pixel's centre lies."""
    ys = (2 * np.arange(height) + 1) * array.shape[0] // (2 * height)
    xs = (2 * np.arange(width) + 1) * array.shape[1] // (2 * width)
    return array[ys][:, xs]


def fit_canvas(image: Array, height: int, width: int, background: int = 0) -> Array:
    """Shrunk to fit (never enlarged) and centred on a canvas."""
    scale = min(1.0, height / image.shape[0], width / image.shape[1])
    small = nearest(image, max(1, int(image.shape[0] * scale)), max(1, int(image.shape[1] * scale)))
    canvas = np.full((height, width, 3), background, np.uint8)
    y, x = (height - small.shape[0]) // 2, (width - small.shape[1]) // 2
    canvas[y : y + small.shape[0], x : x + small.shape[1]] = small
    return canvas


def collage(panels: list[Array], columns: int = 3, width: int = 420, height: int = 320, margin: int = 12, strip: int = 88, frame: int = 8) -> Array:
    """Panels row by row on one sheet; each image shrunk or enlarged to its panel, above a strip for text, which stays blank."""
    rows = -(-len(panels) // max(1, columns))
    # Greys of the sheet, the strip, its edge and the frame.
    sheet = np.full((rows * height, columns * width, 3), 245, np.uint8)
    for k, image in enumerate(panels):
        panel = np.full((height, width, 3), 255, np.uint8)
        room_h, room_w = max(60, height - strip - 2 * margin), width - 2 * margin
        scale = min(room_h / image.shape[0], room_w / image.shape[1])
        small = nearest(image, max(1, round(image.shape[0] * scale)), max(1, round(image.shape[1] * scale)))
        x = (width - small.shape[1]) // 2
        panel[margin : margin + small.shape[0], x : x + small.shape[1]] = small
        panel[height - strip :] = 220
        panel[height - strip + 1 : -1, 1:-1] = 248
        y, x = k // columns * height, k % columns * width
        sheet[y : y + height, x : x + width] = panel
    return np.pad(sheet, ((frame, frame), (frame, frame), (0, 0)), constant_values=220)


def squeeze_candidates(masks_: Array) -> Array:
    """Candidate masks as n x height x width, whatever leading axes of one they came with."""
    out = np.asarray(masks_)
    while out.ndim > 3:
        out = out[0]
    return (out if out.ndim == 3 else out[None]) > 0


def variant_column(variant: str) -> Callable[..., Column]:
    """A column function of (image bytes, mask bytes or NULL, width, height) to image bytes."""

    @F.pandas_udf("binary")
    def run(image: pd.Series, mask: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        rows = []
        for data, cut, w, h in zip(image, mask, width, height, strict=True):
            pixels = np.frombuffer(data, np.uint8, count=w * h * 3).reshape(h, w, 3)
            rows.append(variant_image(pixels, None if cut is None else mask_of(cut, w, h), variant).tobytes())
        return pd.Series(rows)

    return run


def foreground_masks(column_image: Column, width: Column, height: Column, backend: Callable[[Array], Array] | None = None) -> Column:
    """(mask, backend, area_ratio) of each image; a backend that fails or finds nothing falls back to the simple mask."""

    @F.pandas_udf("mask binary, backend string, area_ratio double")
    def run(image: pd.Series, w: pd.Series, h: pd.Series) -> pd.DataFrame:
        rows = []
        for data, wide, high in zip(image, w, h, strict=True):
            pixels, found, name = np.frombuffer(data, np.uint8, count=wide * high * 3).reshape(high, wide, 3), None, "backend"
            if backend is not None:
                try:
                    found = np.asarray(backend(pixels), bool)
                except Exception:  # noqa: BLE001 - the simple mask is the fallback
                    found = None
            if found is None or not found.any():
                found, name = simple_mask(pixels), "simple"
            rows.append((found.astype(np.uint8).tobytes(), name, float(found.mean())))
        return pd.DataFrame(rows, columns=["mask", "backend", "area_ratio"])

    return run(column_image, width, height)
