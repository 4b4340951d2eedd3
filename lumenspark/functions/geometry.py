"""Letterbox geometry, boxes and labels as column expressions. Boxes are x1, y1, x2, y2."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The numbers from 1 to 90 that name no category of the 80.
UNUSED_LABELS = (12, 26, 29, 30, 45, 66, 68, 69, 71, 83)
SPARSE_LABELS = tuple(x for x in range(1, 91) if x not in UNUSED_LABELS)


@dataclass(frozen=True)
class Letterbox:
    """Columns of a fit of one image inside another, centred."""

    scale_x: Column
    scale_y: Column
    resized_h: Column
    resized_w: Column
    left: Column
    top: Column
    right: Column
    bottom: Column


def letterbox(height: Column, width: Column, out_height: int, out_width: int) -> Letterbox:
    """Sizes round half up and are 1 at least; the odd pixel of padding goes right and below."""
    nominal = F.least(F.lit(float(out_height)) / height, F.lit(float(out_width)) / width)

    def fitted(size: Column, limit: int) -> Column:
        return F.least(F.lit(limit), F.greatest(F.lit(1), F.floor(size * nominal + 0.5))).cast("bigint")

    h, w = fitted(height, out_height), fitted(width, out_width)
    top, left = F.floor((out_height - h) / 2), F.floor((out_width - w) / 2)
    return Letterbox(w / width, h / height, h, w, left, top, out_width - w - left, out_height - h - top)


def forward_box(box: tuple[Column, ...], fit: Letterbox) -> tuple[Column, ...]:
    x1, y1, x2, y2 = box
    return x1 * fit.scale_x + fit.left, y1 * fit.scale_y + fit.top, x2 * fit.scale_x + fit.left, y2 * fit.scale_y + fit.top


def inverse_box(box: tuple[Column, ...], fit: Letterbox) -> tuple[Column, ...]:
    x1, y1, x2, y2 = box
    return (x1 - fit.left) / fit.scale_x, (y1 - fit.top) / fit.scale_y, (x2 - fit.left) / fit.scale_x, (y2 - fit.top) / fit.scale_y


def clipped(box: tuple[Column, ...], height: Column, width: Column) -> tuple[Column, ...]:
    def within(v: Column, top: Column) -> Column:
        return F.least(F.greatest(v, F.lit(0.0)), top.cast("double"))

    x1, y1, x2, y2 = box
    return within(x1, width), within(y1, height), within(x2, width), within(y2, height)


def native_predictions(detections: DataFrame, out_height: int, out_width: int, dense_labels: bool = False) -> DataFrame:
    """Detections (image_id, height, width, x1, y1, x2, y2, label, score) on the letterboxed image, back on their own.

    Boxes are clipped to the image, those left without area go, and dense labels 0 to 79 become sparse ones.
    """
    fit = letterbox(F.col("height"), F.col("width"), out_height, out_width)
    box = clipped(inverse_box(tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), fit), F.col("height"), F.col("width"))
    label = sparse_label(F.col("label")) if dense_labels else F.col("label")
    made = detections.select("image_id", *[c.alias(n) for c, n in zip(box, ("x1", "y1", "x2", "y2"), strict=True)], label.cast("bigint").alias("label"), "score")
    return made.where("x2 > x1 and y2 > y1")


def sparse_label(dense: Column) -> Column:
    """The category of a dense class 0 to 79; null beyond."""
    return F.try_element_at(F.array(*map(F.lit, SPARSE_LABELS)), F.when((dense >= 0) & (dense < 80), dense.cast("int") + 1).otherwise(F.lit(81)))


def iou(a: tuple[Column, ...], b: tuple[Column, ...], crowd: Column | None = None) -> Column:
    """Intersection over union; over the first box's area where the second is a crowd."""
    wide = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    high = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    both = wide * high
    own, other = (a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1])
    whole = own + other - both
    if crowd is not None:
        whole = F.when(crowd, own).otherwise(whole)
    return F.coalesce(F.try_divide(both, whole), F.lit(0.0))
