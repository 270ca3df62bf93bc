"""Boxes as Columns: decoding, scaling and the overlap measures."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-16


class Corners(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


def corners(xc: Column, yc: Column, w: Column, h: Column) -> Corners:
    """Centre and size to corners."""
    return Corners(xc - w / 2, yc - h / 2, xc + w / 2, yc + h / 2)


def normalised(box: Corners, width: Column, height: Column) -> Corners:
    return Corners(box.x1 / width, box.y1 / height, box.x2 / width, box.y2 / height)


def denormalised(box: Corners, width: Column, height: Column) -> Corners:
    return Corners(box.x1 * width, box.y1 * height, box.x2 * width, box.y2 * height)


def rescaled(box: Corners, size: int, width: int, height: int) -> Corners:
    """Undo padding to a square and resizing to `size`: from the network's pixels to those of a width x height image."""
    longest = max(width, height)
    pad_x, pad_y = (max(height - width, 0) * size / longest, max(width - height, 0) * size / longest)
    in_w, in_h = size - pad_x, size - pad_y
    half_x, half_y = pad_x // 2, pad_y // 2
    return Corners(
        (box.x1 - half_x) / in_w * width,
        (box.y1 - half_y) / in_h * height,
        (box.x2 - half_x) / in_w * width,
        (box.y2 - half_y) / in_h * height,
    )


def overlap(a: Corners, b: Corners, extra: float = 0.0) -> Column:
    """Area of the intersection; `extra` is added to each side's length."""
    side = lambda lo, hi: F.greatest(hi - lo + F.lit(extra), F.lit(0.0))
    return side(F.greatest(a.x1, b.x1), F.least(a.x2, b.x2)) * side(F.greatest(a.y1, b.y1), F.least(a.y2, b.y2))


def area(box: Corners, extra: float = 0.0) -> Column:
    return (box.x2 - box.x1 + F.lit(extra)) * (box.y2 - box.y1 + F.lit(extra))


def iou(a: Corners, b: Corners) -> Column:
    """Plain intersection over union; null for two boxes without area."""
    inter = overlap(a, b)
    return F.try_divide(inter, area(a) + area(b) - inter)


def iou_pixels(a: Corners, b: Corners) -> Column:
    """With inclusive pixel coordinates: a side from 3 to 5 is 3 long."""
    inter = overlap(a, b, 1.0)
    return inter / (area(a, 1.0) + area(b, 1.0) - inter + F.lit(EPS))


def iou_sizes(w1: Column, h1: Column, w2: Column, h2: Column) -> Column:
    """Of two boxes with one centre."""
    inter = F.least(w1, w2) * F.least(h1, h2)
    return inter / (w1 * h1 + F.lit(EPS) + w2 * h2 - inter)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def grid_box(tx: Column, ty: Column, tw: Column, th: Column, gx: Column, gy: Column, anchor_w: Column, anchor_h: Column, stride: Column) -> tuple[Column, Column, Column, Column]:
    """Centre and size in pixels of a raw grid prediction; anchors in pixels."""
    return (sigmoid(tx) + gx) * stride, (sigmoid(ty) + gy) * stride, F.exp(tw) * anchor_w, F.exp(th) * anchor_h
