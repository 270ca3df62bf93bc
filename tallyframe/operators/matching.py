"""Greedy work within a frame: suppression, matching with truth, true positives.

A frame's boxes are bounded by what it can show; frames are dealt over all tasks.
Columns: frame_id, x1, y1, x2, y2, and as noted. Ties follow the row's `rank` column, which a caller makes unique.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Corners, iou
from .frames import Arrays, per_frame

BOX = ["x1", "y1", "x2", "y2"]


def overlaps(a: np.ndarray, b: np.ndarray, extra: float, least: float) -> np.ndarray:
    """Intersection over union of every row of a with every row of b; `extra` is added to sides, `least` to unions."""
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    inter = np.clip(high - low + extra, 0, None).prod(axis=2)
    size = lambda x: (x[:, 2:] - x[:, :2] + extra).prod(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return inter / (size(a)[:, None] + size(b)[None, :] - inter + least)


def overlap_plain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return overlaps(a, b, 0.0, 0.0)


def overlap_pixels(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return overlaps(a, b, 1.0, 1e-16)


def suppress(boxes: np.ndarray, obj: np.ndarray, cls: np.ndarray, score: np.ndarray, threshold: float) -> list[tuple[int, np.ndarray]]:
    """(head's place, merged box) of what stays: like boxes of a class become their mean weighted by `obj`."""
    order = np.argsort(-score, kind="stable")
    like = (overlap_pixels(boxes, boxes) > threshold) & (cls[:, None] == cls[None, :])
    np.fill_diagonal(like, True)
    left, out = np.ones(len(boxes), bool), []
    for head in order.tolist():
        if left[head]:
            same = like[head] & left
            left &= ~same
            out.append((head, obj[same] @ boxes[same] / obj[same].sum()))
    return out


def boxes_of(rows: Arrays) -> np.ndarray:
    return np.column_stack([rows[c] for c in BOX]).astype(float)


def non_max_suppression(detections: DataFrame, conf: float = 0.5, threshold: float = 0.4) -> DataFrame:
    """Detections (with obj_conf, cls_conf, class_id, rank) left after suppression, their boxes merged; frames without any give no row."""
    schema = "frame_id long, x1 double, y1 double, x2 double, y2 double, obj_conf double, cls_conf double, class_id int"

    def one(frame: int, r: Arrays) -> list[tuple]:
        kept = suppress(boxes_of(r), r["obj_conf"], r["class_id"], r["obj_conf"] * r["cls_conf"], threshold)
        return [(frame, *box.tolist(), float(r["obj_conf"][i]), float(r["cls_conf"][i]), int(r["class_id"][i])) for i, box in kept]

    own = detections.filter(F.col("obj_conf") >= conf).select("frame_id", "rank", *BOX, "obj_conf", "cls_conf", "class_id")
    return per_frame(own, ["rank"], one, schema)


def _sided(pred: DataFrame, truth: DataFrame, columns: list[str]) -> DataFrame:
    """Predictions (side 0) and truth (side 1) as one table; `columns` are the predictions' own."""
    p = pred.select("frame_id", F.lit(0).alias("side"), "rank", *BOX, *columns)
    t = truth.select("frame_id", F.lit(1).alias("side"), "rank", *BOX, *(F.col(c) if c in truth.columns else F.lit(None).cast(pred.schema[c].dataType).alias(c) for c in columns))
    return p.unionByName(t)


def match(pred: np.ndarray, truth: np.ndarray, threshold: float) -> np.ndarray:
    """1 for each prediction, best first, that takes a free truth box: of those at the threshold the largest overlap, of equals the last.

    An overlap of two boxes without area isn't a number; it reaches any threshold, and the last box that has one goes
    before those in front of it, while those after it are compared among themselves.
    """
    out, free = np.zeros(len(pred), int), np.arange(len(truth))
    every = overlap_plain(pred, truth)
    for i, own in enumerate(every):
        v = own[free]
        unlike = np.flatnonzero(np.isnan(v))
        begin = int(unlike[-1]) if len(unlike) else 0
        rest = v[begin + bool(len(unlike)) :]
        best = np.flatnonzero(rest == rest.max()) if len(rest) else rest
        if len(unlike):  # nothing after it is less than what isn't a number
            place = begin + 1 + int(best[-1]) if len(best) else begin
        elif len(best) and rest[best[-1]] >= threshold:
            place = int(best[-1])
        else:
            continue
        out[i] = 1
        free = np.delete(free, place)
    return out


def match_boxes(pred: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """frame_id, rank, prob and matched (0 or 1) of each prediction; predictions have prob and rank, both tables boxes."""

    def one(frame: int, r: Arrays) -> list[tuple]:
        box, own = boxes_of(r), np.flatnonzero(r["side"] == 0)
        own = own[np.argsort(-r["prob"][own], kind="stable")]
        hits = match(box[own], box[r["side"] == 1], threshold)
        return [(frame, int(r["rank"][i]), float(r["prob"][i]), int(h)) for i, h in zip(own, hits, strict=True)]

    return per_frame(_sided(pred, truth, ["prob"]), ["side", "rank"], one, "frame_id long, rank long, prob double, matched int")


def positives(pred: np.ndarray, pred_cls: np.ndarray, truth: np.ndarray, truth_cls: np.ndarray, threshold: float) -> np.ndarray:
    """1 for the first prediction, in order, of those whose best truth box (of any class, of equals the first) is the same one.

    Only predictions whose best overlap reaches the threshold and whose class the truth has take part.
    """
    out = np.zeros(len(pred), int)
    if len(pred) and len(truth):
        table = overlap_pixels(pred, truth)
        able = np.flatnonzero((table.max(axis=1) >= threshold) & np.isin(pred_cls, truth_cls))
        out[able[np.unique(table[able].argmax(axis=1), return_index=True)[1]]] = 1
    return out


def true_positives(pred: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """frame_id, rank, score, class_id and tp of each prediction (with rank, score, class_id), for average precision."""

    def one(frame: int, r: Arrays) -> list[tuple]:
        box, own, other = boxes_of(r), r["side"] == 0, r["side"] == 1
        cls = r["class_id"].astype(int)
        tp = positives(box[own], cls[own], box[other], cls[other], threshold)
        return [(frame, int(k), float(s), int(c), int(t)) for k, s, c, t in zip(r["rank"][own], r["score"][own], cls[own], tp, strict=True)]

    return per_frame(_sided(pred, truth, ["score", "class_id"]), ["side", "rank"], one, "frame_id long, rank long, score double, class_id int, tp int")


def pairs(pred: DataFrame, truth: DataFrame, measure=iou) -> DataFrame:
    """Every prediction with every truth box of its frame, and their overlap."""
    p = pred.select("frame_id", F.col("rank").alias("pred"), *(F.col(c).alias(f"p{c}") for c in BOX))
    t = truth.select("frame_id", F.col("rank").alias("truth"), *(F.col(c).alias(f"t{c}") for c in BOX))
    box = lambda k: Corners(*(F.col(f"{k}{c}") for c in BOX))
    return p.join(t, "frame_id").select("frame_id", "pred", "truth", measure(box("p"), box("t")).alias("iou"))


def best_class(scores: Column) -> tuple[Column, Column]:
    """(largest class score, its place) of an array."""
    top = F.array_max(scores)
    return top, (F.array_position(scores, top) - 1).cast("int")
