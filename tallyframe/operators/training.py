"""What training of a grid detector needs of a table: batches with boxes, and the anchors and cells that boxes are assigned to.

Columns of boxes: frame_id, rank (their order in a frame), class_id, and xc, yc, w, h within 0 and 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import iou_sizes
from .windows import with_batch, with_position

#: Sides that batches of several sizes are resized to: SMALLEST to LARGEST in steps of 32, a new one every EVERY batches.
SMALLEST, LARGEST, EVERY = 320, 512, 10


def _number(key: Column, seed: int, n: int) -> Column:
    """A number below n that a key and a seed make, the same in any dealing."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long") % n


def batches(frames: DataFrame, size: int = 8, seed: int = 0, flip: bool = True, sizes: bool = True, start: int = 416) -> DataFrame:
    """frame_id, batch, sample (its place in the batch), side (the batch's image size) and flipped of every frame, in order of ids."""
    placed = with_batch(with_position(frames.select("frame_id")), size)
    drawn = SMALLEST + 32 * _number(F.floor(F.col("batch") / EVERY), seed, (LARGEST - SMALLEST) // 32 + 1)
    side = drawn if sizes else F.lit(start)
    mirrored = _number(F.col("frame_id"), seed + 1, 2) == 1 if flip else F.lit(False)
    return placed.select("frame_id", "batch", (F.col("pos") % size).alias("sample"), side.cast("int").alias("side"), mirrored.alias("flipped"))


def collated(placed: DataFrame, boxes: DataFrame) -> DataFrame:
    """The boxes of all batches with their sample's place, mirrored left to right where the frame is; frames without boxes give no row."""
    xc = F.when(F.col("flipped"), 1 - F.col("xc")).otherwise(F.col("xc"))
    return boxes.join(placed, "frame_id").select("batch", "sample", "frame_id", "rank", "class_id", xc.alias("xc"), "yc", "w", "h")


def _overlaps(boxes: DataFrame, anchors: list[tuple[float, float]], grid: int) -> DataFrame:
    """The boxes in cells of a grid, their cell, and `ious`, an array of their overlaps with each anchor (in cells) by size."""
    own = boxes.withColumns({"gx": F.col("xc") * grid, "gy": F.col("yc") * grid, "gw": F.col("w") * grid, "gh": F.col("h") * grid})
    ious = F.array(*(iou_sizes(F.lit(float(w)), F.lit(float(h)), F.col("gw"), F.col("gh")) for w, h in anchors))
    return own.withColumns({"cell_x": F.floor("gx").cast("int"), "cell_y": F.floor("gy").cast("int"), "ious": ious})


def assigned(boxes: DataFrame, anchors: list[tuple[float, float]], grid: int) -> DataFrame:
    """What the cells that boxes fall in should predict: frame_id, anchor, cell_x, cell_y, class_id, tx, ty, tw, th.

    A box goes to the anchor of the largest overlap by size, of equals the first. Of boxes in one place the last by rank counts.
    """
    met = _overlaps(boxes, anchors, grid).withColumn("anchor", (F.array_position("ious", F.array_max("ious")) - 1).cast("int"))
    last = met.groupBy("frame_id", "anchor", "cell_x", "cell_y").agg(F.max_by(F.struct("class_id", "gx", "gy", "gw", "gh"), "rank").alias("b"))
    side = lambda k: F.get(F.array(*(F.lit(float(a[k])) for a in anchors)), F.col("anchor"))
    return last.select(
        "frame_id",
        "anchor",
        "cell_x",
        "cell_y",
        "b.class_id",
        (F.col("b.gx") - F.floor("b.gx")).alias("tx"),
        (F.col("b.gy") - F.floor("b.gy")).alias("ty"),
        F.ln(F.col("b.gw") / side(0) + F.lit(1e-16)).alias("tw"),
        F.ln(F.col("b.gh") / side(1) + F.lit(1e-16)).alias("th"),
    )


def ignored(boxes: DataFrame, anchors: list[tuple[float, float]], grid: int, threshold: float = 0.5) -> DataFrame:
    """frame_id, anchor, cell_x and cell_y of the places that don't count as empty: assigned ones, and those of overlaps above the threshold."""
    met = _overlaps(boxes, anchors, grid)
    best = F.array_position("ious", F.array_max("ious")) - 1
    places = met.select("frame_id", "cell_x", "cell_y", best.alias("best"), F.posexplode("ious").alias("anchor", "iou"))
    return places.filter((F.col("iou") > threshold) | (F.col("anchor") == F.col("best"))).select("frame_id", "anchor", "cell_x", "cell_y").distinct()


def losses(predictions: DataFrame, targets: DataFrame, skipped: DataFrame, obj_scale: float = 1.0, noobj_scale: float = 100.0) -> DataFrame:
    """One row: the mean losses x, y, w, h, conf, cls, their sum `loss`, and the means conf_obj and conf_noobj.

    `predictions` has a row for each place (frame_id, anchor, cell_x, cell_y) with x, y, w, h, conf and scores, an array of
    a probability for each class; `targets` are from `assigned`, `skipped` from `ignored`. Means are over the
    assigned places, for confidence also over those that are neither assigned nor skipped.
    """
    place = ["frame_id", "anchor", "cell_x", "cell_y"]
    own = predictions.join(targets, place, "left").join(skipped.withColumn("skip", F.lit(True)), place, "left")
    there, empty = F.col("tx").isNotNull(), F.col("skip").isNull()
    log = lambda p: -F.greatest(F.ln(F.greatest(p, F.lit(1e-300))), F.lit(-100.0))
    square = lambda a, b: F.avg(F.when(there, (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))))
    per_class = F.aggregate(F.transform("scores", lambda p, i: F.when(i == F.col("class_id"), log(p)).otherwise(log(1 - p))), F.lit(0.0), lambda s, v: s + v) / F.size("scores")
    parts = own.agg(
        *(square(a, f"t{a}").alias(a) for a in "xywh"),
        F.avg(F.when(there, log(F.col("conf")))).alias("with_object"),
        F.avg(F.when(empty, log(1 - F.col("conf")))).alias("without"),
        F.avg(F.when(there, per_class)).alias("cls"),
        F.avg(F.when(there, F.col("conf"))).alias("conf_obj"),
        F.avg(F.when(empty, F.col("conf"))).alias("conf_noobj"),
    )
    conf = F.lit(obj_scale) * F.col("with_object") + F.lit(noobj_scale) * F.col("without")
    out = parts.withColumn("conf", conf).drop("with_object", "without")
    return out.withColumn("loss", sum((F.col(c) for c in ("y", "w", "h", "conf", "cls")), F.col("x")))
