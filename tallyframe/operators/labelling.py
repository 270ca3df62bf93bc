"""Labels of frames from a detector's boxes: counts, or normalised boxes of frames that show the target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Corners, normalised
from .matching import BOX, non_max_suppression
from .models import detect
from .splits import sample


def detections(frames: DataFrame, load, conf: float = 0.5, threshold: float = 0.4, batch: int = 64) -> DataFrame:
    """What an expensive detector finds in frames (frame_id, content), after suppression."""
    found = detect(frames, load, batch)
    ranked = found.withColumn("rank", F.xxhash64(*BOX, "obj_conf", "class_id"))
    return non_max_suppression(ranked, conf, threshold)


def count_labels(frames: DataFrame, found: DataFrame, class_id: int) -> DataFrame:
    """timestamp, count (0 included) and image_path of frames (frame_id, path)."""
    n = found.filter(F.col("class_id") == class_id).groupBy("frame_id").agg(F.count("*").cast("int").alias("count"))
    return frames.join(n, "frame_id", "left").select(F.col("frame_id").alias("timestamp"), F.coalesce("count", F.lit(0)).alias("count"), F.col("path").alias("image_path"))


def box_labels(found: DataFrame, class_id: int, width: int, height: int, most: int | None = None, seed: int = 0) -> DataFrame:
    """frame_id, rank and centre and size within 0 and 1 of a class's boxes; `most` keeps so many frames at random."""
    box = normalised(Corners(*(F.col(c) for c in BOX)), F.lit(float(width)), F.lit(float(height)))
    own = found.filter(F.col("class_id") == class_id)
    if most is not None:
        own = own.join(sample(own.select("frame_id").distinct(), most, seed), "frame_id", "left_semi")
    return own.select("frame_id", F.xxhash64(*BOX).alias("rank"), ((box.x1 + box.x2) / 2).alias("xc"), ((box.y1 + box.y2) / 2).alias("yc"), (box.x2 - box.x1).alias("w"), (box.y2 - box.y1).alias("h"))

