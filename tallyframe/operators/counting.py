"""Counts by class and frame, and statistics over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .topk import top_per_group


def class_total(detections: DataFrame, name, class_col: str = "class_name") -> DataFrame:
    """How many detections are of one class; 0 for an empty input."""
    return detections.agg(F.count_if(F.col(class_col) == F.lit(name)).alias("n"))


def frame_counts(detections: DataFrame, name, class_col: str = "class_name", frame_col: str = "frame_id") -> DataFrame:
    """Detections of a class in each frame that has any detection, 0 included."""
    return detections.groupBy(frame_col).agg(F.count_if(F.col(class_col) == F.lit(name)).alias("n"))


def id_bounds(df: DataFrame, col: str) -> tuple[int, int] | None:
    low, high = df.agg(F.min(col), F.max(col)).first()
    return None if low is None else (low, high)


def dense(counts: DataFrame, frame_col: str = "frame_id") -> DataFrame:
    """Every frame number from the first to the last; those without a row count 0."""
    bounds = id_bounds(counts, frame_col)
    if bounds is None:
        return counts
    every = counts.sparkSession.range(bounds[0], bounds[1] + 1).withColumnRenamed("id", frame_col)
    return every.join(counts, frame_col, "left").select(frame_col, F.coalesce("n", F.lit(0)).alias("n"))


def missing(frames: DataFrame, frame_col: str = "frame_id") -> DataFrame:
    """Frame numbers between the first and the last that have no row."""
    bounds = id_bounds(frames, frame_col) or (0, -1)
    every = frames.sparkSession.range(bounds[0], bounds[1] + 1).withColumnRenamed("id", frame_col)
    return every.join(frames.select(frame_col).distinct(), frame_col, "left_anti")


def require_dense(frames: DataFrame, frame_col: str = "frame_id", first: int = 1) -> int:
    """The number of frames, if they are numbered from `first` on without holes; else an error that names the first hole."""
    bounds = id_bounds(frames, frame_col)
    if bounds is None:
        return 0
    hole = missing(frames, frame_col).agg(F.min(frame_col)).first()[0]
    if bounds[0] != first or hole is not None:
        raise ValueError(f"no frame {first if bounds[0] != first else hole}")
    return bounds[1] - bounds[0] + 1


def missing_count(frames: DataFrame, frame_col: str = "frame_id") -> DataFrame:
    return frames.agg((F.max(frame_col) - F.min(frame_col) + 1 - F.count_distinct(frame_col)).alias("n_missing"))


def gaps(frames: DataFrame, frame_col: str = "frame_id") -> DataFrame:
    """Runs of missing frames as (after, before, n). Frames are compared within and across ranges of ids, never in one task."""
    bounds = id_bounds(frames, frame_col) or (0, 0)
    width = max(1, -(-(bounds[1] - bounds[0] + 1) // 1024))
    ids = frames.select(F.col(frame_col).alias("f")).distinct()
    # of each range the first id stands in for the next range's, so every id finds its successor in its own or a later range
    part = F.floor((F.col("f") - bounds[0]) / width)
    inner = ids.withColumn("part", part).withColumn("next", F.lead("f").over(W.partitionBy("part").orderBy("f")))
    firsts = ids.groupBy(part.alias("part")).agg(F.min("f").alias("first")).withColumn("first", F.lead("first").over(W.orderBy("part")))
    met = inner.join(F.broadcast(firsts), "part").withColumn("before", F.coalesce("next", "first"))  # 1024 rows at most
    return met.filter(F.col("before") - F.col("f") > 1).select(F.col("f").alias("after"), "before", (F.col("before") - F.col("f") - 1).alias("n"))


def mean_by_count(frames: DataFrame, count: Column, value: Column, frame_col: str = "frame_id", examples: int = 10) -> DataFrame:
    """For each true count from 0 to the largest: frames, mean of `value` (0 without frames) and the first frame ids."""
    top = frames.agg(F.max(count)).first()[0]
    every = frames.sparkSession.range(0, (top if top is not None else -1) + 1).withColumnRenamed("id", "gt_count")
    data = frames.select(count.cast("long").alias("gt_count"), value.alias("value"), F.col(frame_col).alias("frame"))
    few = top_per_group(data, ["gt_count"], [F.col("frame")], examples).groupBy("gt_count").agg(F.sort_array(F.collect_list("frame")).alias("frames"))
    stats = data.groupBy("gt_count").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return every.join(stats, "gt_count", "left").join(few, "gt_count", "left").select("gt_count", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("frames", F.array().cast("array<bigint>")).alias("frames"))


def accuracy(frames: DataFrame, prediction: Column, label: Column) -> DataFrame:
    """Share of predictions that round, half to even, to the label."""
    return frames.agg(F.avg((F.bround(prediction, 0) == label).cast("double")).alias("accuracy"))


def error_by_label(frames: DataFrame, prediction: Column, label: Column) -> DataFrame:
    return frames.groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.avg(prediction).alias("mean"), F.avg(F.pow(prediction - label, F.lit(2.0))).alias("mse"))


def channel_statistics(images: DataFrame, channels: Column) -> DataFrame:
    """Of arrays of pixels by channel: the mean of the images' means, and of their sample deviations (not the deviation of all pixels)."""
    pixels = images.select("image_id", F.posexplode(channels).alias("channel", "pixels")).select("image_id", "channel", F.explode("pixels").alias("v"))
    each = pixels.groupBy("image_id", "channel").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    return each.groupBy("channel").agg(F.avg("m").alias("mean"), F.avg("s").alias("std"))


def class_weights(frames: DataFrame, label: Column) -> DataFrame:
    """Inverse frequencies, scaled to add up to 100."""
    counts = frames.groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum(1.0 / F.col("n"))).first()[0]
    return counts.select("label", (100.0 / F.col("n") / F.lit(whole)).alias("weight"))
