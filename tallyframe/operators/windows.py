"""Positions, batches, skipping of like frames, and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges of ids that positions are counted in; a range is a task's share.
PARTS = 1024


def with_position(df: DataFrame, frame_col: str = "frame_id", out: str = "pos") -> DataFrame:
    """The place (from 0) of each row in ascending order of a unique integer id.

    Ids are cut into PARTS ranges; a count for each range gives where it begins, so rows are only sorted within ranges.
    """
    low, high = df.agg(F.min(frame_col), F.max(frame_col)).first()
    if low is None:
        return df.withColumn(out, F.lit(0).cast("long"))
    width = max(1, -(-(high - low + 1) // PARTS))
    part = F.floor((F.col(frame_col) - F.lit(low)) / F.lit(width)).cast("int")
    cut = df.withColumn("__part", part)
    before = cut.groupBy("__part").agg(F.count("*").alias("__n"))
    before = before.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))  # PARTS rows
    own = F.row_number().over(W.partitionBy("__part").orderBy(frame_col)) - 1
    return cut.join(F.broadcast(before), "__part").withColumn(out, (F.col("__before") + own).cast("long")).drop("__part", "__before")


def with_batch(df: DataFrame, size: int = 64, pos: str = "pos", out: str = "batch") -> DataFrame:
    return df.withColumn(out, F.floor(F.col(pos) / size).cast("long"))


def differs(template: Column, pixels: Column) -> Column:
    """Mean squared difference of two arrays."""
    return F.aggregate(F.zip_with(template, pixels, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) / F.size(pixels)


def key_batches(frames: DataFrame, pixels: str, threshold: float, size: int = 64, template: str = "zero", video: str | None = None) -> DataFrame:
    """(video, batch, difference, is_key) by the mean squared difference of a batch's frames.

    `template` is `zero` (each batch is compared with zeros, whatever came before) or `last` (with the batch before it).
    A threshold of 0 or less makes every batch a key, and a video's first batch always is one.
    """
    keys = [video] if video else []
    if template == "zero":
        each = F.aggregate(pixels, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
        out = frames.groupBy(*keys, "batch").agg((F.sum(each) / F.sum(F.size(pixels))).alias("difference"))
    else:
        means = frames.select(*keys, "batch", F.posexplode(pixels).alias("i", "v")).groupBy(*keys, "batch", "i").agg(F.avg("v").alias("m"))
        whole = means.groupBy(*keys, "batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x.m).alias("m"))
        last = F.lag("m").over(W.partitionBy(*keys, *([] if keys else [F.lit(0)])).orderBy("batch"))
        out = whole.withColumn("last", last).select(*keys, "batch", F.when(F.col("last").isNotNull(), differs(F.col("last"), F.col("m"))).alias("difference"))
    first = F.min("batch").over(W.partitionBy(*keys)) if keys else None
    is_first = F.col("batch") == (first if first is not None else F.lit(0))
    return out.withColumn("is_key", is_first | F.lit(threshold <= 0) | F.coalesce(F.col("difference") >= threshold, F.lit(True)))


def ranged(df: DataFrame, by: str, out: str = "__part") -> DataFrame:
    """With the number of the range, of PARTS equal ones, that each row's `by` (a number or a time) is in; null is before all."""
    place = F.col(by).cast("double")
    low, high = df.agg(F.min(place), F.max(place)).first()
    if low is None or high == low:
        return df.withColumn(out, F.when(place.isNull(), -1).otherwise(0))
    width = (high - low) / PARTS
    return df.withColumn(out, F.when(place.isNull(), -1).otherwise(F.least(F.floor((place - low) / width), F.lit(PARTS - 1))).cast("int"))


def forward_filled(df: DataFrame, value: str, keys: list[str], order: list[str], out: str = "filled") -> DataFrame:
    """The last value that isn't null up to each row, by video.

    A video is cut into ranges of its first order column: each range's last value is carried over the at most PARTS
    ranges, and only rows of one range are sorted together.
    """
    cut = ranged(df, order[0])
    own = cut.filter(F.col(value).isNotNull()).groupBy(*keys, "__part").agg(F.max_by(value, F.struct(*order)).alias("__last"))
    every = cut.groupBy(*keys, "__part").agg(F.lit(1).alias("__one")).join(_like(own, keys), _same([*keys, "__part"]), "left")
    before = F.last("__last", ignorenulls=True).over(W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    carried = _like(every.select(*keys, "__part", before.alias("__before")), keys)
    inside = F.last(value, ignorenulls=True).over(W.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return cut.join(carried, _same([*keys, "__part"])).withColumn(out, F.coalesce(inside, "__before")).select(*df.columns, out)


def _like(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and range under names that end in `_of`."""
    return df.withColumnsRenamed({c: f"{c}_of" for c in [*keys, "__part"]})


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"{k}_of"))
    return out


def counted(df: DataFrame, what: dict[str, Column], keys: list[str], by: str, order: list[Column], descending: bool = False) -> DataFrame:
    """Sums of whole-number columns over the rows up to each one, by key: sums of ranges of `by` before a row's, and a window within it."""
    cut = ranged(df, by)
    sums = cut.groupBy(*keys, "__part").agg(*(F.sum(c).alias(f"__{n}") for n, c in what.items()))
    up = W.partitionBy(*keys).orderBy(F.desc("__part") if descending else F.asc("__part")).rowsBetween(W.unboundedPreceding, -1)
    base = _like(sums.select(*keys, "__part", *(F.coalesce(F.sum(f"__{n}").over(up), F.lit(0)).alias(f"__{n}") for n in what)), keys)  # at most PARTS + 1 rows a key
    inside = W.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    met = cut.join(base, _same([*keys, "__part"]))
    return met.select(*df.columns, "__part", *((F.col(f"__{n}") + F.sum(c).over(inside)).alias(n) for n, c in what.items()))


def skip_runs(df: DataFrame, is_key: Column, keys: list[str], order: list[str]) -> DataFrame:
    """For each video the longest run of a key row and the skipped ones after it (a run still open at the end doesn't count) and the open run's length."""
    flagged = df.select(*keys, *order, is_key.cast("int").alias("__key"))
    islands = counted(flagged, {"__island": F.col("__key")}, keys, order[0], [F.col(c) for c in order])
    runs = islands.groupBy(*keys, "__island").agg(F.count("*").alias("__n"))
    top = F.max_by("__n", "__island")
    whole = runs.groupBy(*keys).agg(F.max("__island").alias("__top"), top.alias("open_run"))
    closed = runs.join(_like(whole.withColumn("__part", F.lit(0)).drop("open_run"), keys).drop("__part_of"), _same(keys)).filter(F.col("__island") < F.col("__top"))
    most = _like(closed.groupBy(*keys).agg(F.max("__n").alias("__most")).withColumn("__part", F.lit(0)), keys)
    return whole.join(most, _same(keys), "left").select(*keys, F.coalesce("__most", F.lit(0)).alias("max_skip"), "open_run")


def hourly(events: DataFrame, ts: str = "ts", length: str = "1 hour") -> DataFrame:
    """Rows and sum of values by time window and class."""
    return events.groupBy(F.window(ts, length).alias("w"), "class_name").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))


def frame_time(pos: Column, fps: float) -> Column:
    """Seconds from a video's start."""
    return pos / F.lit(float(fps))
