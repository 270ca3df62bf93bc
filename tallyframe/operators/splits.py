"""Train, validation and test parts of a video, and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import with_position


def parts_of(n: int, hour: int) -> list[tuple[str, int, int]]:
    """(part, first, one after the last position); positions in none of them are left out.

    With three days or more a day each; with two, the first day, what lies between, and the last; with three hours
    or more an hour, an hour and the rest; else thirds.
    """
    if hour <= 0:
        raise ValueError("frames an hour must be positive")
    day = 24 * hour
    if n >= 3 * day:
        return [("train", 0, day), ("val", day, 2 * day), ("test", 2 * day, 3 * day)]
    if n >= 2 * day:
        return [("train", 0, day), ("val", day, n - day), ("test", n - day, n)]
    if n >= 3 * hour:
        return [("train", 0, hour), ("val", hour, 2 * hour), ("test", 2 * hour, n)]
    third = n // 3
    return [("train", 0, third), ("val", third, 2 * third), ("test", 2 * third, n)]


def split(frames: DataFrame, hour: int, frame_col: str = "frame_id") -> DataFrame:
    """The frames of all parts, with `pos` and `part`."""
    placed = with_position(frames, frame_col)
    part: Column = F.lit(None).cast("string")
    for name, first, last in reversed(parts_of(frames.count(), hour)):
        part = F.when((F.col("pos") >= first) & (F.col("pos") < last), F.lit(name)).otherwise(part)
    return placed.withColumn("part", part).filter(F.col("part").isNotNull())


def sample(frames: DataFrame, n: int, seed: int, keep: Column | None = None, frame_col: str = "frame_id") -> DataFrame:
    """n frames at random, of those that `keep` holds for; the same ones for a seed, however the input is dealt."""
    data = frames if keep is None else frames.filter(keep)
    return data.orderBy(F.md5(F.concat(F.col(frame_col).cast("string"), F.lit(f":{seed}"))), frame_col).limit(n)
