"""Tables of count distributions: a CDF array for each frame."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import probability as P


def largest_count(mixtures: DataFrame, parts: Column, z: float = P.Z) -> int | None:
    """The count at which all frames' CDFs are practically 1; null for no frames."""
    top = mixtures.agg(F.max(P.mixture_bound(parts, z))).first()[0]
    return None if top is None else math.ceil(top)


def from_mixtures(mixtures: DataFrame, parts: Column, frame_col: str = "frame_id", z: float = P.Z) -> DataFrame:
    """frame, cdf at counts 0 to the largest over all frames."""
    top = largest_count(mixtures, parts, z)
    grid = F.sequence(F.lit(0), F.lit(max(0, top or 0)))
    held = mixtures.select(F.col(frame_col).alias("frame_id"), parts.alias("parts"))
    return held.select("frame_id", F.transform(grid, lambda c: P.mixture_cdf(F.col("parts"), c.cast("double"))).alias("cdf"))


def from_detections(detections: DataFrame, prob: Column, frame_col: str = "frame_id", most: int | None = None, keep: Column | None = None) -> DataFrame:
    """frame, cdf of the number of real objects among its detections, or those that `keep` holds for, padded with 1 to one length.

    Every frame has a row: without a detection to keep its count is 0 for sure.
    """
    own = prob if keep is None else F.when(keep, prob)
    each = detections.groupBy(F.col(frame_col).alias("frame_id")).agg(F.sort_array(F.collect_list(own)).alias("p"))  # a frame's detections
    if most is None:
        most = each.agg(F.max(F.size("p"))).first()[0] or 0
    cdf = P.running(P.count_pmf(F.col("p")))
    exact = F.transform(cdf, lambda v, i: F.when(i >= F.size("p"), 1.0).otherwise(F.least(v, F.lit(1.0))))
    return each.select("frame_id", F.slice(F.concat(exact, F.array_repeat(F.lit(1.0), most)), 1, most + 1).alias("cdf"))


def log_loss(mixtures: DataFrame, parts: Column, label: Column) -> DataFrame:
    """Mean negative log-likelihood of the labels; a density of 0 counts as the smallest normal number."""
    return mixtures.agg(F.avg(-F.ln(F.greatest(P.mixture_pdf(parts, label), F.lit(2.2250738585072014e-308)))).alias("loss"))
