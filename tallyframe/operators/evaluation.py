"""How good a ranking or a detector is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .windows import counted


def shared_values(approx: DataFrame, exact: DataFrame, value: str = "value") -> DataFrame:
    """Size of the multiset intersection of two lists of values."""
    a = approx.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("a"))
    b = exact.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("b"))
    return a.join(b, "v").agg(F.coalesce(F.sum(F.least("a", "b")), F.lit(0)).alias("n"))


def precision(approx: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """Share of the exact values that are found. Recall is the same number here, as both lists have k values."""
    return shared_values(approx, exact).select((F.col("n") / F.lit(k)).alias("precision"))


def recall(approx: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    return precision(approx, exact, k).withColumnRenamed("precision", "recall")


def score_error(approx: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """Mean difference of values of equal rank; a rank that one list lacks counts that value in full."""
    a, b = approx.select("rank", F.col("value").alias("a")), exact.select("rank", F.col("value").alias("b"))
    return a.join(b, "rank", "full").agg((F.coalesce(F.sum(F.abs(F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0)))), F.lit(0)) / F.lit(k)).alias("score_error"))


def rank_distance(approx: Column, exact: Column, k: int) -> Column:
    """Mean distance of ranks of two arrays of k values, matched by one pass over each: the pointer into `exact` moves on until
    it finds a value, at most to the last one, and moves past it; a value not found has distance k - rank."""
    start = F.struct(F.lit(0).alias("j"), F.lit(0).alias("i"), F.lit(0).cast("long").alias("total"))

    def step(s: Column, v: Column) -> Column:
        found = F.filter(F.sequence(F.least(s.j, F.lit(k - 1)), F.lit(k - 1)), lambda p: F.get(exact, p) == v)
        hit = (s.j <= k - 1) & (F.size(found) > 0)
        place = F.get(found, F.lit(0))
        rank = F.when(s.j > k - 1, F.lit(k)).when(hit, place).otherwise(F.lit(k))
        following = F.when(s.j > k - 1, s.j).when(hit, place + 1).otherwise(F.lit(k - 1))
        return F.struct(following.alias("j"), (s.i + 1).alias("i"), (s.total + F.abs(s.i - rank)).cast("long").alias("total"))

    return F.aggregate(F.slice(approx, 1, k), start, step, lambda s: s.total / F.lit(k))


def precision_recall(detections: DataFrame, truth: DataFrame) -> DataFrame:
    """class_id, conf, cumulative tp and fp, precision and recall at each confidence, from the highest; equal ones enter together.

    Counts are cumulated by ranges of confidence, so no task holds a class.
    """
    return _curve(detections, truth).drop("__part", "own")


def _curve(detections: DataFrame, truth: DataFrame) -> DataFrame:
    steps = detections.groupBy("class_id", "conf").agg(F.sum("tp").cast("long").alias("own"), F.sum(1 - F.col("tp")).cast("long").alias("miss"))
    curve = counted(steps, {"tp": F.col("own"), "fp": F.col("miss")}, ["class_id"], "conf", [F.desc("conf")], descending=True).drop("miss")
    share = (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision")
    return curve.join(truth, "class_id").select("class_id", "conf", "tp", "fp", "n_truth", share, (F.col("tp") / (F.col("n_truth") + F.lit(1e-16))).alias("recall"), "own", "__part")


def average_precision(detections: DataFrame, truth: DataFrame) -> DataFrame:
    """For each class of `truth` (class_id, n_truth): precision and recall over all detections, area under the envelope of the curve, and F1.

    `detections` has class_id, conf and tp (0 or 1). Classes without detections have 0s, classes without truth don't count.
    The envelope at a confidence is the best precision at it or below: of its range's rows, and of the ranges below.
    """
    curve = _curve(detections, truth)
    ranges = curve.groupBy("class_id", "__part").agg(F.max("precision").alias("best"))
    below = F.max("best").over(W.partitionBy("class_id").orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    ranges = ranges.select(F.col("class_id").alias("class_of"), F.col("__part").alias("part_of"), below.alias("below"))
    inside = F.max("precision").over(W.partitionBy("class_id", "__part").orderBy("conf").rowsBetween(W.unboundedPreceding, 0))
    met = curve.join(ranges, F.col("class_id").eqNullSafe(F.col("class_of")) & (F.col("__part") == F.col("part_of")))
    gained = (F.col("recall") - (F.col("tp") - F.col("own")) / (F.col("n_truth") + F.lit(1e-16))).alias("gained")
    envelope = met.select("class_id", "tp", "fp", "precision", "recall", gained, F.greatest(inside, "below").alias("top"))
    last = F.max(F.struct((F.col("tp") + F.col("fp")).alias("n"), "precision", "recall")).alias("last")
    area = envelope.groupBy("class_id").agg(F.sum(F.col("gained") * F.col("top")).alias("ap"), last)
    p, r = F.coalesce("last.precision", F.lit(0.0)), F.coalesce("last.recall", F.lit(0.0))
    out = truth.join(area, "class_id", "left").select("class_id", "n_truth", p.alias("precision"), r.alias("recall"), F.coalesce("ap", F.lit(0.0)).alias("ap"))
    return out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + F.lit(1e-16)))


def mean_average_precision(detections: DataFrame, truth: DataFrame) -> DataFrame:
    return average_precision(detections, truth).agg(*(F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "ap", "f1")))


def speedup(ours: Column, baseline: Column) -> tuple[Column, Column]:
    """(time ratio ours to baseline, how many times faster ours is)."""
    return ours / baseline, baseline / ours
