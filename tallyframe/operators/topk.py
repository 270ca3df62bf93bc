"""Top-k: exact, by group, with a gap in time, and over uncertain counts."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import passing, removed, shared_dir, shipped

SALTS = 64


def top(counts: DataFrame, k: int, value: str = "n", frame_col: str = "frame_id") -> DataFrame:
    """The k largest values; ties go to the smaller frame."""
    return counts.orderBy(F.desc(value), F.asc(frame_col)).limit(k)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; a large group is first cut down in salted parts, so no task has it whole."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))
    part = df.withColumn("__salt", salt)
    part = part.withColumn("__rn", F.row_number().over(W.partitionBy(*keys, "__salt").orderBy(*order))).filter(F.col("__rn") <= k)
    return part.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("__rn") <= k).drop("__rn", "__salt")


class GapList:
    """Keeps pushed frames that are more than `gap` from all kept ones, up to k; pushed in descending order of value."""

    def __init__(self, gap: int, k: int, inclusive: bool = False):
        self.gap, self.k, self.inclusive = gap, k, inclusive
        self.top: list[tuple[float, int]] = []

    def push(self, value: float, frame: int) -> bool:
        far = all(abs(frame - f) > self.gap or self.inclusive and abs(frame - f) >= self.gap for _, f in self.top)
        if far and len(self.top) < self.k:
            self.top.append((value, frame))
        return len(self.top) < self.k


def top_gap(counts: DataFrame, k: int, gap: int, value: str = "n", frame_col: str = "frame_id", inclusive: bool = False) -> DataFrame:
    """The k largest values whose frames are more than `gap` apart, greedily from the largest.

    A chosen frame rules out at most 2 * gap others, so the first k * (2 * gap + 1) rows decide; only they are
    sorted, in one group of that bounded size.
    """
    shipped(counts.sparkSession)
    schema = counts.schema
    bound = counts.orderBy(F.desc(value), F.asc(frame_col)).limit(k * (2 * gap + 1))

    def greedy(pdf):
        pdf = pdf.sort_values([value, frame_col], ascending=[False, True])
        kept, chosen = [], GapList(gap, k, inclusive)
        for i, (v, f) in enumerate(zip(pdf[value], pdf[frame_col], strict=True)):
            before = len(chosen.top)
            more = chosen.push(v, f)
            if len(chosen.top) > before:
                kept.append(i)
            if not more:
                break
        return pdf.iloc[kept]

    return bound.withColumn("__all", F.lit(1)).groupBy("__all").applyInPandas(lambda pdf: greedy(pdf.drop(columns="__all")), schema)


@dataclass
class Outcome:
    """What a probabilistic top-k says: the frames and values, rounds, confirmed frames in each round, and the confidence reached.

    `steps` has the same after each round that had k frames, as (confidence, frames, values, rounds).
    """

    frames: list[int] = field(default_factory=list)
    values: list[float] = field(default_factory=list)
    n_rounds: int = 0
    n_confirmed: list[int] = field(default_factory=list)
    confidence: float = 0.0
    steps: list[tuple[float, list[int], list[float], int]] = field(default_factory=list)

    def at(self, level: float) -> Outcome:
        """What a search for a lower confidence would have said: rounds don't depend on it."""
        for confidence, frames, values, n in self.steps:
            if confidence >= level:
                return Outcome(frames, values, n, self.n_confirmed[:n], confidence)
        return self


def log_products(table: DataFrame, frame_col: str = "frame_id") -> tuple[np.ndarray, np.ndarray]:
    """For each count c: the sum of ln F(c) over frames with F(c) > 0, and how many have F(c) = 0."""
    long = table.select(F.posexplode("cdf").alias("c", "p"))
    rows = long.groupBy("c").agg(F.sum(F.when(F.col("p") > 0, F.ln("p")).otherwise(0.0)).alias("s"), F.count_if(F.col("p") <= 0).alias("z")).collect()
    n = 1 + max((r.c for r in rows), default=-1)
    sums, zeros = np.zeros(n), np.zeros(n)
    for r in rows:  # one row for each count, not for each frame
        sums[r.c], zeros[r.c] = r.s, r.z
    return sums, zeros


def confidence(table: DataFrame, confirmed: DataFrame, k: int, frame_col: str = "frame_id") -> float:
    """Probability that no unconfirmed frame has more than the k-th confirmed score; 0 while fewer than k are confirmed."""
    best = confirmed.orderBy(F.desc("score"), frame_col).limit(k).collect()
    if len(best) < k:
        return 0.0
    rest = table.join(confirmed.select(frame_col), frame_col, "left_anti")
    last = F.least(F.lit(int(best[-1].score)), F.size("cdf") - 1)
    p = F.when(F.lit(best[-1].score < 0), 0.0).otherwise(F.get("cdf", last))
    row = rest.agg(F.sum(F.when(p > 0, F.ln(p)).otherwise(0.0)).alias("s"), F.count_if(p <= 0).alias("z")).first()
    return 0.0 if row.z else math.exp(row.s or 0.0)


def _expected(c_k: int, c_p: int | None, sums: np.ndarray, zeros: np.ndarray) -> Column:
    """Expected confidence after a frame is confirmed, from its `cdf`; c_k and c_p are the k-th and (k-1)-th scores."""
    top_c = len(sums) - 1
    at = lambda c: F.get("cdf", F.lit(c))

    def others(c: int) -> Column:
        """Product of F(c) over the other unconfirmed frames."""
        p = at(c)
        own_zero = p <= 0
        left = F.lit(float(zeros[c])) - F.when(own_zero, 1.0).otherwise(0.0)
        return F.when(left > 0, 0.0).otherwise(F.exp(F.lit(float(sums[c])) - F.when(own_zero, 0.0).otherwise(F.ln(p))))

    now = F.lit(0.0 if zeros[c_k] else math.exp(sums[c_k]))
    high = top_c + 1 if c_p is None else min(c_p, top_c + 1)
    out = now
    for x in range(c_k + 1, high):
        out = out + (at(x) - at(x - 1)) * others(x)
    if c_p is not None and c_p > c_k and c_p <= top_c:
        out = out + (1.0 - at(c_p - 1)) * others(c_p)
    elif c_p is not None and c_p <= top_c:
        out = out + (1.0 - at(c_k)) * others(c_p)
    return out


def _best(confirmed: DataFrame, k: int, gap: int, frame_col: str, inclusive: bool) -> list[tuple[float, int]]:
    """(value, frame) of the best confirmed ones; with a gap the first k (2 gap + 1) rows decide."""
    rows = confirmed.orderBy(F.desc("score"), frame_col).limit(k * (2 * gap + 1)).collect()
    chosen = GapList(gap, k, inclusive) if gap else GapList(-1, k)
    for r in rows:
        if not chosen.push(float(r["score"]), r[frame_col]):
            break
    return chosen.top


def probabilistic_top(table: DataFrame, confirm: Callable[[DataFrame], DataFrame], k: int, level: float = 0.9, batch: int = 64, gap: int = 0, frame_col: str = "frame_id", inclusive: bool = False) -> Outcome:
    """Top-k frames with the given confidence, confirming as few frames as the table's distributions allow.

    `table` has a frame id and `cdf`, P(count <= c) for c = 0..C; `confirm` maps frames (a column of ids) to their exact
    `score`, for example by an expensive model. Each round makes one aggregate over the unconfirmed frames, whose
    size is C + 1, and one top-`batch` by expected confidence. Scores over C count as C in products. With a gap, the
    k-th score is that of the gap-filtered list and the confidence a lower bound. Confirmed frames and their scores are
    added to a table in the shared folder, so they may become all frames; the driver holds the best ones only.
    """
    out, spark = Outcome(), table.sparkSession
    table = table.select(frame_col, "cdf").persist()
    path = shared_dir(spark, "confirmed")
    passing(spark, path)
    kind = f"`{frame_col}` {table.schema[frame_col].dataType.simpleString()}, score double"
    try:
        top_c = table.agg(F.max(F.size("cdf"))).first()[0]
        if top_c is None:
            return out
        mean = F.size("cdf") - F.aggregate("cdf", F.lit(0.0), lambda s, p: s + p)  # E[X] = sum of 1 - F
        first = table.orderBy(F.desc(mean), frame_col).limit(max(k, batch)).select(frame_col)
        while True:
            own = f"{path}/{out.n_rounds}"
            confirm(first).select(frame_col, F.col("score").cast("double").alias("score")).write.parquet(own)
            out.n_rounds += 1
            out.n_confirmed.append(spark.read.schema(kind).parquet(own).count())
            confirmed = spark.read.schema(kind).parquet(*(f"{path}/{i}" for i in range(out.n_rounds)))
            best = _best(confirmed, k, gap, frame_col, inclusive)
            out.values, out.frames = [v for v, _ in best], [f for _, f in best]
            rest = table.join(confirmed.select(frame_col), frame_col, "left_anti")
            if len(best) < k:
                if not out.n_confirmed[-1]:  # fewer than k frames exist
                    out.confidence = 1.0
                    break
                first = rest.orderBy(F.desc(mean), frame_col).limit(batch).select(frame_col)
                continue
            sums, zeros = log_products(rest, frame_col)
            c_k = int(min(max(best[-1][0], 0), top_c - 1))
            out.confidence = 1.0 if not len(sums) else 0.0 if zeros[c_k] else math.exp(sums[c_k])  # without any sum all are confirmed
            out.steps.append((out.confidence, out.frames, out.values, out.n_rounds))
            if out.confidence >= level or not len(sums):
                break
            gain = _expected(c_k, int(min(best[-2][0], top_c)) if k > 1 else None, sums, zeros)
            first = rest.filter(F.get("cdf", F.lit(c_k)) < 1).orderBy(F.desc(gain), F.desc(mean), frame_col).limit(batch).select(frame_col)
        return out
    finally:
        table.unpersist()
        removed(spark, path)
