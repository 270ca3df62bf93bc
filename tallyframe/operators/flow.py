"""A whole query: estimate every frame cheaply, rank by confirmed counts, judge against the truth."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import probability as P
from . import evaluation as E
from . import models, topk, uncertain


@dataclass(frozen=True)
class Query:
    """The k frames with the most objects, at a confidence, more than `gap` apart; `batch` frames are confirmed in a round."""

    k: int = 100
    confidence: float = 0.9
    gap: int = 0
    batch: int = 64


def build_table(frames: DataFrame, load: Callable[[], models.Estimator], path: str, batch: int = 64) -> DataFrame:
    """The CDF table of frames (frame_id, content) by a cheap model, written so that later queries needn't run it again."""
    mixtures = models.estimate(frames, load, batch)
    parts = P.mixture(F.col("pi"), F.col("mu"), F.col("sigma"))
    own = f"{path}/mixtures"  # the model runs once, though its largest count is needed first
    mixtures.write.mode("overwrite").parquet(own)
    uncertain.from_mixtures(frames.sparkSession.read.parquet(own), parts).write.mode("overwrite").parquet(f"{path}/table")
    return read_table(frames.sparkSession, path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/table")


def answer(table: DataFrame, confirm: Callable[[DataFrame], DataFrame], query: Query) -> topk.Outcome:
    return topk.probabilistic_top(table, confirm, query.k, query.confidence, query.batch, query.gap)


def judge(spark: SparkSession, out: topk.Outcome, truth: DataFrame, query: Query) -> DataFrame:
    """One row: precision, recall, score error, rounds, confirmed frames and the confidence reached. `truth` has frame_id and n of all frames."""
    best = topk.top_gap(truth, query.k, query.gap) if query.gap else topk.top(truth, query.k)
    exact = [(i, float(r.n)) for i, r in enumerate(sorted(best.collect(), key=lambda r: (-r.n, r.frame_id)))]  # k rows
    schema = "rank int, value double"
    a, e = spark.createDataFrame(list(enumerate(out.values)), schema), spark.createDataFrame(exact, schema)
    p, error = E.precision(a, e, query.k).first().precision, E.score_error(a, e, query.k).first().score_error
    row = (p, p, float(error), out.n_rounds, sum(out.n_confirmed), out.confidence)
    return spark.createDataFrame([row], "precision double, recall double, score_error double, n_rounds int, n_confirmed int, confidence double")
