"""Detector confidences as probabilities, by isotonic regression."""

from __future__ import annotations

from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width of the bins that confidences are pooled in.
WIDTH = 1e-4


def fit(pairs: DataFrame, prob: str = "prob", label: str = "label", width: float = WIDTH) -> IsotonicRegressionModel:
    """An increasing step-wise linear function from confidence to the share of hits.

    Confidences are pooled in bins of `width` first, at most 1 / width of them between 0 and 1 however many pairs there
    are, at the mean of what a bin holds: pairs of one confidence stay at it, others move by less than `width`.
    """
    p = F.col(prob).cast("double")
    mean = F.when(F.min(p) == F.max(p), F.min(p)).otherwise(F.avg(p))
    pooled = pairs.filter(p.isNotNull()).groupBy(F.floor(p / width).alias("bin")).agg(mean.alias("prob"), F.avg(F.col(label).cast("double")).alias("label"), F.count("*").cast("double").alias("weight"))
    return IsotonicRegression(featuresCol="prob", labelCol="label", weightCol="weight", isotonic=True).fit(pooled)


def save(model: IsotonicRegressionModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> IsotonicRegressionModel:
    return IsotonicRegressionModel.load(path)


def calibrated(model: IsotonicRegressionModel, df: DataFrame, prob: str = "prob", out: str = "calibrated") -> DataFrame:
    """`out` within 0 and 1, by binary search among the model's boundaries; confidences outside the fitted ones take the nearest one's value, null stays null."""
    own = df.withColumn("__p", F.coalesce(F.col(prob).cast("double"), F.lit(0.0)))
    told = model.setFeaturesCol("__p").setPredictionCol("__y").transform(own)
    return told.withColumn(out, F.when(F.col(prob).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "__y")))).drop("__p", "__y")


def mean_squared_error(df: DataFrame, calibrated_col: str = "calibrated", label: str = "label") -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(calibrated_col) - F.col(label), F.lit(2.0))).alias("mse"))
