"""The driver's tables, and frames, detections and mixtures made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import probability as P

#: Columns that together tell detections of a frame apart.
ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, class_name, status, conf, rank (orders a frame's rows) and the box as centre and size, within 0 and 1."""
    rank = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame_id"),
        F.col("l_returnflag").alias("class_name"),
        F.col("l_linestatus").alias("status"),
        (F.col("l_discount") * 10).alias("conf"),
        rank.alias("order"),
        F.col("l_linenumber").alias("line"),
        (F.col("l_quantity") / 50).alias("xc"),
        (F.col("l_tax") / 0.08).alias("yc"),
        (F.col("l_linenumber") / 10.0).alias("w"),
        (F.col("l_quantity") / 100).alias("h"),
    )


def mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, label and the mixture's parts, 20 of them, from a vector."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), "label", e.alias("e"))
    pi = P.softmax(F.slice("e", 1, 20))
    sigma = F.transform(F.slice("e", 21, 20), lambda v: F.exp(v))
    mu = F.transform(F.slice("e", 41, 20), lambda v: 5.0 + 10.0 * v)
    whole = own.select("frame_id", "label", pi.alias("pi"), mu.alias("mu"), sigma.alias("sigma")).select("frame_id", "label", P.mixture(F.col("pi"), F.col("mu"), F.col("sigma")).alias("parts"))
    # a generator keeps the optimizer from copying the parts into every place that uses them
    return whole.select("frame_id", "label", F.explode(F.array("parts")).alias("parts"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, class_name, value, ts, video and props."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("frame_id"), F.col("event_type").alias("class_name"), "value", "ts", F.col("user_id").alias("video"), "props")
