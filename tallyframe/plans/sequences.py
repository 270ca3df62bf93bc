"""Batches, key frames, carried values and time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.probability import quantised
from ..operators import windows as V
from ..sources.tables import frames, table
from .registry import query


@query("""
select batch, floor(difference * 1e6 + 0.5) / 1e6 as difference, batch = 0 or difference >= 0.016 as is_key from
(select (rn - 1) // 64 as batch, sum(v * v) / count(*) as difference from
  (select rn, cast(unnest(embedding) as double) as v from (select embedding, row_number() over (order by vec_id) as rn from embeddings)) group by 1)
""")
def diff_detect_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 64 frames compared with zeros."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), F.transform("embedding", lambda v: v.cast("double")).alias("pixels"))
    out = V.key_batches(V.with_batch(V.with_position(e)), "pixels", 0.016)
    return out.select("batch", quantised(F.col("difference")).alias("difference"), "is_key")


@query("""
select event_id as frame_id, user_id as video, last_value(case when value >= 50 then value end ignore nulls)
  over (partition by user_id order by event_id rows between unbounded preceding and current row) as filled from events
""")
def mdn_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last key frame's value, by video; key frames have 50 or more."""
    f = frames(spark, sf_dir).withColumn("key_value", F.when(F.col("value") >= 50, F.col("value")))
    return V.forward_filled(f, "key_value", ["video"], ["frame_id"]).select("frame_id", "video", "filled")


@query("""
with i as (select user_id, sum(case when value >= 50 then 1 else 0 end) over (partition by user_id order by event_id rows between unbounded preceding and current row) as island from events),
r as (select user_id, island, count(*) as n from i group by 1, 2),
t as (select user_id, max(island) as top from r group by 1)
select r.user_id as video, coalesce(max(case when island < top then n end), 0) as max_skip, max(case when island = top then n end) as open_run
from r join t on r.user_id = t.user_id group by 1
""")
def skip_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.skip_runs(frames(spark, sf_dir), F.col("value") >= 50, ["video"], ["frame_id"])


@query("select event_id as frame_id, row_number() over (order by event_id) - 1 as pos, (row_number() over (order by event_id) - 1) // 64 as batch from events")
def frame_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.with_batch(V.with_position(frames(spark, sf_dir).select("frame_id"))).select("frame_id", "pos", "batch")


@query("""
select time_bucket(interval '1 hour', ts) as start, event_type as class_name, count(*) as n, cast(sum(cast(value as decimal(18, 2))) as double) as total from events group by 1, 2
""")
def hourly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.hourly(frames(spark, sf_dir)).select(F.col("w.start").alias("start"), "class_name", "n", F.col("total").cast("double").alias("total"))
