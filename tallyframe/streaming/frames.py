"""Structured Streaming twins: windowed counts, keyed upserts, and carrying the last estimate over skipped frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shipped
from ..sources import sinks

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
#: Rows of a part of a video's result.
ROWS = 10000


def stream(spark: SparkSession, folder: str, files: int | None = 1) -> DataFrame:
    """frame_id, class_name, value, ts and video of files of events as they arrive.

    `files` at a time bounds a micro-batch; they come by time of writing, which is no order among files of one write.
    None takes all there are at once.
    """
    reader = spark.readStream.schema(EVENTS)
    raw = (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(folder)
    return raw.select(F.col("event_id").alias("frame_id"), F.col("event_type").alias("class_name"), "value", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("video"))


def windowed_counts(frames: DataFrame, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows by time window and class; rows later than `late` are left out, as their window is closed."""
    return frames.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "class_name").agg(F.count("*").alias("n"))


def carried(frames: DataFrame, threshold: float) -> DataFrame:
    """Each frame with the value of its video's last key frame: a frame is a key if its value differs from that by `threshold` or more, and the first one is.

    As in SQL, a difference from or to NaN is more than any threshold and one from or to null is not, so a null that
    comes first is carried on; frames without an id come last, those without a video are one. A video's frames of a
    micro-batch come in any order and, where Arrow batches end, in several parts; they are put in order together, so a
    task holds one video's frames of a micro-batch, 27 bytes each. A frame that comes in a later micro-batch than a
    higher frame of its video is an error, as that one's value is out already.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begun = state.exists
        last, upto = state.get if begun else (None, None)
        pdf = pd.concat(list(parts), ignore_index=True).sort_values(["no_frame_id", "frame_id"], kind="stable")
        if not pdf.no_frame_id.iloc[0]:
            if upto is not None and pdf.frame_id.iloc[0] < upto:
                raise ValueError(f"video {key[0]}: frame {pdf.frame_id.iloc[0]} comes after frame {upto}; frames must come in order over micro-batches")
            upto = int(pdf.frame_id[~pdf.no_frame_id].max())
        for s in range(0, len(pdf), ROWS):
            part, out = pdf.iloc[s : s + ROWS], []
            for v, missing in zip(part.value, part.no_value):
                v = None if missing else v
                if not begun or (v is not None and last is not None and not abs(v - last) < threshold):
                    last, begun = v, True
                out.append(last)
            yield part.assign(carried=pd.Series(out, part.index, "float64"), no_carried=[v is None for v in out])
        state.update((last, upto))

    shipped(frames.sparkSession)
    # pandas has no null besides NaN, and no whole numbers beside it: nulls go in columns of their own
    columns = {"frame_id": "long", "video": "long", "value": "double", "carried": "double"}
    told = frames.select(*(x for c in list(columns)[:3] for x in (F.coalesce(c, F.lit(0)).alias(c), F.isnull(c).alias(f"no_{c}"))))
    schema = ", ".join(f"{c} {t}, no_{c} boolean" for c, t in columns.items())
    out = told.groupBy("video", "no_video").applyInPandasWithState(step, schema, "last double, upto long", "append", GroupStateTimeout.NoTimeout)
    return out.select(*(F.when(~F.col(f"no_{c}"), F.coalesce(c, F.lit(float("nan"))) if t == "double" else F.col(c)).alias(c) for c, t in columns.items()))


def drained(df: DataFrame, path: str, mode: str) -> None:
    """Run a stream over what there is and leave its result as Parquet: the last whole one (`complete`), or all that came (`append`).

    Each micro-batch has its own folder, so one that is written again after a failure replaces itself.
    """

    def put(batch: DataFrame, number: int) -> None:
        own = path if mode == "complete" else f"{path}/batch={number}"
        batch.write.mode("overwrite").parquet(own)

    query = df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    query.awaitTermination()


def upsert(texts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write frame texts to a keyed store; of a frame written again the last text counts, so repeated batches do no harm."""
    return texts.writeStream.foreachBatch(lambda df, _: sinks.write_store(df, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
