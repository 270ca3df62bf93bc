"""Writers: detections by frame, a keyed store, count labels and distributions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import shipped
from .labels import DETECTION


def frame_texts(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """frame_id and text for every frame: a line for each detection by rank, empty without any."""
    line = X.detection_line(*(F.col(c) for c in DETECTION))
    own = detections.select("frame_id", F.struct("rank", line.alias("line")).alias("r")).groupBy("frame_id").agg(F.array_sort(F.collect_list("r")).alias("rs"))  # a frame's detections
    text = F.concat(F.array_join(F.transform("rs", lambda r: r.line), "\n"), F.lit("\n"))
    return frames.select("frame_id").join(own, "frame_id", "left").select("frame_id", F.coalesce(text, F.lit("")).alias("text"))


def write_store(texts: DataFrame, path: str, parts: int = 256) -> None:
    """A store keyed by frame: rows go to the folder of their key's hash, so a lookup reads one folder."""
    dealt = texts.withColumn("part", F.pmod(F.xxhash64("frame_id"), F.lit(parts)).cast("int"))
    dealt.withColumn("written", F.current_timestamp()).write.partitionBy("part").mode("append").parquet(path)


def lookup(spark: SparkSession, path: str, frame_id: int, parts: int = 256) -> str | None:
    """The text written last for a frame; None if there is none."""
    part = F.pmod(F.xxhash64(F.lit(frame_id).cast("long")), F.lit(parts)).cast("int")
    row = spark.read.parquet(path).filter((F.col("part") == part) & (F.col("frame_id") == frame_id)).orderBy(F.desc("written")).select("text").first()
    return None if row is None else row.text


def store(spark: SparkSession, path: str) -> DataFrame:
    """All frames, of each the text written last."""
    rows = spark.read.parquet(path)
    last = F.row_number().over(W.partitionBy("frame_id").orderBy(F.desc("written")))
    return rows.withColumn("rn", last).filter("rn = 1").select("frame_id", "text")


def write_records(df: DataFrame, path: str) -> None:
    """JSON records, a line each: count labels, distributions."""
    df.write.mode("overwrite").json(path)


def write_path_list(df: DataFrame, path: str) -> None:
    df.select(F.col("path").alias("value")).write.mode("overwrite").text(path)


def truth_lines(boxes: DataFrame) -> DataFrame:
    """frame_id and text of frames with boxes only; the class is written as 0."""
    line = F.concat_ws(" ", F.lit("0"), *(F.col(c).cast("string") for c in ("xc", "yc", "w", "h")))
    own = boxes.select("frame_id", F.struct("rank", line.alias("line")).alias("r")).groupBy("frame_id").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    return own.select("frame_id", F.array_join(F.transform("rs", lambda r: r.line), "\n").alias("text"))


def write_files(df: DataFrame, folder: str) -> DataFrame:
    """Write `content` of each row as the file `name` of a folder that executors reach; (name, written) tells which could not be."""
    shipped(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        for b in batches:
            done = []
            for name, content in zip(b.column("name").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    with fs.open_output_stream(f"{path}/{name}") as out:
                        out.write(content or b"")
                    done.append(True)
                except OSError:
                    done.append(False)
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(done, pa.bool_())], ["name", "written"])

    return df.select("name", "content").mapInArrow(run, "name string, written boolean")


def log_scalars(spark: SparkSession, path: str, step: int, values: dict[str, float]) -> None:
    """Add a step's values to a table of tag, value and step."""
    spark.createDataFrame([(k, float(v), step) for k, v in values.items()], "tag string, value double, step long").coalesce(1).write.mode("append").parquet(path)
