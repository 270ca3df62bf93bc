"""Frames as pixels: image folders, motion-JPEG videos, and training rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import shipped

PIXELS = "frame_id long, height int, width int, pixels binary"


def images(spark: SparkSession, folder: str) -> DataFrame:
    """frame_id, height, width and pixels (rows of red, green, blue bytes) of the images that the JVM can decode; others are left out."""
    raw = spark.read.format("image").option("dropInvalid", True).load(folder)
    i = F.col("image")
    return as_rgb(raw.select(X.frame_id(i.origin).alias("frame_id"), i.height.alias("height"), i.width.alias("width"), i.nChannels.alias("channels"), i.data.alias("data")))


def as_rgb(raw: DataFrame) -> DataFrame:
    """From rows of grey, blue-green-red or blue-green-red-alpha bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n, data in zip(b.column("channels").to_pylist(), b.column("data").to_pylist(), strict=True):
                p = np.frombuffer(data, np.uint8).reshape(-1, n)
                out.append((np.repeat(p, 3, axis=1) if n == 1 else p[:, 2::-1]).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("frame_id"), b.column("height"), b.column("width"), pa.array(out, pa.binary())], ["frame_id", "height", "width", "pixels"])

    return raw.mapInArrow(run, PIXELS)


def mapped(frames: DataFrame, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Frames with `change` applied to each image (height x width x 3 bytes to the same kind): resizing, padding, mirroring."""

    shipped(frames.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for f, h, w, data in zip(*(b.column(c).to_pylist() for c in ("frame_id", "height", "width", "pixels")), strict=True):
                new = np.clip(np.rint(change(np.frombuffer(data, np.uint8).reshape(h, w, 3))), 0, 255).astype(np.uint8)
                rows.append((f, *new.shape[:2], new.tobytes()))
            names = ["frame_id", "height", "width", "pixels"]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names)

    return frames.select("frame_id", "height", "width", "pixels").mapInArrow(run, PIXELS)


def jpegs(stream: bytes) -> Iterator[bytes]:
    """The images of a motion-JPEG stream, by their start and end marks; what lies between images is left out."""
    at = 0
    while (start := stream.find(b"\xff\xd8\xff", at)) >= 0:
        end = stream.find(b"\xff\xd9", start)
        if end < 0:
            return
        yield stream[start : end + 2]
        at = end + 2


def video_frames(spark: SparkSession, folder: str, most: int = 0) -> DataFrame:
    """video (its path), frame_id (from 1) and content of each frame of motion-JPEG files; `most` frames of each unless 0."""

    shipped(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, stream in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                for i, jpeg in enumerate(jpegs(stream), 1):
                    if most and i > most:
                        break
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([i], pa.int64()), pa.array([jpeg], pa.binary())], ["video", "frame_id", "content"])

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(run, "video string, frame_id long, content binary")


def training_rows(frames: DataFrame, truth: DataFrame, densities: DataFrame) -> DataFrame:
    """Frames with their density map and count of truth boxes, 0 included."""
    n = truth.groupBy("frame_id").agg(F.count("*").alias("label"))
    return frames.join(densities.select("frame_id", "density"), "frame_id").join(n, "frame_id", "left").withColumn("label", F.coalesce("label", F.lit(0)))
