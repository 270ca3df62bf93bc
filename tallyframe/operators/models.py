"""Pluggable models: detectors and count estimators over frames, loaded once for each worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shipped

DETECTIONS = "frame_id long, x1 double, y1 double, x2 double, y2 double, obj_conf double, cls_conf double, class_id int"


class Detector(Protocol):
    """An expensive model: the boxes (x1, y1, x2, y2, obj_conf, cls_conf, class_id) of each image of a batch."""

    def __call__(self, images: list[bytes]) -> list[list[tuple[float, float, float, float, float, float, int]]]: ...


class Estimator(Protocol):
    """A cheap model: weights, means and deviations of a count mixture for each image of a batch."""

    def __call__(self, images: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]: ...


def detect(frames: DataFrame, load: Callable[[], Detector], batch: int = 64) -> DataFrame:
    """A row for each detection in frames (frame_id, content). `load` runs once in a task; images go to the model `batch` at a time."""

    shipped(frames.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in parts:
            for i in range(0, len(pdf), batch):
                some = pdf.iloc[i : i + batch]
                rows = [(f, *d) for f, found in zip(some.frame_id, model(list(some.content)), strict=True) for d in found]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in DETECTIONS.split(", ")])

    return frames.select("frame_id", "content").mapInPandas(run, DETECTIONS)


def estimate(frames: DataFrame, load: Callable[[], Estimator], batch: int = 64) -> DataFrame:
    """frame_id, pi, mu, sigma of each frame."""

    shipped(frames.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in parts:
            for i in range(0, len(pdf), batch):
                some = pdf.iloc[i : i + batch]
                pi, mu, sigma = model(list(some.content))
                yield pd.DataFrame({"frame_id": some.frame_id.to_numpy(), "pi": list(pi), "mu": list(mu), "sigma": list(sigma)})

    return frames.select("frame_id", "content").mapInPandas(run, "frame_id long, pi array<double>, mu array<double>, sigma array<double>")


def count_confirmer(frames: DataFrame, load: Callable[[], Detector], class_id: int, conf: float = 0.5) -> Callable[[DataFrame], DataFrame]:
    """For probabilistic top-k: runs the detector on chosen frames only and counts a class, 0 included."""

    def confirm(chosen: DataFrame) -> DataFrame:
        some = frames.join(F.broadcast(chosen), "frame_id")  # a batch of ids
        found = detect(some, load).filter((F.col("class_id") == class_id) & (F.col("obj_conf") >= conf)).groupBy("frame_id").agg(F.count("*").alias("n"))
        return chosen.join(found, "frame_id", "left").select("frame_id", F.coalesce("n", F.lit(0)).cast("double").alias("score"))

    return confirm


def table_confirmer(counts: DataFrame, frame_col: str = "frame_id", value: str = "n") -> Callable[[DataFrame], DataFrame]:
    """For probabilistic top-k over counts that are already known: looks chosen frames up, 0 where there is none."""
    own = counts.select(F.col(frame_col).alias("__f"), F.col(value).cast("double").alias("__n"))
    return lambda chosen: own.join(F.broadcast(chosen), F.col("__f") == F.col(frame_col), "right").select(frame_col, F.coalesce("__n", F.lit(0.0)).alias("score"))


def resized(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resizing of an H x W x C image; samples are at pixel centres."""
    h, w = pixels.shape[:2]
    y, x = (np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1) for n, m in ((height, h), (width, w)))
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    top = pixels[y0][:, x0] * (1 - fx) + pixels[y0][:, x1] * fx
    low = pixels[y1][:, x0] * (1 - fx) + pixels[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def padded_square(pixels: np.ndarray, value: float = 0.0) -> np.ndarray:
    h, w = pixels.shape[:2]
    d = abs(h - w)
    pad = ((d // 2, d - d // 2), (0, 0)) if h <= w else ((0, 0), (d // 2, d - d // 2))
    return np.pad(pixels, (*pad, (0, 0)), constant_values=value)


def random_side(rng: np.random.Generator, smallest: int = 288, largest: int = 448) -> int:
    """A side from smallest to largest in steps of 32, to resize a batch's images to."""
    return int(rng.choice(np.arange(smallest, largest + 1, 32)))


def flipped(pixels: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An image and its boxes (xc, yc, w, h normalised) mirrored left to right."""
    out = boxes.copy()
    out[:, 0] = 1 - out[:, 0]
    return pixels[:, ::-1], out


def tensor(pixels: np.ndarray, size: int = 416) -> np.ndarray:
    """H x W x C bytes to C x size x size within 0 and 1."""
    return resized(pixels.astype(np.float32) / 255, size, size).transpose(2, 0, 1)
