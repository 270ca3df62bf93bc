"""Density maps: one bell curve for each object, so that a map sums to the count."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .frames import Arrays, per_frame

SIGMA, REACH = 15.0, 4.0


def kernel(sigma: float = SIGMA, reach: float = REACH) -> np.ndarray:
    """A normalised sampled bell curve."""
    r = int(reach * sigma + 0.5)
    x = np.arange(-r, r + 1)
    w = np.exp(-0.5 * (x / sigma) ** 2)
    return w / w.sum()


def density(points: np.ndarray, height: int, width: int, sigma: float = SIGMA) -> np.ndarray:
    """Map of (x, y) points; those outside don't count, several in a cell count once, and what falls over the border is lost."""
    cells = {(int(x), int(y)) for x, y in points if 0 <= x < width and 0 <= y < height}
    out = np.zeros((height, width))
    w = kernel(sigma)
    r = len(w) // 2
    for x, y in cells:  # separable: a column times a row, cut at the border
        x0, x1, y0, y1 = max(0, x - r), min(width, x + r + 1), max(0, y - r), min(height, y + r + 1)
        out[y0:y1, x0:x1] += np.outer(w[y0 - y + r : y1 - y + r], w[x0 - x + r : x1 - x + r])
    return out


def density_maps(boxes: DataFrame, height: int, width: int, sigma: float = SIGMA, kind: str = "float") -> DataFrame:
    """frame_id, height, width and density (row by row, of 32 bits or as `double`) from normalised centres xc, yc."""

    def one(frame: int, r: Arrays) -> list[tuple]:
        points = np.column_stack([r["xc"] * width, r["yc"] * height])
        return [(frame, height, width, density(points, height, width, sigma).astype(np.float32 if kind == "float" else np.float64).ravel())]

    return per_frame(boxes.select("frame_id", "xc", "yc"), [], one, f"frame_id long, height int, width int, density array<{kind}>")
