"""Runs of the probabilistic top-k over a grid of parameters, as a table."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from .topk import GapList, probabilistic_top

SCHEMA = "k int, confidence double, gap int, seconds double, n_rounds int, mean_confirmed double, share_confirmed double, reached double, precision double, score_error double"


def multiset_share(approx: list[float], exact: list[float]) -> float:
    left, hits = list(exact), 0
    for v in approx:
        if v in left:
            left.remove(v)
            hits += 1
    return hits / len(exact) if exact else 0.0


def sweep(spark: SparkSession, table: DataFrame, confirm: Callable[[DataFrame], DataFrame], truth: list[tuple[int, float]], ks: Iterable[int], levels: Iterable[float], gap: int = 0, batch: int = 64) -> DataFrame:
    """A row for each k and confidence; seconds are a round's share of the search. `truth` has (frame, value) from the largest value, enough of it for the largest k and gap."""
    n, rows, levels = table.count(), [], list(levels)
    for k in ks:
        if gap:
            chosen = GapList(gap, k)
            for f, v in truth:
                if not chosen.push(v, f):
                    break
            exact = [v for v, _ in chosen.top]
        else:
            exact = [v for _, v in truth[:k]]
        began = time.monotonic()
        whole = probabilistic_top(table, confirm, k, max(levels), batch, gap)  # lower confidences are reached on its way
        seconds = time.monotonic() - began
        for level in levels:
            out = whole.at(level)
            error = sum(abs(a - b) for a, b in zip(out.values, exact, strict=False)) / k
            rows.append((k, float(level), gap, seconds * out.n_rounds / max(1, whole.n_rounds), out.n_rounds, sum(out.n_confirmed) / max(1, len(out.n_confirmed)), sum(out.n_confirmed) / max(1, n), out.confidence, multiset_share(out.values, exact), error))
    return spark.createDataFrame(rows, SCHEMA)
