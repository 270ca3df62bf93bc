"""What the text operators share: reading tables, bounded Arrow batches, shared scratch tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import passing, removed, shared_dir, shipped, shuffles_cleaned, written

__all__ = ["bounded", "hex64", "keyed_text", "passing", "raw_texts", "removed", "shared_dir", "shuffles_cleaned", "slices", "table", "unused", "written"]

#: Text bytes that one step of a Python kernel takes at once; a longer single text is a step of its own.
SLICE_BYTES = 4 << 20
#: Rows in an Arrow batch sent to Python; whole batches are in a worker's memory.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(spark: SparkSession) -> None:
    """Keep Arrow batches small: a batch of BATCH_ROWS very long texts still fits a worker.

    Batches are sized when a plan runs, after the operator has returned it, so the session keeps these settings;
    smaller ones of its own stay as they are.
    """
    shipped(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        own = str(spark.conf.get(key))
        if not (own.isdigit() and 0 < int(own) <= most):
            spark.conf.set(key, str(most))


def keyed_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns, `doc_id` and `text`, whatever else the input holds; a null text stays null."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str | int = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each has at most `most` bytes of text, or one row."""
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(lengths):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(lengths):
            yield batch.slice(start)


def raw_texts(batch: pa.RecordBatch, column: str | int = "text") -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put in front until the input has no such column."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        out.append(n)
    return out


def hex64(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))
