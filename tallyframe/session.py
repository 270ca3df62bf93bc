"""What executors need of the driver, and tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shipped(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context: they need not have it, nor share a folder with the driver."""
    sc, top = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(sc, "_package_sent", False) or not top.is_dir():
        return
    path = Path(tempfile.mkdtemp()) / f"{top.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted(top.rglob("*.py")):
            out.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(path))
    sc._package_sent = True


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that the session names; only a local session may leave it unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """Within, an execution's shuffle files go as it ends; the session's own setting comes back after."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write as Parquet to the shared folder and read again, safe against lost executors.

    The folder goes by `removed`, at the latest when the application ends.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    with shuffles_cleaned(spark):
        df.write.parquet(path)
    passing(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def passing(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the application ends."""
    fs, p = _hadoop(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)


def removed(spark: SparkSession, *frames: DataFrame | str) -> None:
    """Delete what `written` made, or folders, once nothing reads them any more."""
    for x in frames:
        for path in {x} if isinstance(x, str) else {f.rsplit("/", 1)[0] for f in x.inputFiles()}:
            fs, p = _hadoop(spark, path)
            fs.delete(p, True)
