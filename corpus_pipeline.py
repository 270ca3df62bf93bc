"""A training corpus from raw documents, in stages that each apply one operator to what the one before kept.

Every stage takes (spark, docs, sf_dir). Its result is written as Parquet and read again as the next one's docs, so
a lost executor costs no more than one stage's tasks. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import decontaminate, langid, pieces, secrets, simhash
from tallyframe.llm.common import removed, table, written

#: Documents whose language has a mean marginal below this are rejected, with those that have no letter.
LEAST_SCORE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told."""
    return langid.keep(docs, langid.train(docs), LEAST_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near-duplicates: fingerprints of op8 at 3 bits or fewer."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark and their lengths counted anew."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the sampled piece ids of each document."""
    own = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    return pieces.encode(docs.select(*own, "text")).select(*own, "ids", F.size("ids").cast("long").alias("n_pieces"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("sentencepiece", sentencepiece),
]

#: No stage but the fourth could be said in SQL; tests hold the pipeline against a plain Python version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if done is not None:
            removed(spark, done)
        done = docs
    return STAGES[-1][1](spark, docs, sf_dir)
