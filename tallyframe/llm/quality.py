"""Quality rules: word and line counts, and zstandard compression bands.

A text is rejected when its compression ratio, or that of more than CHUNK_SHARE of its fixed chunks by bytes,
is outside the band for its length: above it is repetitive, below it incompressible.

Null and empty texts have no words, fail the base rule and get ratio 0. Each row is judged alone: repeated rows
give equal results and other columns never matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, keyed_text, raw_texts, slices, table

#: (bytes below which a band holds, lowest ratio, highest ratio). Short texts compress badly whatever they hold.
BANDS = ((128, 0.0, 3.0), (256, 0.6, 3.0), (1024, 1.05, 3.5), (4096, 1.15, 4.0), (16384, 1.25, 4.5), (float("inf"), 1.3, 5.0))
CHUNK_BYTES = 4096
CHUNK_SHARE = 0.3
LEVEL = 3
MIN_WORDS, MAX_REPEAT_PERCENT, SHINGLE = 20, 30, 8
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(9, 14)]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_bad_chunk_bytes long"


def band(n: int) -> tuple[float, float]:
    return next((low, high) for most, low, high in BANDS if n < most)


def compression(text: bytes, compressor: zstandard.ZstdCompressor) -> tuple[bool, float, int]:
    """(inside its band, ratio of the whole, bytes in chunks outside theirs)."""
    if not text:
        return True, 0.0, 0
    ratio = len(text) / len(compressor.compress(text))
    bad = 0
    if len(text) > CHUNK_BYTES:
        for i in range(0, len(text), CHUNK_BYTES):
            part = text[i : i + CHUNK_BYTES]
            low, high = band(len(part))
            if not low <= len(part) / len(compressor.compress(part)) <= high:
                bad += len(part)
    low, high = band(len(text))
    return low <= ratio <= high and bad <= CHUNK_SHARE * len(text), ratio, bad


def repeated_words(words: list[list[bytes]], size: int = SHINGLE) -> np.ndarray:
    """For each text, its words inside windows of `size` words that it holds twice or more.

    Windows get exact ranks by doubling: equal ranks of two halves are equal words, and the text's number is
    the first part of a rank, so windows of different texts never meet.
    """
    n = np.array([len(w) for w in words])
    flat = [x for w in words for x in w]
    out = np.zeros(len(words), np.int64)
    if not flat:
        return out
    owner = np.repeat(np.arange(len(words)), n)
    rank = pd.factorize(np.array(flat, dtype=object))[0].astype(np.int64)
    step = 1
    first = np.arange(len(rank))
    while step < size:
        left, right = rank[: len(rank) - step], rank[step:]
        rank = pd.factorize(left * (int(rank.max()) + 1 if len(rank) else 1) + right)[0].astype(np.int64)
        step *= 2
    first = first[: len(rank)]
    inside = owner[first] == owner[first + size - 1] if len(first) else np.zeros(0, bool)
    first, rank = first[inside], rank[inside]
    if not len(first):
        return out
    key = pd.factorize(rank * len(words) + owner[first])[0]
    twice = first[np.bincount(key)[key] > 1]
    edge = np.zeros(len(flat) + 1, np.int32)
    edge[twice] += 1
    edge[twice + size] -= 1
    return np.bincount(owner[np.cumsum(edge[:-1]) > 0], minlength=len(words))


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def judge(texts: list[bytes], compressor: zstandard.ZstdCompressor) -> list[tuple]:
    """SCHEMA's rows for a list of texts."""
    words = [t.split() for t in texts]
    repeated = repeated_words(words)
    data = np.frombuffer(b"".join(texts), np.uint8)
    end = np.cumsum([0, *map(len, texts)])
    chars = np.concatenate([[0], np.cumsum(((data & 0xC0) != 0x80) & ~SPACE[data], dtype=np.int64)])
    symbols = np.concatenate([[0], np.cumsum(SYMBOL[data], dtype=np.int64)])
    rows = []
    for i, t in enumerate(texts):
        n, again = len(words[i]), int(repeated[i])
        failed = n < MIN_WORDS or 100 * again > MAX_REPEAT_PERCENT * n
        fits, ratio, bad = compression(t, compressor)
        rows.append((n, int(chars[end[i + 1]] - chars[end[i]]), int(symbols[end[i + 1]] - symbols[end[i]]), dup_lines(t), again, failed, fits and not failed, ratio, bad))
    return rows


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id and SCHEMA."""
    bounded(df.sparkSession)
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.int64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for b in slices(batches):
            columns = zip(*judge(raw_texts(b), compressor), strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", *names])

    data = keyed_text(df, id_col, text_col)
    return data.mapInArrow(run, f"doc_id {data.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("ratio").alias("zstd_ratio")
    )


#: The base columns by DuckDB: 8-word windows as strings.
BASE_ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
x as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as k from d, unnest(range(1, greatest(len(w) - 6, 1))) as u(i)),
m as (select doc_id, k from x group by 1, 2 having count(*) > 1),
r as (select doc_id, count(distinct j) as n from (select doc_id, unnest(range(i, i + 8)) as j from x join m using (doc_id, k)) group by 1),
l as (select doc_id, count(*) - count(distinct line) as n from (select doc_id, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
b as (select d.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
  coalesce(l.n, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words from d left join r on d.doc_id = r.doc_id left join l on d.doc_id = l.doc_id)
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from b
"""


def quality_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3 says without the method's verdict."""
    return op3_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
