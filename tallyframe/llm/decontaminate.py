"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts are lower-cased (A-Z) and reduced to words joined by one space; a pattern is a window of benchmark words
with a space at either end, so matches fall on whole words. Patterns are grouped by length. A group's shift table
says, by a hash of the block that ends a window's shortest length, how far the window can move; where the shift
is 0, the block selects a bucket of patterns, of which those of each length that it has are looked up and compared
directly, however many patterns end their window alike. Many stretches of a text advance together.

A benchmark of up to PASS_BYTES is broadcast and the rows stream by once. A larger one is cut into parts of that size, long
items into stretches that overlap by all but one word of a window; the numbered rows are written, and each part in
turn is searched for in all of them, so that no more than one part is in the driver or a worker at any time.

Null texts and texts without words are never hit; null, empty or wordless items have no window; equal windows of
several items count for each of them. Rows are independent: repeated rows and ids each give their own result.
An item id that repeats is one item, listed once. Items without an id are one item: its windows hit words and it is
counted, but has no name to be listed by. Added columns get other names where the input has theirs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import bounded, keyed_text, raw_texts, slices, table, unused, written

WINDOW = 13
#: Lower-cases A-Z and makes every byte that isn't of a word a space.
FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: Benchmark bytes that one pass searches for.
PASS_BYTES = 16 << 20
TABLE_BITS = 18
LANE = 512
MIX = np.uint64(0x9E3779B97F4A7C15)


def folded(text: bytes) -> bytes:
    """` w1 w2 ... `, or a single space where there are no words."""
    return b" ".join([b"", *text.translate(FOLD).split(), b""]) if text else b" "


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    words = text.translate(FOLD).split()
    if not words:
        return []
    return [b" ".join([b"", *words[i : i + size], b""]) for i in range(max(1, len(words) - size + 1))]


class Group:
    """Patterns of similar length; `least` is the shortest length, the search window."""

    def __init__(self, patterns: list[bytes]):
        self.least = min(map(len, patterns))
        self.block = 8 if self.least >= 16 else min(4, self.least)
        self.mask = np.uint64((1 << 8 * self.block) - 1)
        self.shift = np.full(1 << TABLE_BITS, self.least - self.block + 1, np.int32)
        self.bucket: dict[int, dict[int, set[bytes]]] = defaultdict(lambda: defaultdict(set))  # by block and length
        heads = np.frombuffer(b"".join(p[: self.least] for p in patterns), np.uint8).reshape(len(patterns), self.least)
        for end in range(self.block, self.least + 1):
            blocks = np.zeros(len(patterns), np.uint64)
            for k in range(self.block):
                blocks |= heads[:, end - self.block + k].astype(np.uint64) << np.uint64(8 * k)
            np.minimum.at(self.shift, self.slot(blocks), self.least - end)
        for p, b in zip(patterns, blocks.tolist(), strict=True):
            self.bucket[b][len(p)].add(p)

    @staticmethod
    def slot(blocks: np.ndarray) -> np.ndarray:
        return ((blocks * MIX) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def find(self, data: bytes) -> Iterator[tuple[int, bytes]]:
        """(position, pattern) of every occurrence in data, which has 8 bytes of padding."""
        last = len(data) - 8 - self.least
        if last < 0:
            return
        at = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        here = np.arange(0, last + 1, LANE, dtype=np.int64)
        stop = np.minimum(here + LANE, last + 1)
        off = self.least - self.block
        while len(here):
            blocks = at[here + off] & self.mask
            step = self.shift[self.slot(blocks)]
            zero = step == 0
            for p, b in zip(here[zero].tolist(), blocks[zero].tolist(), strict=True):
                for n, patterns in self.bucket[b].items() if b in self.bucket else ():
                    if (found := data[p : p + n]) in patterns:
                        yield p, found
            here = here + np.maximum(step, 1)
            live = here < stop
            here, stop = here[live], stop[live]


class Searcher:
    def __init__(self, items: list[tuple[object, bytes]], size: int = WINDOW):
        self.owners: dict[bytes, set] = defaultdict(set)
        for item, text in items:
            for w in windows(text, size):
                self.owners[w].add(item)
        by = defaultdict(list)
        for w in self.owners:
            by[min(6, len(w).bit_length())].append(w)
        self.groups = [Group(g) for g in by.values()]

    def search(self, texts: list[bytes]) -> list[tuple[int, list[int], set]]:
        """For each text its words, the numbers of those hit, and the items with occurring windows."""
        parts = [folded(t) for t in texts]
        data = b"\n".join(parts) + b"\n" + bytes(8)
        begin = np.cumsum([0, *(len(p) + 1 for p in parts)])
        spaces = np.concatenate([[0], np.cumsum(np.frombuffer(data, np.uint8) == 0x20, dtype=np.int64)])
        hit: dict[int, set[int]] = defaultdict(set)
        items: dict[int, set] = defaultdict(set)
        for g in self.groups:
            for p, pattern in g.find(data):
                i = int(np.searchsorted(begin, p, "right")) - 1
                word = int(spaces[p] - spaces[begin[i]])
                hit[i].update(range(word, word + pattern.count(b" ") - 1))
                items[i] |= self.owners[pattern]
        return [(max(0, p.count(b" ") - 1), sorted(hit.get(i, ())), items.get(i, set())) for i, p in enumerate(parts)]


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).filter("text is not null")


def _parts(items: DataFrame, size: int) -> DataFrame:
    """The items as (item, text, part): long ones in stretches, and numbers of parts of about PASS_BYTES each."""
    most = PASS_BYTES // 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            names, texts = [], []
            for item, t in zip(b.column("item").to_pylist(), raw_texts(b), strict=True):
                words = folded(t).split()
                step = max(1, most * len(words) // max(1, len(t)))
                for i in range(0, max(1, len(words) - size + 1), step):
                    names.append(item)
                    texts.append(b" ".join(words[i : i + step + size - 1]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["item", "text"])

    cut = written(items.mapInArrow(run, "item string, text string"), "items")
    total = cut.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    return cut.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(max(1, -(-total // PASS_BYTES)))))


def _found(rows: DataFrame, told: Broadcast, at: int, names: list[str], size: int) -> DataFrame:
    """The rows and what is found in the text at place `at` of the broadcast items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(told.value, size)
        for b in slices(batches, at):
            n, hits, items = zip(*searcher.search(raw_texts(b, at)), strict=True)
            items = [sorted(x, key=lambda i: (i is None, i)) for x in items]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], [*b.schema.names, *names])

    kinds = (LongType(), ArrayType(IntegerType()), ArrayType(StringType()))
    return rows.mapInArrow(run, StructType([*rows.schema.fields, *(StructField(n, k) for n, k in zip(names, kinds, strict=True))]))


def searched(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW) -> tuple[DataFrame, list[str]]:
    """The rows, all columns as they were, with three more, whose names are told: words, numbers of the hit words, and item ids, both ascending (a null id last)."""
    spark = df.sparkSession
    bounded(spark)
    sc = spark.sparkContext
    names, at = unused(df, "n_words", "hits", "items"), df.columns.index(text_col)
    items = _items(benchmark, item_col, item_text)
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    if total <= PASS_BYTES:
        return _found(df, sc.broadcast([(r.item, r.text.encode()) for r in items.collect()]), at, names, size), names
    (row,) = unused(df, "row")
    rows = written(df.withColumn(row, F.monotonically_increasing_id()), "rows")
    parts = written(_parts(items, size), "parts")
    own = rows.select(F.col(row).alias("at"), F.col(text_col).cast("string").alias("text"))
    out: DataFrame | None = None
    for r in parts.select("part").distinct().orderBy("part").toLocalIterator():
        told = sc.broadcast([(x.item, x.text.encode()) for x in parts.filter(F.col("part") == r.part).collect()])
        now = written(_found(own, told, 1, ["n", "hits", "items"], size).filter("size(hits) > 0" if out else "true").drop("text"), "hits")
        told.destroy()
        out = now if out is None else out.unionByName(now)
    merged = out.groupBy("at").agg(F.max("n").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = merged.toDF(*(more := unused(rows, "at", *names)))
    joined = rows.join(merged, F.col(row) == F.col(more[0]))
    return joined.select(*df.columns, *(F.col(c).alias(n) for c, n in zip(more[1:], names, strict=True))), names


def search(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, hits (numbers of the hit words, ascending), items (ids as strings, ascending, a null one last) of every row."""
    found, names = searched(keyed_text(df, id_col, text_col), benchmark, "text", item_col, item_text, size)
    return found.select("doc_id", *names)


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """1 word in 20 or more is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows, all columns as they were, that aren't contaminated."""
    found, (words, hits, _) = searched(df, benchmark, text_col)
    return found.filter(~contaminated(F.size(hits).cast("long"), F.col(words))).select(*df.columns)


def verdicts(found: DataFrame) -> DataFrame:
    """The contract's columns from what `search` found."""
    n_hit = F.size("hits").cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same rows by DuckDB: windows as strings, joined; for small tables.
ORACLE = rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') as w from benchmark),
p as (select distinct item_id, least(len(w), 13) as n, array_to_string(w[i:i + 12], ' ') as k from b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as t(i) where len(w) > 0),
x as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as k from d, (select distinct n from p), unnest(range(1, greatest(len(w) - n + 2, 1))) as t(i)),
h as (select doc_id, i, x.n, item_id from x join p on x.n = p.n and x.k = p.k),
c as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from h) group by 1),
o as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from h) group by 1)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join c using (doc_id) left join o using (doc_id)
"""


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
