"""Finding repeated windows of a corpus: anchors, different blocks, a kernel for each anchor's blocks, and back to places.

1. Every run's anchor hash goes into one aggregate; anchors that occur once are left out.
2. Runs of the others (candidates) are aggregated by their block's 128-bit digest (BLAKE2b of its bytes, so that equal
   digests are equal blocks, also of texts made to collide): copies of a block count, they are not moved.
3. A block that is its anchor's only one is decided by its count. Of the others one copy each is cut from the texts.
4. An anchor's blocks meet in a task, where the operator's kernel finds the windows that they share. An anchor of more
   than HOT different blocks is split: its windows' distances from the anchor are cut into PARTS ranges, each window's
   range becomes a smaller block, dealt by the units that all windows of the range cover. Equal windows have equal
   distances and units, so they meet again, while the rest parts; smaller blocks are counted, decided or split like
   the first. At one window a block is its anchor's only one, so this ends.
5. Decided windows are joined back to the places of their blocks.

No step drops rows: whatever is left out is known not to repeat. Intermediate tables are in the shared folder. Joins
shuffle both sides unless Spark finds one under its broadcast limit; those on hot keys read plain tables, so that
adaptive execution can split them.
A text is known by its id and a 128-bit hash of the text: rows of one id, or without one, are kept apart, and repeated
rows agree. Ids of any type that has an order will do; those that aren't integers are numbered in their order first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import bounded, passing, raw_texts, removed, shared_dir, slices, written
from .winnow import runs

#: Text bytes that anchors are sought in at once; each takes about 100 bytes of memory.
ANCHOR_BYTES = 1 << 19
#: Different blocks of one anchor that one kernel call takes.
HOT, PARTS = 128, 6
#: Bytes of block text that a kernel works on at once, if single anchors allow.
KERNEL_BYTES = 2 << 20
#: Stands for a null id, below all others.
NO_ID = -(1 << 63)
#: What a text is known by.
KEY = ["id", "m1", "m2"]
RANGES = "array<struct<first:int,last:int,least:bigint>>"
#: (first window, one after the last, smallest id with such windows) in a block.
Range = tuple[int, int, int]


@dataclass(frozen=True)
class Plan:
    """What an operator brings: its units, window and gram sizes, its rule and its kernel."""

    size: int
    gram: int
    codes: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]  # 64-bit codes of texts one after another, and their numbers
    cutter: Callable[[bytes], Callable[[int, int], bytes]]  # of a text: the block from a unit to another
    across: bool  # windows must repeat across ids, not just anywhere
    kernel: Callable[..., list[list[Range]]]  # (blocks, anchor of each, copies, least id, greatest id, windows, anchor's place, shared folder for external files)


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, id (a number in the order of the ids, null lowest), m1 and m2 (a 128-bit hash of the text) and text."""
    own = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    number = F.col("doc_id").cast("long")
    if not isinstance(own.schema["doc_id"].dataType, IntegralType):
        ids = own.select(F.col("doc_id").alias("of")).filter("of is not null").distinct()
        ids = ids.repartitionByRange("of").sortWithinPartitions("of").withColumn("number", F.monotonically_increasing_id())
        own, number = own.join(written(ids, "ids"), F.col("doc_id") == F.col("of"), "left"), F.col("number")
    return own.select("doc_id", F.coalesce(number, F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("m1"), F.xxhash64(F.lit(1), "text").alias("m2"), "text")


def digests(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of each block's 128-bit digest."""
    both = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in blocks]), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _anchors(data: DataFrame, plan: Plan) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=ANCHOR_BYTES):
            t, *_, h = runs(*plan.codes(raw_texts(b)), plan.size, plan.gram)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column("id").take(pa.array(t))], ["h", "id"])

    return data.select("id", "text").mapInArrow(run, "h long, id long")


def _candidates(data: DataFrame, plan: Plan) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=ANCHOR_BYTES):
            texts = raw_texts(b)
            t, s, n, off, h = runs(*plan.codes(texts), plan.size, plan.gram)
            found, last, cut = [], -1, None
            for i, x, y in zip(t.tolist(), s.tolist(), (s + n + plan.size - 1).tolist(), strict=True):
                if i != last:
                    last, cut = i, plan.cutter(texts[i])
                found.append(cut(x, y))
            own = pa.array(t)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(own) for c in KEY), pa.array(s, pa.int32()), pa.array(n * 1024 + off, pa.int32()), *(pa.array(v) for v in (h.view(np.int64), *digests(found)))],
                [*KEY, "start", "shape", "h", "a", "b"],
            )

    return data.select(*KEY, "text").mapInArrow(run, "id long, m1 long, m2 long, start int, shape int, h long, a long, b long")


def _counted(blocks: DataFrame) -> DataFrame:
    """With k, the different blocks of each row's anchor."""
    k = written(blocks.groupBy("h").agg(F.count("*").alias("k")), "counts")
    return blocks.join(k, "h")


def _decided(blocks: DataFrame, plan: Plan) -> DataFrame:
    """Of anchors with one block: all its windows repeat if it does."""
    one = blocks.filter("k = 1").filter("most > least" if plan.across else "n > 1")
    whole = F.array(F.struct(F.lit(0).alias("first"), F.shiftright("shape", 10).alias("last"), F.col("least").alias("least")))
    return one.select("a", "b", whole.cast(RANGES).alias("ranges"))


def _same():
    """Of a text's key and one whose columns end in an underscore."""
    return (F.col("id") == F.col("id_")) & (F.col("m1") == F.col("m1_")) & (F.col("m2") == F.col("m2_"))


def _cut(data: DataFrame, blocks: DataFrame, plan: Plan) -> DataFrame:
    """The blocks with their text, from the place of one copy each."""
    wanted = blocks.groupBy(*KEY).agg(F.collect_list(F.struct("start", "shape", "h", "a", "b", "n", "least", "most", "k")).alias("wanted"))
    wanted = written(wanted.withColumnsRenamed({c: c + "_" for c in KEY}), "wanted")
    met = data.select(*KEY, "text").join(wanted, _same()).select(*KEY, "text", "wanted")
    names = ["h", "a", "b", "n", "least", "most", "k", "shape", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()  # the task's texts: repeated rows give their blocks once
        for b in slices(batches, most=ANCHOR_BYTES):
            rows: list[tuple] = []
            for *key, text, wanted in zip(*(b.column(c).to_pylist() for c in KEY), raw_texts(b), b.column("wanted").to_pylist(), strict=True):
                if tuple(key) in seen:
                    continue
                seen.add(tuple(key))
                cut = plan.cutter(text)
                rows += [(*(w[c] for c in names[:-1]), cut(w["start"], w["start"] + (w["shape"] >> 10) + plan.size - 1)) for w in wanted]
                if len(rows) > 8192:
                    yield _batch(rows, names)
                    rows = []
            if rows:
                yield _batch(rows, names)

    return met.mapInArrow(run, "h long, a long, b long, n long, least long, most long, k long, shape int, block binary")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"shape": pa.int32(), "block": pa.binary(), "at": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)


def _kernel(blocks: DataFrame, plan: Plan) -> DataFrame:
    """Shared windows of anchors with 2 to HOT blocks; an anchor's blocks are consecutive rows of one task."""
    folder = shared_dir(blocks.sparkSession, "external")
    passing(blocks.sparkSession, folder)
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("least", pa.int64())]))

    def out(rows: list[dict]) -> pa.RecordBatch:
        seen = {(r["a"], r["b"]): r for r in rows}
        rows = list(seen.values())
        n, least, most, shape = (np.array([r[c] for r in rows], np.int64) for c in ("n", "least", "most", "shape"))
        anchor = np.cumsum([0, *(x["h"] != y["h"] for x, y in zip(rows, rows[1:]))])  # noqa: B905
        found = plan.kernel([r["block"] for r in rows], anchor, n, least, most, shape >> 10, shape & 1023, folder)
        own = [(r["a"], r["b"], [dict(zip(("first", "last", "least"), x, strict=True)) for x in f]) for r, f in zip(rows, found, strict=True) if f]
        a, b, f = zip(*own, strict=True) if own else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(f, kind)], ["a", "b", "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, last = [], 0, None
        for b in batches:
            for r in b.to_pylist():
                if r["h"] != last and total > KERNEL_BYTES:
                    yield out(held)
                    held, total = [], 0
                held.append(r)
                total += len(r["block"])
                last = r["h"]
        if held:
            yield out(held)

    return blocks.filter(f"k between 2 and {HOT}").repartition("h").sortWithinPartitions("h").mapInArrow(run, f"a long, b long, ranges {RANGES}")


def _split(blocks: DataFrame, plan: Plan, step: int) -> DataFrame:
    """Smaller blocks, of windows whose distances from the anchor share a range of `step`; (pa, pb) and `at` say of what and where."""
    names = ["pa", "pb", "at", "h", "a", "b", "n", "least", "most", "shape", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                cut, count, off = plan.cutter(r["block"]), r["shape"] >> 10, r["shape"] & 1023
                first = 0
                while first < count:
                    part = (off - first) // step
                    last = min(count, off - part * step + 1)  # one after the last window of this range
                    s, e = off - part * step, off - part * step - step + 1 + plan.size  # covered by any window of the range
                    whole = cut(first, last + plan.size - 1)
                    (deal, one), (_, two) = digests([b"%d %b" % (part, cut(s, e)), whole])
                    rows.append((r["a"], r["b"], first, int(deal), int(one), int(two), r["n"], r["least"], r["most"], (last - first) * 1024 + off - first, whole))
                    first = last
            if rows:
                yield _batch(rows, names)

    return blocks.mapInArrow(run, "pa long, pb long, at int, h long, a long, b long, n long, least long, most long, shape int, block binary")


def _found(blocks: DataFrame, plan: Plan, step: int) -> DataFrame:
    """(a, b, ranges) of all blocks with windows that repeat; `blocks` has h, a, b, n, least, most, k, shape, block."""
    plain = written(_decided(blocks, plan).unionByName(_kernel(blocks, plan)), "found")
    hot = blocks.filter(F.col("k") > HOT)
    if not hot.limit(1).count():
        return plain
    step = -(-step // PARTS)
    parts = written(_split(hot, plan, step), "parts")
    one = parts.groupBy("h", "a", "b").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.min(F.struct("shape", "block")).alias("own"))
    next_ = written(_counted(written(one.select("h", "a", "b", "n", "least", "most", "own.shape", "own.block"), "split")), "split")
    inner = written(_found(next_, plan, step).withColumnsRenamed({"a": "a_", "b": "b_"}), "inner")
    met = parts.select("pa", "pb", "at", "a", "b").join(inner, (F.col("a") == F.col("a_")) & (F.col("b") == F.col("b_")))
    moved = F.transform("ranges", lambda x: F.struct((x.first + F.col("at")).alias("first"), (x["last"] + F.col("at")).alias("last"), x.least.alias("least")))
    own = met.select("pa", "pb", moved.alias("ranges")).groupBy("pa", "pb").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    return plain.unionByName(own.select(F.col("pa").alias("a"), F.col("pb").alias("b"), F.col("ranges").cast(RANGES)))


def spans(df: DataFrame, plan: Plan, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and spans array<struct<first,last>> of every row: units in repeated windows, in no order, possibly overlapping; null without any."""
    spark = df.sparkSession
    bounded(spark)
    data = keyed(df, id_col, text_col)
    met = _anchors(data, plan).groupBy("h").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n"))
    often = written(met.filter("most > least" if plan.across else "n > 1").select(F.col("h").alias("h_")), "anchors")
    found = written(_candidates(data, plan).join(often, F.col("h") == F.col("h_"), "left_semi"), "candidates")
    removed(spark, often)
    first = F.min(F.struct(*KEY, "start", "shape")).alias("own")
    blocks = found.groupBy("h", "a", "b").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("most"), first)
    blocks = written(_counted(written(blocks.select("h", "a", "b", "n", "least", "most", "own.*"), "different")), "blocks")
    whole = written(_cut(data, blocks.filter("k > 1"), plan), "cut")
    ranges = written(_decided(blocks, plan).unionByName(_found(whole, plan, plan.size - plan.gram + 1)).withColumnsRenamed({"a": "a_", "b": "b_"}), "ranges")
    removed(spark, blocks, whole)
    rows = found.join(ranges, (F.col("a") == F.col("a_")) & (F.col("b") == F.col("b_")))
    hits = F.filter("ranges", lambda x: x.least < F.col("id")) if plan.across else F.col("ranges")
    moved = F.transform(hits, lambda x: F.struct((x.first + F.col("start")).alias("first"), (x["last"] + F.col("start") + F.lit(plan.size - 1)).alias("last")))
    own = rows.select(*(F.col(c).alias(c + "_") for c in KEY), moved.alias("spans")).filter(F.size("spans") > 0)
    own = written(own.groupBy(*(c + "_" for c in KEY)).agg(F.flatten(F.collect_set("spans")).alias("spans")), "spans")  # repeated rows have equal ones
    removed(spark, found, ranges)
    return data.join(own, _same(), "left").select("doc_id", "text", "spans")


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Disjoint ascending runs that don't touch."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["first"], x["last"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def ranges_of(values: np.ndarray, valid: np.ndarray) -> list[Range]:
    """Runs of equal values among the valid: (first, one after the last, value)."""
    edge = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]) | (valid[1:] != valid[:-1]), [True]]))
    return [(s, e, int(values[s])) for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True) if valid[s]]
