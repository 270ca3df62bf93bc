"""SimHash near-duplicates over a byte-position inverted index with count filtering.

A fingerprint has 8 positional bytes. Two that differ in 3 bits or fewer share 5 or more of them, so some four
shared positions form one of the 14 planes of the affine space over the positions: any three positions lie in exactly one
plane, whose complement is a plane too. The index therefore lists different fingerprints by their bytes at each plane, as
a list of one byte would hold a 256th of the corpus. Within a list, postings (position, byte) of the positions it
doesn't fix tally the positional bytes that a pair shares beyond those; pairs that reach the guaranteed 5 are verified
by their differing bits.

A list over BLOCK fingerprints is split: the bits that it doesn't fix are cut into four parts (a plane's first four
are the other bytes), and it becomes four sets of lists that fix one more part each. A pair at 3 bits or fewer agrees in
one of the parts, so it meets again, and lists of distinct fingerprints with few free bits are short; so this ends with
short lists however dense the fingerprints are. A list's links come out as a forest: connected fingerprints stay
connected, but not all pairs are emitted. Copies share a fingerprint and are one entry of the index.

Null, empty and wordless texts have fingerprint zero and are linked like any other. Repeated rows link to each other.
A null id never is a class id unless its class has no other. Ties can't arise: a class id is the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import bounded, hex64, keyed_text, raw_texts, removed, slices, table, unused, written
from .components import components

SEED, SHINGLE = 42, 3
BITS = 3
#: Positions (numbers 0 to 7) of the planes: fours whose exclusive or is 0.
PLANES = [p for p in combinations(range(8), 4) if p[0] ^ p[1] ^ p[2] ^ p[3] == 0]
MASKS = [sum(0xFF << 8 * p for p in plane) for plane in PLANES]
MIN_SHARED = 8 - BITS
#: Numbers of rows that are broadcast, 8 bytes each.
GONE = 1 << 20
#: Fingerprints of a list, and those of a list whose pairs are tallied together with other lists'.
BLOCK, SHORT = 512, 32
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < size:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())], np.uint64)  # noqa: B905
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed number, of every row."""
    bounded(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(t) for t in raw_texts(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    data = keyed_text(df, id_col, text_col)
    return data.mapInArrow(run, f"doc_id {data.schema['doc_id'].dataType.simpleString()}, fp long")


def finer(mask: int) -> list[int]:
    """The mask with each of BITS + 1 parts of its free bits: numbers that differ in BITS bits or fewer agree under one of them."""
    free = [b for b in range(64) if not mask >> b & 1]
    cut = [len(free) * i // (BITS + 1) for i in range(BITS + 2)]
    return [mask | sum(1 << b for b in free[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each place reaches over links from a to b."""
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def tallied(group: np.ndarray, fixed: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (one, other) of the pairs of short lists (rows sorted by `group`) whose tally reaches MIN_SHARED.

    `fixed` tells for each row the positions that its list has fixed, where all bytes are shared. The postings of all
    other positions are the runs of equal (group, byte); a pair's tally is how many of them it meets in, and the fixed ones.
    """
    data = values.view(np.uint8).reshape(-1, 8)
    known = fixed.sum(axis=1)
    n = len(values)
    met = []
    for p in range(8):
        rows = np.flatnonzero(~fixed[:, p])
        key = group[rows] * 256 + data[rows, p]
        order = np.argsort(key, kind="stable")
        rows, key = rows[order], key[order]
        for d in range(1, SHORT):
            i = np.flatnonzero(key[d:] == key[:-d]) if d < len(key) else key[:0]
            if not len(i):
                break
            met.append(rows[i] * n + rows[i + d])
    at = np.flatnonzero(known >= MIN_SHARED)  # lists that fix enough: no posting is needed
    for d in range(1, SHORT):
        i = at[at < n - d]
        i = i[group[i] == group[i + d]]
        if not len(i):
            break
        met += [i * n + i + d] * MIN_SHARED
    pair, count = np.unique(np.concatenate(met), return_counts=True) if met else (np.zeros(0, np.int64),) * 2
    one, other = pair // max(1, n), pair % max(1, n)
    enough = count + np.minimum(known[one], MIN_SHARED - 1) >= MIN_SHARED
    return one[enough], other[enough]


def forest(values: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (larger place, smaller place) that connect what the near pairs of one list of up to BLOCK values connect; its tallies are a table."""
    data = values.view(np.uint8).reshape(-1, 8)
    tally = np.full((len(values),) * 2, int(fixed.sum()), np.int8)
    for p in np.flatnonzero(~fixed).tolist():
        tally += data[:, p, None] == data[None, :, p]
    one, other = np.nonzero(np.triu(tally >= MIN_SHARED, 1))
    near = np.bitwise_count((values[one] ^ values[other]).view(np.uint64)) <= BITS
    label = _joined(np.arange(len(values)), other[near], one[near])
    own = np.flatnonzero(label != np.arange(len(values)))
    return own, label[own]


def links_of(mask: np.ndarray, value: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints whose rows (sorted by mask and value) are of one list."""
    edge = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (value[1:] != value[:-1]), [True]]))
    size = np.diff(edge)
    group = np.repeat(np.arange(len(size)), size)
    fixed = np.ascontiguousarray(mask).view(np.uint8).reshape(-1, 8) == 0xFF
    few = np.flatnonzero((size > 1)[group] & (size <= SHORT)[group])
    a, b = tallied(group[few], fixed[few], np.ascontiguousarray(fp[few]))
    a, b = few[a], few[b]
    near = np.bitwise_count((fp[a] ^ fp[b]).view(np.uint64)) <= BITS
    one, other = [fp[a[near]]], [fp[b[near]]]
    for g in np.flatnonzero(size > SHORT).tolist():
        s = slice(edge[g], edge[g + 1])
        a, b = forest(np.ascontiguousarray(fp[s]), fixed[edge[g]])
        one.append(fp[s][a])
        other.append(fp[s][b])
    return np.concatenate(one), np.concatenate(other)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _lists(entries: DataFrame) -> list[DataFrame]:
    """Written tables (fp, mask, value) whose lists, the rows of equal mask and value, have at most BLOCK fingerprints."""
    spark = entries.sparkSession
    masks, out = MASKS, []
    rows = entries.select("fp", F.explode(F.array(*(F.lit(_signed(m)).cast("long") for m in masks))).alias("mask"))
    while True:
        index = written(rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))), "index")
        long = index.groupBy("mask", "value").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)
        long = written(long.select(F.col("mask").alias("mask_"), F.col("value").alias("value_")), "long")
        masks = [m for m in masks if 64 - m.bit_count() > BITS]
        if not masks or not long.limit(1).count():
            removed(spark, long)
            return [*out, index]
        same = (F.col("mask") == F.col("mask_")) & (F.col("value") == F.col("value_"))
        out.append(written(index.join(long, same, "left_anti"), "lists"))
        children = spark.createDataFrame([(_signed(m), _signed(x)) for m in masks for x in finer(m)], "parent long, child long")  # of constant size: 4 for each mask
        hot = index.join(long, same, "left_semi").join(F.broadcast(children), F.col("mask") == F.col("parent"))
        rows = written(hot.select("fp", F.col("child").alias("mask")).distinct(), "finer")
        masks = sorted({x for m in masks for x in finer(m)})
        removed(spark, index, long)


def links(entries: DataFrame) -> DataFrame:
    """Links (a, b) between the different fingerprints in column fp."""
    spark = entries.sparkSession
    bounded(spark)
    lists = _lists(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            a, b = links_of(*(np.concatenate(x) for x in zip(*rows, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            now = tuple(batch.column(c).to_numpy() for c in ("mask", "value", "fp"))
            if not len(now[0]):
                continue
            change = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            cut = int(change[-1]) + 1 if len(change) else 0  # the last list may go on in the next batch
            if cut or held and (held[-1][0][-1], held[-1][1][-1]) != (now[0][-1], now[1][-1]):
                yield out([*held, tuple(x[:cut] for x in now)])
                held = []
            held.append(tuple(x[cut:] for x in now))
        if held:
            yield out(held)

    every = lists[0]
    for more in lists[1:]:
        every = every.unionByName(more)
    found = every.select("mask", "value", "fp").repartition("mask", "value").sortWithinPartitions("mask", "value").mapInArrow(run, "a long, b long")
    out = written(found.distinct(), "pairs")
    removed(spark, *lists)
    return out


def labelled(entries: DataFrame) -> DataFrame:
    """The different fingerprints' rows with `label`, the smallest fingerprint that each reaches over links."""
    found = links(entries)
    labels = components(found)
    out = written(entries.join(labels, F.col("fp") == F.col("node"), "left").withColumn("label", F.coalesce("label", "fp")).drop("node"), "labelled")
    removed(entries.sparkSession, found, labels)
    return out


def classed(told: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of every row of (doc_id, fp)."""
    entries = written(told.groupBy("fp").agg(F.min("doc_id").alias("least")), "entries")
    joined = labelled(entries)
    best = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    named = written(joined.join(best, "label").select(F.col("fp").alias("fp_"), "component_id"), "named")
    removed(told.sparkSession, entries, joined)
    return told.join(named, F.col("fp") == F.col("fp_")).select("doc_id", "fp", "component_id")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links) of every row."""
    return classed(written(fingerprints(df, id_col, text_col), "fingerprints"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


#: The primes of XXH64.
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def _xxh64_sql() -> str:
    """XXH64 of the bytes in list b (numbers of 128 bits, of which there are n), as the algorithm is published."""
    p1, p2, p3, p4, p5 = (f"{p}::uhugeint" for p in PRIMES)
    whole = "18446744073709551616::uhugeint"
    mod = lambda x: f"(({x}) % {whole})"
    turned = lambda x, r: f"list_transform([{x}], lambda v: (v * {1 << r}::uhugeint) % {whole} + v // {1 << 64 - r}::uhugeint)[1]"
    lane = lambda at, k: "(" + " + ".join(f"b[{at} + {i + 1}] * {256**i}::uhugeint" for i in range(k)) + ")"
    mixed = lambda acc, x: mod(f"{turned(mod(f'{acc} + {mod(f"{x} * {p2}")}'), 31)} * {p1}")
    start = [(SEED + PRIMES[0] + PRIMES[1]) % 2**64, (SEED + PRIMES[1]) % 2**64, SEED, (SEED - PRIMES[0]) % 2**64]
    sums = [f"list_reduce(range(0, n // 32), lambda a, i: {mixed('a', lane(f'32 * i + {8 * k}', 8))}, {v}::uhugeint)" for k, v in enumerate(start)]
    steps = [
        "select id, n, b, " + ", ".join(f"{x} as v{k}" for k, x in enumerate(sums)) + " from bytes",
        "select *, " + mod(" + ".join(turned(f"v{k}", r) for k, r in enumerate((1, 7, 12, 18)))) + " as h from ({})",
        *(f"select * replace ({mod(f'xor(h, {mixed("0::uhugeint", f"v{k}")}) * {p1} + {p4}')} as h) from ({{}})" for k in range(4)),
        f"select id, n, b, (case when n >= 32 then h else {(SEED + PRIMES[4]) % 2**64}::uhugeint end + n::uhugeint) % {whole} as h from ({{}})",
        f"select * replace (list_reduce(range(n // 32 * 4, n // 8), lambda a, i: {mod(f'{turned(f"xor(a, {mixed('0::uhugeint', lane('8 * i', 8))})", 27)} * {p1} + {p4}')}, h) as h) from ({{}})",
        f"select * replace (case when n % 8 >= 4 then {mod(f'{turned(f"xor(h, {mod(f'{lane("n // 8 * 8", 4)} * {p1}')})", 23)} * {p2} + {p3}')} else h end as h) from ({{}})",
        f"select * replace (list_reduce(range(n // 4 * 4, n), lambda a, i: {mod(f'{turned(f"xor(a, {mod(f'b[i + 1] * {p5}')})", 11)} * {p1}')}, h) as h) from ({{}})",
        f"select * replace ({mod(f'xor(h, h // {1 << 33}::uhugeint) * {p2}')} as h) from ({{}})",
        f"select * replace ({mod(f'xor(h, h // {1 << 29}::uhugeint) * {p3}')} as h) from ({{}})",
        f"select id, xor(h, h // {1 << 32}::uhugeint) as h from ({{}})",
    ]
    out = steps[0]
    for step in steps[1:]:
        out = step.format(out)
    return out


#: The same rows by DuckDB: XXH64 in whole numbers, all pairs of documents; for small tables.
ORACLE = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, array_to_string(w[i:i + 2], ' ') as shingle from w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as t(i) where len(w) > 0),
ids as (select shingle, row_number() over () as id, hex(encode(shingle)) as x from (select distinct shingle from s)),
bytes as (select id, length(x) // 2 as n, list_transform(range(0, length(x) // 2), lambda i: cast('0x' || x[2 * i + 1:2 * i + 2] as utinyint)::uhugeint) as b from ids),
hashed as ({_xxh64_sql()}),
each as (select doc_id, h::ubigint as h from s join ids using (shingle) join hashed using (id)),
bits as (select doc_id, {" + ".join(f"case when 2 * sum((h >> {k}) & 1) > count(*) then {1 << k}::uhugeint else 0::uhugeint end" for k in range(64))} as fp from each group by 1),
d as (select doc_id, coalesce(fp, 0::uhugeint)::ubigint as fp from documents left join bits using (doc_id)),
e as (select a.doc_id as a, b.doc_id as b from d a join d b on bit_count(xor(a.fp, b.fp)::bit) <= {BITS}),
r as (select a as node, a as seen from e union select r.node, e.b from r join e on r.seen = e.a),
c as (select node, min(seen) as component_id from r group by 1)
select doc_id, format('{{:016x}}', fp) as fingerprint, component_id from d join c on doc_id = node
"""


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, all columns as they were, of each class of near-duplicates: that of the smallest id (a null one only where there is no other).

    Rows are numbered as they are written, so classes are of rows, whatever their ids: of rows of one id the one whose
    text's hash is smallest goes before, of wholly equal ones the first. The numbers of the rows that go are broadcast if
    they are at most GONE, else joined.
    """
    bounded(df.sparkSession)
    fp, row, number = unused(df, "fp", "row", "gone")
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            told = np.array([fingerprint(t) for t in raw_texts(b, at)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(told)], [*b.schema.names, fp])

    rows = written(df.mapInArrow(run, StructType([*df.schema.fields, StructField(fp, LongType())])).withColumn(row, F.monotonically_increasing_id()), "rows")
    rank = F.struct(F.col(id_col).isNull(), F.col(id_col), F.xxhash64(text_col), F.col(row).alias("row"))
    entries = written(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(rank).alias("best")), "entries")
    joined = labelled(entries)
    best = joined.groupBy("label").agg(F.min("best").alias("first")).select("label", F.col("first.row").alias("first"))
    named = written(joined.join(best, "label").select(F.col("fp").alias("fp_of"), "first"), "named")
    narrow = rows.select(F.col(row).alias(number), F.col(fp).alias("fp"))
    gone = written(narrow.join(named, F.col("fp") == F.col("fp_of")).filter(F.col(number) != F.col("first")).select(number), "gone")
    removed(df.sparkSession, entries, joined, named)
    few = gone.count() <= GONE
    return rows.join(F.broadcast(gone) if few else gone, F.col(row) == F.col(number), "left_anti").select(*df.columns)
