"""Suffix-array dedup: bytes covered by a string of 200 bytes that also starts elsewhere go.

`blocks` says how the corpus is cut so that equal windows meet: an exact filter before the construction. In a task, the
blocks of many anchors are a collection of documents aligned at their anchors. It is sorted column by column from the right
through sequential files in the shared folder: each round reads one column, one symbol of each document, and inserts it.
The symbols in the order of the suffixes so far are that column's part of the collection's Burrows-Wheeler transform;
stably sorting by them gives the order of the suffixes that are one symbol longer, and the common prefixes of neighbours
follow from the smallest one between their places before. Each round appends its part of the transform, the new order
and the common prefixes to a file of SEGMENT rounds; the next file's first round starts from the last run of the one
before. When all columns are in, the files are read from the first, and neighbours with SIZE common symbols or more
are repeated windows. Equal windows stand in equal columns, so the parts of different columns are not merged into one
transform, which would make every round rewrite all those before it.

Matches never cross texts. Null and empty texts and those under SIZE bytes lose nothing. Repeated rows repeat each other: all
of them lose what they share. Overlapping windows count, in one text too. Ids that are null or repeat are kept apart by a
hash of the text. Other columns never matter.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

from . import blocks as B
from .blocks import Plan, Range, merged, ranges_of
from .common import raw_texts, slices, table
from .winnow import finished

SIZE, GRAM = 200, 32
#: Rounds of one external file.
SEGMENT = 64
CODES = finished(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return CODES[np.frombuffer(b"".join(texts), np.uint8)], np.array([len(t) for t in texts], np.int64)


def cutter(text: bytes) -> Callable[[int, int], bytes]:
    return lambda s, e: text[s:e]


def inserted(order: np.ndarray, common: np.ndarray, group: np.ndarray, symbol: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """One round: the documents in the order of their suffixes with one more symbol in front, and the common prefixes with those before them.

    Stable sorting by group and symbol is the LF mapping. Two suffixes with one symbol in front have one more in common
    than the least of the common prefixes between them before; with different symbols they have none.
    """
    key = group[order] * 256 + symbol[order]
    place = np.argsort(key, kind="stable")
    key = key[place]
    same = np.flatnonzero(key[1:] == key[:-1])
    out = np.zeros(len(order), np.int32)
    if len(same):
        ends = np.stack([place[same] + 1, place[same + 1] + 1], axis=1).ravel()
        between = np.minimum.reduceat(np.append(common, 0), ends)[::2]
        out[same + 1] = np.minimum(between + 1, most)
    return order[place], out


class External:
    """Sequential files of one collection, in the shared folder; in memory without one, or where only Spark reads it."""

    def __init__(self, folder: str | None):
        self.held: dict[str, pa.Buffer] = {}
        try:
            self.fs, self.path = pyarrow.fs.FileSystem.from_uri(f"{folder.replace('s3a://', 's3://')}/{uuid.uuid4().hex}") if folder else (None, "")
        except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
            self.fs, self.path = None, ""
        if self.fs:
            self.fs.create_dir(self.path, recursive=True)

    def write(self, name: str) -> pa.NativeFile:
        return self.fs.open_output_stream(f"{self.path}/{name}") if self.fs else pa.BufferOutputStream()

    def done(self, name: str, stream: pa.NativeFile) -> None:
        if self.fs:
            stream.close()
        else:
            self.held[name] = stream.getvalue()

    def read(self, name: str) -> pa.NativeFile:
        return self.fs.open_input_file(f"{self.path}/{name}") if self.fs else pa.BufferReader(self.held[name])

    def clear(self) -> None:
        if self.fs:
            self.fs.delete_dir(self.path)


def put(file: pa.NativeFile, x: int, symbols: np.ndarray, order: np.ndarray, common: np.ndarray) -> None:
    """Append a round's run: its column, the transform's part, the order of the documents and the common prefixes."""
    file.write(np.array([x, len(symbols), len(order)], np.int32).tobytes() + symbols.tobytes() + order.astype(np.int32).tobytes() + common.astype(np.int16).tobytes())


def get(file: pa.NativeFile) -> tuple[int, np.ndarray, np.ndarray, np.ndarray] | None:
    """The next run, or None at the end."""
    head = file.read(12)
    if not head:
        return None
    x, m, n = np.frombuffer(head, np.int32).tolist()
    return x, np.frombuffer(file.read(m), np.uint8), np.frombuffer(file.read(4 * n), np.int32).astype(np.int64), np.frombuffer(file.read(2 * n), np.int16).astype(np.int32)


def construct(files: External, blocks: list[bytes], anchor: np.ndarray, off: np.ndarray, size: int) -> list[str]:
    """Insert all columns of a collection; the names of the files of runs, in order."""
    m = len(blocks)
    length = np.array([len(b) for b in blocks], np.int64)
    begin, end = -off, length - off
    low, high = int(begin.min()), int(end.max())
    whole = np.zeros((high - low, m), np.uint8)  # columns from the right are rows here
    own = np.repeat(np.arange(m), length)
    column = np.arange(len(own)) - np.repeat(np.cumsum(length) - length, length) - off[own]
    whole[high - 1 - column, own] = np.frombuffer(b"".join(blocks), np.uint8)
    out = files.write("columns")
    out.write(whole.tobytes())
    files.done("columns", out)
    del whole, own, column
    starting = np.argsort(end, kind="stable")
    at = np.searchsorted(end[starting], np.arange(low, high + 2))
    stops = set(begin.tolist())
    names, last = [], 0
    with files.read("columns") as columns:
        for top in range(high - 1, low - 1, -SEGMENT):
            order, common = np.zeros(0, np.int64), np.zeros(0, np.int32)
            if names:
                with files.read(names[-1]) as before:
                    before.seek(last)
                    _, _, order, common = get(before)
            names.append(f"runs{len(names)}")
            out = files.write(names[-1])
            for x in range(top, max(low, top - SEGMENT + 1) - 1, -1):
                symbol = np.frombuffer(columns.read(m), np.uint8)
                if x + 1 in stops:  # documents that begin right of here are done
                    stay = np.flatnonzero(begin[order] <= x)
                    if len(stay) < len(order):  # what a document has in common with the one before that stays: the least up to there
                        common = np.minimum.reduceat(common[: stay[-1] + 1], np.concatenate([[0], stay[:-1] + 1])) if len(stay) else common[:0]
                        order = order[stay]
                new = starting[at[x + 1 - low] : at[x + 2 - low]]
                if len(new):
                    order, common = np.concatenate([new, order]), np.concatenate([np.zeros(len(new), np.int32), common])
                    common[len(new) : len(new) + 1] = 0
                symbols = symbol[order]
                if len(order):
                    order, common = inserted(order, common, anchor, symbol, size)
                last = out.tell()
                put(out, x, symbols, order, common)
            files.done(names[-1], out)
    return names


def kernel(blocks: list[bytes], anchor: np.ndarray, copies: np.ndarray, least: np.ndarray, most: np.ndarray, windows: np.ndarray, off: np.ndarray, folder: str | None = None, size: int = SIZE) -> list[list[Range]]:
    """The windows of each block that start twice or more in the collection."""
    flags = np.zeros((len(blocks), int(windows.max())), bool)
    files = External(folder)
    try:
        for name in construct(files, blocks, anchor, off, size):
            with files.read(name) as runs:
                while run := get(runs):
                    x, _, order, common = run
                    first = x + off[order]
                    number = np.cumsum(common < size) - 1
                    starts = first < windows[order]
                    total = np.bincount(number, weights=copies[order] * starts)
                    again = np.flatnonzero((total[number] > 1) & starts) if len(order) else number
                    flags[order[again], first[again]] = True
    finally:
        files.clear()
    zero = np.zeros(flags.shape[1], np.int8)
    return [ranges_of(zero[:n], f[:n]) for f, n in zip(flags, windows.tolist(), strict=True)]


PLAN = Plan(SIZE, GRAM, codes, cutter, False, kernel)


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and spans array<struct<first,last>>, byte runs to remove (null: none; unsorted, may overlap), of every row."""
    return B.spans(df, PLAN, id_col, text_col)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from `spans`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for t, own in zip(raw_texts(b), b.column("spans").to_pylist(), strict=True):
                cuts, kept, at = merged(own), [], 0
                for s, e in cuts:
                    kept.append(t[at:s])
                    at = e
                kept.append(t[at:])
                rows.append((len(t), sum(e - s for s, e in cuts), len(cuts), hashlib.sha256(b"".join(kept)).hexdigest()))
            n, gone, runs, sha = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, gone, runs)), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


#: The same rows by DuckDB: a row for each window; for small tables.
ORACLE = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
x as (select doc_id, i, md5(substr(h, 2 * i - 1, 400)) as k from d, unnest(range(1, greatest(n - 198, 1))) as t(i)),
m as (select k from x group by 1 having count(*) > 1),
s as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from x semi join m using (k)),
q as (select doc_id, i, sum(case when before is null or i > before + 200 then 1 else 0 end) over (partition by doc_id order by i) as run from s),
r as (select doc_id, run, min(i) as a, max(i) + 200 as z from q group by 1, 2),
e as (select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 1) as since, row_number() over (partition by doc_id order by a desc) as last from r),
k as (select e.doc_id, sum(z - a) as n_removed, count(*) as n_spans, string_agg(substr(h, 2 * since - 1, 2 * (a - since)), '' order by a) || max(case when last = 1 then substr(h, 2 * z - 1) else '' end) as kept
  from e join d on e.doc_id = d.doc_id group by 1)
select d.doc_id, n as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256 from d left join k on d.doc_id = k.doc_id
"""


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spans(table(spark, sf_dir, "documents")))
