"""Substring dedup: words covered by a window of 50 words that also starts in a document of smaller id go.

`blocks` says how the corpus is cut so that equal windows meet. In a task, the suffixes that start the windows of its blocks
are split by variable-length prefixes: a prefix of one word is made longer, word by word, where more than LIMIT suffixes
share it, and small groups share a tree. Each group's suffixes are sorted, the common prefixes of neighbours give its
suffix tree's internal nodes, and those of SIZE words or more (to which suffixes are cut, so none is below another) are
the repeated windows; a node's smallest id decides for all suffixes below it.

Tasks are dealt by prefixes too, though not by those of the windows: an anchor is the first GRAM words of the suffix that
begins there, so dealing by anchors deals these suffixes by a prefix, and an anchor of many blocks is split by longer
stretches. Dealing each window's suffix by its own prefix would move 50 words for each word.

Null texts and texts of under SIZE words lose nothing. Of equal rows with equal ids none is smaller, so neither loses to the
other. A null id is smaller than any other. Repetition within one document doesn't count. Other columns never matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from . import blocks as B
from .blocks import Plan, Range, merged, ranges_of
from .common import raw_texts, slices, table

SIZE, GRAM = 50, 12
#: Suffixes of a tree.
LIMIT = 4096


def codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of the words, by a hash of each different one."""
    split = pa.compute.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string()))
    flat = split.flatten()
    there = pa.compute.not_equal(flat, "")  # a leading or closing space gives an empty word
    coded = flat.dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w, 1) for w in coded.dictionary.to_pylist()], np.uint64)
    real = there.to_numpy(zero_copy_only=False)
    values = hashes[coded.indices.to_numpy()][real] if len(real) else np.zeros(0, np.uint64)
    n = pa.compute.list_value_length(split).to_numpy().astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(real)])[np.concatenate([[0], np.cumsum(n)])]
    return values, np.diff(ends)


def cutter(text: bytes) -> Callable[[int, int], bytes]:
    words = text.split()
    joined, at = b" ".join(words), list(accumulate([len(w) + 1 for w in words], initial=0))
    return lambda s, e: joined[at[s] : at[e] - 1]


def prefix_groups(words: np.ndarray, starts: np.ndarray, size: int = SIZE, limit: int = LIMIT) -> np.ndarray:
    """A group number for each suffix; suffixes of a group share a prefix that is as long as it takes to have `limit` of them, at most `size` words."""
    group = pd.factorize(words[starts])[0].astype(np.int64)
    many = int(words.max()) + 1 if len(words) else 1
    for depth in range(1, size):
        large = np.flatnonzero(np.bincount(group)[group] > limit)
        if not len(large):
            break
        longer = pd.factorize(group[large] * many + words[starts[large] + depth])[0]
        group[large] = longer + int(group.max()) + 1
        group = pd.factorize(group)[0].astype(np.int64)
    return group


def trees(group: np.ndarray, limit: int = LIMIT) -> Iterator[np.ndarray]:
    """Suffix numbers by tree: whole groups, together up to `limit` where they are smaller."""
    order = np.argsort(group, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1], [True]]))
    first = 0
    for i in range(1, len(edge)):
        if i + 1 == len(edge) or edge[i + 1] - edge[first] > limit:
            yield order[edge[first] : edge[i]]
            first = i


def tree(words: np.ndarray, starts: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes' order and the words that each has in common with the one before, up to `size`."""
    rows = words[starts[:, None] + np.arange(size)].astype(">u4")
    order = np.argsort(rows.view(f"S{4 * size}").ravel(), kind="stable")
    equal = rows[order[1:]] == rows[order[:-1]]
    common = np.where(equal.all(axis=1), size, equal.argmin(axis=1)) if len(order) > 1 else np.zeros(0, np.int64)
    return order, np.concatenate([[0], common])


def nodes(common: np.ndarray) -> list[tuple[int, int, int]]:
    """The internal nodes of a suffix tree as (depth, first suffix, one after the last) in the suffixes' order, children before parents, the root last."""
    out, open_ = [], [(0, 0)]  # (depth, first suffix) of the nodes on the way to the suffix at hand
    for i, depth in enumerate(common.tolist()):
        first = max(0, i - 1)
        while open_[-1][0] > depth:
            deeper, first = open_.pop()
            out.append((deeper, first, i))
        if open_[-1][0] < depth:
            open_.append((depth, first))
    return out + [(depth, first, len(common)) for depth, first in reversed(open_)]


def deep(found: list[tuple[int, int, int]], size: int = SIZE) -> list[tuple[int, int]]:
    """The suffixes below each maximal repeat, an internal node of `size` words or more: (first, one after the last)."""
    return [(s, e) for depth, s, e in found if depth >= size]


def kernel(blocks: list[bytes], anchor: np.ndarray, copies: np.ndarray, least: np.ndarray, most: np.ndarray, windows: np.ndarray, off: np.ndarray, folder: str | None = None, size: int = SIZE) -> list[list[Range]]:
    """Ranges of each block's windows by the smallest id that has them, where that is below the block's greatest."""
    split = [b.split() for b in blocks]
    words = pd.factorize(np.array([w for s in split for w in s], dtype=object))[0] + 1
    length = np.array([len(s) for s in split], np.int64)
    own = np.repeat(np.arange(len(blocks)), windows)
    number = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = (np.cumsum(length) - length)[own] + number
    low = least[own].copy()
    for some in trees(prefix_groups(words, starts, size)):
        order, common = tree(words, starts[some], size)
        for s, e in deep(nodes(common), size):
            below = some[order[s:e]]
            low[below] = low[below].min()
    cut = np.cumsum(windows)[:-1]
    return [ranges_of(v, v < m) for v, m in zip(np.split(low, cut), most.tolist(), strict=True)]


PLAN = Plan(SIZE, GRAM, codes, cutter, True, kernel)


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and spans array<struct<first,last>>, word runs to remove (null: none; unsorted, may overlap), of every row."""
    return B.spans(df, PLAN, id_col, text_col)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from `spans`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for t, own in zip(raw_texts(b), b.column("spans").to_pylist(), strict=True):
                words, kept, at, gone = t.split(), [], 0, 0
                for s, e in merged(own):
                    kept += words[at:s]
                    at, gone = e, gone + e - s
                kept += words[at:]
                rows.append((len(words), gone, hashlib.sha256(b" ".join(kept)).hexdigest()))
            n, gone_, sha = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone_, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


#: The same rows by DuckDB: a row for each window; for small tables.
ORACLE = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
x as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as k from d, unnest(range(1, greatest(len(w) - 48, 1))) as t(i)),
m as (select k, min(doc_id) as least from x group by 1),
g as (select distinct doc_id, unnest(range(i, i + 50)) as j from x join m using (k) where least < doc_id),
v as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as j from d),
r as (select v.doc_id, string_agg(word, ' ' order by v.j) as kept from v left join g on v.doc_id = g.doc_id and v.j = g.j where g.j is null group by 1),
n as (select doc_id, count(*) as n from g group by 1)
select doc_id, len(w) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join n using (doc_id) left join r using (doc_id)
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spans(table(spark, sf_dir, "documents")))
