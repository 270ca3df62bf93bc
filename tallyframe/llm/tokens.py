"""Token files: concatenated ids with Elias-Fano coded document boundaries.

A file is a Parquet container of segments. A segment holds the ids of consecutive documents (2 bytes each where the vocabulary
allows, else 4) and two Elias-Fano sequences, of the places at which documents end and of their doc_ids above the first:
the low bits packed, the high bits in unary, and the number of ones before every BLOCK bits, by which select finds a
number with a binary search and a look into one block. Reading selects the boundaries. Spark's committer writes the
container to any store it knows, and a lost task leaves nothing behind.

Documents are in ascending doc_id order (null first), equal ids by text. Null and empty texts have the end id only.
An empty input gives an empty file. Ids are 64-bit numbers, or what casts to them. Other columns never matter.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, keyed_text, passing, shared_dir, shuffles_cleaned, slices, table

END_ID = 2
#: Text bytes that are encoded at once: the more, the fewer different words for each.
SLICE = 8 << 20
#: Ids in a segment; a longer document is a segment of its own.
SEGMENT_IDS = 1 << 20
#: Bits of the unary part for each number of the rank directory.
BLOCK = 512
#: Words that a worker keeps, their bytes, and bytes of one.
CACHE_WORDS, CACHE_BYTES, LONGEST = 700_000, 16 << 20, 256
#: Bytes of texts that go to the library at once where it takes them whole.
WHOLE = 1 << 20
#: Lower-case letters of ASCII and Latin-1, then ASCII punctuation.
PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
#: The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on.
PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
ALPHABET = [chr(b) if b in PRINTABLE else chr(256 + sum(x not in PRINTABLE for x in range(b))) for b in range(256)]
SEQUENCE = [("bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("ranks", pa.binary())]
_SQL = "struct<bits:int,low:binary,high:binary,ranks:binary>"
SCHEMA = f"part int, seq int, before long, n_docs int, n_ids long, width int, ids binary, ends {_SQL}, first_id long, doc_ids {_SQL}"
NAMES = ["part", "seq", "before", "n_docs", "n_ids", "width", "ids", "ends", "first_id", "doc_ids"]
TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.struct(SEQUENCE), pa.int64(), pa.struct(SEQUENCE)]
#: What a tokenizer says of itself for which words can be encoded apart, as `Encoder` does.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
#: Place of the j-th one in a byte.
SELECT = np.array([[([k for k in range(8) if b >> k & 1] + [8] * 8)[j] for j in range(8)] for b in range(256)], np.int64)


class EliasFano:
    """An ascending sequence of n numbers; `select` finds those at given places."""

    def __init__(self, n: int, bits: int, low: bytes, high: bytes, ranks: bytes):
        self.n, self.bits = n, bits
        self.low = np.frombuffer(low + bytes(9), np.uint8)
        self.high = np.frombuffer(high + bytes(-len(high) % (BLOCK // 8)), np.uint8)
        self.ranks = np.frombuffer(ranks, "<u4")

    @classmethod
    def encode(cls, values: np.ndarray) -> dict[str, int | bytes]:
        """The parts of the sequence as a file holds them."""
        n, v = len(values), values.astype(np.uint64)
        bits = max(0, (int(v[-1]) // n).bit_length() - 1) if n else 0
        low = ((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        ranks = np.searchsorted(ones, np.arange(0, len(high), BLOCK)).astype("<u4")
        return {"bits": bits, "low": np.packbits(low.ravel(), bitorder="little").tobytes(), "high": np.packbits(high, bitorder="little").tobytes(), "ranks": ranks.tobytes()}

    def _low(self, i: np.ndarray) -> np.ndarray:
        first = i * self.bits
        part = self.low[(first >> 3)[:, None] + np.arange(9)]
        shift = (first & 7).astype(np.uint64)
        word = np.ascontiguousarray(part[:, :8]).view("<u8")[:, 0] >> shift
        over = np.where(shift > 0, part[:, 8].astype(np.uint64) << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return (word | over) & np.uint64((1 << self.bits) - 1)

    def select(self, places: np.ndarray) -> np.ndarray:
        """The numbers at places, unsigned: the directory tells the block of each one, counting bits its byte, a table the bit."""
        i = np.asarray(places, np.int64)
        if len(i) and not (0 <= i.min() and i.max() < self.n):
            raise IndexError(f"places of {self.n} numbers")
        if len(i) > 1 << 14:
            return np.concatenate([self.select(i[k : k + (1 << 14)]) for k in range(0, len(i), 1 << 14)])
        if not len(i):
            return np.zeros(0, np.uint64)
        block = np.searchsorted(self.ranks, i, "right") - 1
        data = self.high.reshape(-1, BLOCK // 8)[block]
        ones = np.cumsum(np.bitwise_count(data), axis=1, dtype=np.int64)
        left = i - self.ranks[block]
        byte = (ones <= left[:, None]).sum(axis=1)
        row = np.arange(len(i))
        left -= np.where(byte > 0, ones[row, byte - 1], 0)
        place = block * BLOCK + 8 * byte + SELECT[data[row, byte], left]
        return ((place - i).astype(np.uint64) << np.uint64(self.bits)) | self._low(i)


class Encoder:
    """Ids of whole texts by the tokenizers library.

    A tokenizer that says of itself what NORMALIZER and SPLITTER say never joins across white space, so a text's ids are
    those of its words one after another; the library encodes each different word once, and a bounded table keeps what
    it said. It leaves a word of lower-case Latin letters as it is and cuts ASCII punctuation from its end, so such
    words go to the library's model directly. Any other tokenizer is given whole texts.
    """

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not path:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.tokenize = self.tokenizer.model.tokenize
        told = json.loads(self.tokenizer.to_str())
        splits = (told["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_words = (
            told["normalizer"] == NORMALIZER
            and [x["type"] for x in splits] == ["Split", "ByteLevel"]
            and splits[0] == SPLITTER
            and not splits[1]["add_prefix_space"]
            and not splits[1]["use_regex"]
            and told["model"]["type"] == "BPE"
            and not told["truncation"]
            and not told["padding"]
            and all(x["content"].startswith("<|") and not re.search(r"\s", x["content"]) for x in told["added_tokens"])
        )
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.tails: dict[str, list[int]] = {}
        self.n_bytes = 0
        self.ids, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _model(self, part: str) -> list[int]:
        named = part if part.isascii() else "".join([ALPHABET[b] for b in part.encode()])
        return [x.id for x in self.tokenize(named)]

    def learn(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        out: list = [None] * len(words)
        rest, tails, stems = [], self.tails, {}
        for i, w in enumerate(words):
            if m := PLAIN.fullmatch(w):
                stem, tail = m.groups()
                if (ids := stems.get(stem)) is None:
                    ids = stems[stem] = self._model(stem) if (k := self.known.get(stem)) is None else self.ids[self.begin[k] : self.begin[k + 1]].tolist()
                if tail:
                    if (more := tails.get(tail)) is None:
                        more = self._model(tail)
                        if len(tails) < CACHE_WORDS and len(tail) <= LONGEST:
                            tails[tail] = more
                    ids = ids + more
                out[i] = ids
            else:
                rest.append(i)
        for i, x in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = x.ids
        return out

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """`encode` by whole texts, some at a time."""
        values, out, held, total = pa.compute.fill_null(texts.cast(pa.string()), "").to_pylist(), [], [], 0
        for t in [*values, None]:
            if held and (t is None or total + len(t) > WHOLE):
                out += [np.array([*x.ids, END_ID], np.uint32) for x in self.tokenizer.encode_batch_fast(held, add_special_tokens=False)]
                held, total = [], 0
            if t is not None:
                held.append(t)
                total += len(t)
        return np.concatenate([np.zeros(0, np.uint32), *out]), np.cumsum([len(x) for x in out], dtype=np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, each closed by END_ID; where each ends)."""
        if not self.by_words:
            return self._whole(texts)
        if len(self.known) > CACHE_WORDS or self.n_bytes > CACHE_BYTES:
            self.clear()
        pc = pa.compute
        texts = pc.fill_null(texts.cast(pa.string()), "")
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))  # A-Z go to a-z in any case, but for special tokens
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words, known = coded.dictionary.to_pylist(), self.known
        place = np.array([known.get(w, -1) for w in words], np.int64)
        ids, begin = self.ids, self.begin
        if len(unknown := np.flatnonzero(place < 0)):
            new = [words[i] for i in unknown.tolist()]
            kept = len(new)
            if max(map(len, new)) > LONGEST:  # those to keep go first
                long = np.array([len(w) > LONGEST for w in new])
                order, kept = np.argsort(long, kind="stable"), int((~long).sum())
                new, unknown = [new[i] for i in order.tolist()], unknown[order]
            found = self.learn(new)
            sizes = np.cumsum(list(map(len, found)))
            place[unknown] = len(begin) - 1 + np.arange(len(new))
            begin = np.concatenate([begin, begin[-1] + sizes])
            ids = np.concatenate([ids, np.array(list(chain.from_iterable(found)), np.uint32)])
            self.known.update(zip(new[:kept], range(len(self.begin) - 1, len(self.begin) - 1 + kept), strict=True))
            self.n_bytes += sum(map(len, new[:kept])) + 4 * int(sizes[kept - 1]) * bool(kept)
            self.begin = begin[: len(self.begin) + kept]
            self.ids = ids[: int(self.begin[-1])]
        which = place[coded.indices.to_numpy()]
        first, size = begin[which], begin[which + 1] - begin[which]
        place = np.cumsum(size) - size
        out = ids[np.repeat(first - place, size) + np.arange(int(size.sum()))]
        n_words = pc.list_value_length(split).to_numpy()
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(n_words)]
        return np.insert(out, ends, END_ID), ends + np.arange(1, len(texts) + 1)


_encoders: dict[str | None, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    """One for each Python worker, whose table serves all its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> None:
    """Write a token file; `path` is for Spark, which need not be local."""
    bounded(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder, part, seq, before = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        ids, ends, owners = [np.zeros(0, np.uint32)], [], []
        n = 0

        def segment() -> pa.RecordBatch:
            known = np.array([x for x in owners if x is not None], np.int64).view(np.uint64)
            first = None if owners[0] is None else owners[0]
            row = [part, seq, before, len(ends), n, own_encoder.width, np.concatenate(ids).astype(f"<u{own_encoder.width}").tobytes(), EliasFano.encode(np.array(ends, np.int64)), first, EliasFano.encode(known - known[:1])]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, TYPES, strict=True)], NAMES)

        for b in slices(batches, most=SLICE):
            found, places = own_encoder.encode(b.column("text"))
            begin = np.concatenate([[0], places[:-1]])
            own = b.column("doc_id").to_pylist()
            # documents by runs: each run ends where a segment is full
            i = 0
            while i < len(own):
                j = max(i + 1, int(np.searchsorted(places, begin[i] + SEGMENT_IDS - n, "right")))
                if ends and (n + places[j - 1] - begin[i] > SEGMENT_IDS or (owners[0] is None) != (own[i] is None)):
                    yield segment()
                    seq, before, n, ids, ends, owners = seq + 1, before + n, 0, [], [], []
                    continue
                while j > i + 1 and (own[j - 1] is None) != (own[i] is None):
                    j -= 1
                ids.append(found[begin[i] : places[j - 1]])
                ends += (places[i:j] - begin[i] + n).tolist()
                owners += own[i:j]
                n += int(places[j - 1] - begin[i])
                i = j
        if ends:
            yield segment()

    data = keyed_text(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    dealt = data.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    with shuffles_cleaned(df.sparkSession):
        dealt.drop("tie").mapInArrow(run, SCHEMA).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids of every document of a token file."""
    return _documents(spark, path, ids=True)


def _documents(spark: SparkSession, path: str, ids: bool) -> DataFrame:
    file = spark.read.schema(SCHEMA).parquet(path)
    totals = {r.part: r.n for r in file.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # a row for each writing task
    before = dict(zip(sorted(totals), np.cumsum([0, *(totals[p] for p in sorted(totals))]).tolist(), strict=False))
    told = spark.sparkContext.broadcast(before)
    last = "ids array<int>" if ids else "ids_crc32 long"
    names = ["doc_id", "start", "n_tokens", last.split()[0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                every = np.arange(r["n_docs"])
                ends = EliasFano(r["n_docs"], **r["ends"]).select(every).astype(np.int64)
                begin = np.concatenate([[0], ends[:-1]])
                values = np.frombuffer(r["ids"], f"<u{r['width']}").astype("<u4")
                owners = [None] * r["n_docs"] if r["first_id"] is None else (EliasFano(r["n_docs"], **r["doc_ids"]).select(every) + np.array([r["first_id"]]).view(np.uint64)).view(np.int64)
                if ids:
                    value = pa.ListArray.from_arrays(pa.array(np.append(begin, ends[-1:]), pa.int32()), pa.array(values.astype(np.int32)))
                else:
                    value = pa.array([zlib.crc32(values[s:e]) for s, e in zip(begin.tolist(), ends.tolist(), strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(begin + told.value[r["part"]] + r["before"], pa.int64()), pa.array(ends - begin, pa.int64()), value], names)

    return file.mapInArrow(run, f"doc_id long, start long, n_tokens long, {last}")


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "tokens")
    passing(spark, path)
    write(table(spark, sf_dir, "documents"), path)
    return _documents(spark, path, ids=False)
