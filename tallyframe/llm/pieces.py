"""SentencePiece encoding with sampled segmentations, and lossless decoding.

A text becomes a lattice over its bytes whose arcs are the model's pieces (a space stands for U+2581, one is put in
front); characters without a piece, U+2581 itself among them, go byte by byte. A piece weighs by its rank in the model,
1 / (1 + rank) to the power `alpha`. Forward filtering sums the weights of all paths to each place; backward sampling
then draws a path from the end. No piece crosses from a character to a following space or over a newline, so lattices factor
there into chunks whose tables are kept and reused; chunks over LONG bytes factor further at the places that no arc
crosses, and what is longer still is filtered and sampled by itself, section by section, its tables never whole in memory.
Logarithms are whole multiples of 1 / UNIT and sums integers, looked up in tables, so however chunks are worked on, their
thresholds are the same. Draws are 32-bit numbers hashed from seed, row key, chunk and step: a row's ids never depend on
other rows, batches or partitions.

Null gives null ids and decodes to null; empty gives no ids and decodes to empty. Rows with equal key and text give equal
ids, a null key being one like others.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bounded, keyed_text, slices, table

ALPHA, SEED = 1.0, 17
#: Text bytes that are encoded at once.
SLICE = 2 << 20
#: Chunks that are learned at once, and their bytes.
LEARN, LEARN_BYTES = 10_000, 128 << 10
#: Chunks whose tables a worker keeps, and their bytes; beyond that it goes on with the most used third, without effect on results.
CACHE_CHUNKS, CACHE_BYTES = 300_000, 3_000_000
#: Bytes of a chunk whose table is kept, and of a section of longer ones.
LONG, SECTION = 512, 1 << 15
#: Parts of one that logarithms have, and integers that stand for 1; the tables of e to the -i / UNIT and of e to the i / UNIT.
UNIT, ONE = 4096, 1 << 24
FALL = np.floor(np.exp(-np.arange(math.ceil(UNIT * math.log(ONE)) + 2) / UNIT) * ONE).astype(np.int64)
RISE = np.floor(np.exp(np.arange(UNIT * 5) / UNIT) * ONE).astype(np.int64)
#: The last place of RISE that isn't above each multiple of CELL.
CELL = ONE // UNIT
CELLS = np.searchsorted(RISE, np.arange(0, int(RISE[-1]), CELL), "right") - 1
G1, G2, G3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def risen(sums: np.ndarray) -> np.ndarray:
    """The last place of RISE that isn't above each number, of ONE or more."""
    out = CELLS[sums // CELL]
    out += RISE[out + 1] <= sums  # a cell has no more than two places
    out += RISE[out + 1] <= sums
    return out


def model_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer over unsigned numbers."""
    x = (x ^ (x >> np.uint64(30))) * G2
    x = (x ^ (x >> np.uint64(27))) * G3
    return x ^ (x >> np.uint64(31))


def chunk_starts(data: np.ndarray) -> np.ndarray:
    """Where chunks begin within a text: at and after newlines, and at the first of several spaces."""
    out = data == 10
    out[1:] |= data[:-1] == 10
    out[1:] |= (data[1:] == 32) & (data[:-1] != 32)
    return out


def row_seed(key: object, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{key}".encode(), digest_size=8).digest(), "little")


class Vocabulary:
    """The model's pieces as bytes, with a space for U+2581, and their costs: negative logarithms of weights, times UNIT."""

    def __init__(self, path: str | None = None, alpha: float = ALPHA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path(path))
        self.raw: list[bytes] = []
        self.byte: list[int] = [0] * 256
        self.piece: dict[bytes, tuple[int, float]] = {}
        for i in range(model.get_piece_size()):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(name[3:5], 16)
                self.byte[value] = i
                self.raw.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.raw.append(b"")
            else:
                raw = name.replace("▁", " ").encode()
                self.raw.append(raw)
                self.piece[raw] = (i, round(UNIT * alpha * math.log1p(abs(model.get_score(i)))))
        self.cheap = round(UNIT * alpha * math.log1p(len(self.raw)))
        self.longest = max(map(len, self.piece))
        assert not any(b" " in p.lstrip(b" ") or b"\n" in p for p in self.piece), "pieces cross chunks"
        self.cost = np.full(len(self.raw), self.cheap, np.int64)
        # the pieces' trie: node * 256 + byte -> node, as two sorted columns
        edges: dict[int, int] = {}
        ends = {0: -1}
        for raw, (i, w) in self.piece.items():
            self.cost[i] = w
            node = 0
            for x in raw:
                node = edges.setdefault(node * 256 + x, len(edges) + 1)
            ends[node] = i
        self.edge = np.array(sorted(edges), np.int64)
        self.node = np.array([edges[x] for x in sorted(edges)], np.int64)
        self.two = np.full(1 << 16, -1, np.int64)  # nodes of the first two bytes, as most walks end there
        for x, node in edges.items():
            if x < 256:
                for y in range(256):
                    self.two[x * 256 + y] = edges.get(node * 256 + y, -1)
        self.one = np.array([edges.get(x, -1) for x in range(256)], np.int64)
        self.end = np.full(len(edges) + 1, -1, np.int64)
        self.end[list(ends)] = list(ends.values())

    def arcs(self, data: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, id) of all arcs over `data`; `left` has the bytes from each place to its chunk's end."""
        lead = (data & 0xC0) != 0x80
        size = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
        at = np.flatnonzero(lead)
        node = np.zeros(len(at), np.int64)
        bare = lead.copy()
        start, length, ids = [], [], []
        n = 0
        while len(at):
            if n == 0:
                node = self.one[data[at]]
                found = node >= 0
                at, node = at[found], node[found]
            elif n == 1:
                node = self.two[data[at].astype(np.int64) * 256 + data[at + 1]]
                found = node >= 0
                at, node = at[found], node[found]
            else:
                key = node * 256 + data[at + n]
                place = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
                found = self.edge[place] == key
                at, node = at[found], self.node[place[found]]
            n += 1
            piece = self.end[node]
            whole = piece >= 0
            start.append(at[whole])
            length.append(np.full(len(start[-1]), n))
            ids.append(piece[whole])
            bare[start[-1][size[start[-1]] == n]] = False
            more = left[at] > n
            at, node = at[more], node[more]
        alone = np.flatnonzero(bare[np.maximum.accumulate(np.where(lead, np.arange(len(data)), 0))]) if len(data) else np.zeros(0, np.int64)
        byte = np.array(self.byte, np.int64)
        return np.concatenate([*start, alone]), np.concatenate([*length, np.ones(len(alone), np.int64)]), np.concatenate([*ids, byte[data[alone]]])


    def cuts(self, data: np.ndarray) -> np.ndarray:
        """The places within a chunk that no arc crosses: what comes before and after is independent."""
        out = []
        for a in range(0, len(data), SECTION):
            low, high = max(0, a - self.longest), min(len(data), a + SECTION + self.longest)
            start, length, _ = self.arcs(data[low:high], high - low - np.arange(high - low))
            inside = np.bincount(start + 1, minlength=high - low + 2) - np.bincount(start + length, minlength=high - low + 2)
            free = np.flatnonzero(np.cumsum(inside) == 0) + low
            out.append(free[(free > a) & (free <= a + SECTION) & (free < len(data))])
        return np.concatenate(out)

    def section(self, data: np.ndarray, a: int, b: int, costs: list[int]) -> tuple[int, list[int], list[int], list[int], list[int], list[int]]:
        """Forward filtering of places a + 1 to b of a chunk, given the costs of those from the first that an arc may start at up to a.

        (that first place, costs from it up to b, where the arcs to each place from a + 1 on begin, and their heads, costs and ids).
        """
        low, high = max(0, a - self.longest), min(len(data), b + self.longest)
        start, length, ids = self.arcs(data[low:high], high - low - np.arange(high - low))
        tail = start + length + low
        keep = np.flatnonzero((tail > a) & (tail <= b))
        keep = keep[np.lexsort((start[keep], tail[keep]))]
        first = np.searchsorted(tail[keep], np.arange(a + 1, b + 2)).tolist()
        heads, spent, ids = start[keep].tolist(), self.cost[ids[keep]].tolist(), ids[keep].tolist()
        out, fall, rise, most = list(costs), FALL.tolist(), RISE.tolist(), len(FALL) - 1
        for s, e in zip(first[:-1], first[1:], strict=True):
            if e - s == 1:
                out.append(out[heads[s]] + spent[s])
            elif e > s:
                c = [out[h] + x for h, x in zip(heads[s:e], spent[s:e], strict=True)]
                best = min(c)
                out.append(best - bisect_right(rise, sum([fall[min(x - best, most)] for x in c])) + 1)
            else:
                out.append(0)  # within a character: no arc ends or starts here
        return low, out, first, heads, spent, ids


class Sampler:
    """Tables of chunks: a state is a place of a chunk, whose arcs follow one another with cumulative 32-bit limits."""

    def __init__(self, vocabulary: Vocabulary, seed: int = SEED):
        self.vocabulary, self.seed = vocabulary, seed
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.uses = np.zeros(0, np.int32)
        self.last = np.zeros(0, np.int64)  # a chunk's final state
        self.states = 0
        self.first, self.limit, self.back, self.id = (np.zeros(0, t) for t in (np.int32, np.uint32, np.int32, np.int32))

    def learn(self, chunks: list[bytes]) -> None:
        """Forward filtering of new chunks, which advance together place by place.

        Weights become integers relative to the largest at a place, so sums and thresholds are exact and a chunk's
        table is the same whatever it is learned with.
        """
        size = np.array([len(c) for c in chunks], np.int64)
        data = np.frombuffer(b"".join(chunks), np.uint8)
        own = np.repeat(np.arange(len(chunks)), size)
        first = np.cumsum(size) - size
        start, length, ids = self.vocabulary.arcs(data, (first + size)[own] - np.arange(len(data)))
        head = start + own[start]  # states: one more than bytes for each chunk
        tail = head + length
        depth = tail - (first + np.arange(len(chunks)))[own[start]]
        order = np.lexsort((head, tail, depth))
        head, tail, ids, depth = head[order], tail[order], ids[order], depth[order]
        spent = self.vocabulary.cost[ids]
        total = np.zeros(len(data) + len(chunks), np.int64)
        threshold = np.empty(len(head), np.int64)
        cut = np.searchsorted(depth, np.arange(1, int(size.max()) + 2))
        most = len(FALL) - 1
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if a == b:
                continue
            t = tail[a:b]
            begin = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            count = np.diff(np.append(begin, b - a))
            c = total[head[a:b]] + spent[a:b]
            best = np.minimum.reduceat(c, begin)
            whole = FALL[np.minimum(c - np.repeat(best, count), most)]
            running = np.cumsum(whole)
            running -= np.repeat(running[begin] - whole[begin], count)
            sums = running[begin + count - 1]
            total[t[begin]] = best - risen(sums)
            threshold[a:b] = np.maximum((running << 32) // np.repeat(sums, count), 1)
        order = np.argsort(tail, kind="stable")
        origin = np.zeros(len(total), bool)
        origin[first + np.arange(len(chunks))] = True
        back = np.where(origin[head], -1, head + self.states)
        self.last = np.concatenate([self.last, first + size + np.arange(len(chunks)) + self.states])
        arcs = np.bincount(tail, minlength=len(total))
        self.first = np.concatenate([self.first, (np.cumsum(arcs) - arcs + len(self.limit)).astype(np.int32)])
        self.limit = np.concatenate([self.limit, (threshold[order] - 1).astype(np.uint32)])
        self.back = np.concatenate([self.back, back[order].astype(np.int32)])
        self.id = np.concatenate([self.id, ids[order].astype(np.int32)])
        base = len(self.known)
        self.known.update((c, base + i) for i, c in enumerate(chunks))
        self.uses = np.concatenate([self.uses, np.zeros(len(chunks), np.int32)])
        self.states += len(total)

    def learn_all(self, chunks: list[bytes], size: np.ndarray) -> None:
        """`learn` in parts of at most LEARN chunks and about LEARN_BYTES."""
        ends, i = np.cumsum(size), 0
        while i < len(chunks):
            j = min(i + LEARN, max(i + 1, int(np.searchsorted(ends, ends[i] - size[i] + LEARN_BYTES, "right"))))
            self.learn(chunks[i:j])
            i = j

    def shrink(self) -> None:
        """Go on with the most used chunks, a third of what is kept at most."""
        names = list(self.known)
        most = np.argsort(-self.uses, kind="stable")[: CACHE_CHUNKS // 3]
        most = most[self.uses[most] > 1]
        total = np.cumsum([len(names[i]) for i in most.tolist()])
        kept = [names[i] for i in np.sort(most[total <= CACHE_BYTES // 3]).tolist()]
        self.clear()
        self.learn_all(kept, np.array([len(c) for c in kept], np.int64))

    def alone(self, chunk: np.ndarray, seed: np.uint64) -> np.ndarray:
        """The ids of one long chunk: forward by sections, of which only the costs that the next needs are kept, and backward with each filtered anew."""
        n, reach = len(chunk), self.vocabulary.longest
        costs, kept = [0], []
        for a in range(0, n, SECTION):
            kept.append(costs)
            done = self.vocabulary.section(chunk, a, min(n, a + SECTION), costs)
            costs = done[1][max(0, len(done[1]) - reach - 1) :]
        fall, most = FALL.tolist(), len(FALL) - 1
        out, place, draws = [], n, []
        for k in range(len(kept) - 1, -1, -1):
            a = k * SECTION
            low, total, first, heads, spent, ids = done if a + SECTION >= n else self.vocabulary.section(chunk, a, min(n, a + SECTION), kept[k])
            while place > a:
                if len(out) == len(draws):
                    step = np.arange(len(out) + 1, len(out) + (1 << 14) + 1, dtype=np.uint64)
                    draws += (mixed(seed + step * G3) >> np.uint64(32)).tolist()
                s, e = first[place - a - 1], first[place - a]
                if e - s > 1:
                    c = [total[h] + x for h, x in zip(heads[s:e], spent[s:e], strict=True)]
                    best = min(c)
                    running = list(accumulate([fall[min(x - best, most)] for x in c]))
                    s += next(i for i, x in enumerate(running) if max((x << 32) // running[-1], 1) > draws[len(out)])
                out.append(ids[s])
                place = heads[s] + low
        return np.array(out[::-1], np.int32)

    def encode(self, texts: list[bytes], keys: list[object]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's begin, and the end)."""
        whole = b"".join([b" " + t if t else t for t in texts])
        data = np.frombuffer(whole, np.uint8)
        length = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        begin = np.cumsum(length) - length
        cut = chunk_starts(data)
        cut[begin[length > 0]] = True
        starts = np.flatnonzero(cut)
        long = np.flatnonzero(np.diff(np.append(starts, len(data))) > LONG)
        if len(long):
            more = [starts[i] + self.vocabulary.cuts(data[starts[i] : starts[i + 1] if i + 1 < len(starts) else len(data)]) for i in long.tolist()]
            starts = np.sort(np.concatenate([starts, *more]))
        size = np.diff(np.searchsorted(starts, np.append(begin, len(data))))
        number = np.arange(len(starts)) - np.repeat(np.cumsum(size) - size, size)
        seeds = np.repeat(np.array([row_seed(k, self.seed) for k in keys], np.uint64), size) + number.astype(np.uint64) * G1
        starts = np.append(starts, len(data))
        out, steps, i = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        while i + 1 < len(starts):
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + SLICE, "right")) - 1)
            found, n = self._some(whole[starts[i] : starts[j]], starts[i : j + 1] - starts[i], seeds[i:j])
            out.append(found)
            steps.append(n)
            i = j
        last = np.cumsum(np.concatenate(steps))
        return np.concatenate(out), np.concatenate([[0], last])[np.concatenate([[0], np.cumsum(size)])]

    def _some(self, whole: bytes, starts: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of consecutive chunks, how many each has)."""
        if len(self.known) > CACHE_CHUNKS or self.states - len(self.known) > CACHE_BYTES:
            self.shrink()
        coded = pa.Array.from_buffers(pa.binary(), len(seeds), [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(whole)]).dictionary_encode()
        which, chunks = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        size, find = pa.compute.binary_length(coded.dictionary).to_numpy(), self.known.get
        short = size <= LONG
        place = np.fromiter([find(c, -1) for c in chunks], np.int64, len(chunks))
        new = np.flatnonzero((place < 0) & short)
        place[new] = len(self.known) + np.arange(len(new))
        self.learn_all([chunks[i] for i in new.tolist()], size[new])
        self.uses[place[short]] += np.bincount(which, minlength=len(place)).astype(np.int32)[short]
        steps, drawn = np.zeros(len(seeds), np.int32), []
        alone = {i: self.alone(np.frombuffer(chunks[which[i]], np.uint8), seeds[i]) for i in np.flatnonzero(~short[which]).tolist()}
        for i, x in alone.items():
            steps[i] = len(x)
        who = np.flatnonzero(short[which]).astype(np.int32)
        state, left = self.last[place[which[who]]], seeds[who]
        step = 0
        while len(who):
            step += 1
            u = (mixed(left + np.uint64(step * int(G3) % (1 << 64))) >> np.uint64(32)).astype(np.uint32)
            arc = self.first[state]
            past = np.flatnonzero(self.limit[arc] < u)
            while len(past):
                arc[past] += 1
                past = past[self.limit[arc[past]] < u[past]]
            drawn.append((who, self.id[arc]))
            steps[who] = step
            state = self.back[arc]
            more = state >= 0
            who, state, left = who[more], state[more], left[more]
        last = np.cumsum(steps, dtype=np.int64)
        ids = np.empty(int(last[-1]) if len(last) else 0, np.int32)
        for s, (w, x) in enumerate(drawn):
            ids[last[w] - 1 - s] = x
        for i, x in alone.items():
            ids[last[i] - len(x) : last[i]] = x
        return ids, steps.astype(np.int64)


_samplers: dict[tuple, Sampler] = {}


def sampler(model: str | None, alpha: float, seed: int) -> Sampler:
    """One for each Python worker, whose tables serve all its tasks."""
    if (model, alpha, seed) not in _samplers:
        _samplers[model, alpha, seed] = Sampler(Vocabulary(model, alpha), seed)
    return _samplers[model, alpha, seed]


def decoded(raw: list[bytes], ids: list[int]) -> bytes:
    """The text of ids, without the space put in front."""
    return b"".join([raw[i] for i in ids])[1:]


def _same(df: DataFrame, extra: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), extra])


def encode(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", out_col: str = "ids", model: str | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """The input's columns and `out_col`, the sampled ids; a column of that name is replaced."""
    bounded(df.sparkSession)
    df = df.drop(out_col)
    key, text = df.columns.index(key_col), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sampler(model, alpha, seed)
        for b in slices(batches, text_col, SLICE):
            texts = b.column(text).cast(pa.binary()).to_pylist()
            ids, ends = own.encode([t or b"" for t in texts], b.column(key).to_pylist())
            null = pa.array([t is None for t in texts] + [False], pa.bool_())
            places = pa.compute.if_else(null, pa.scalar(None, pa.int32()), pa.array(ends, pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(places, pa.array(ids, pa.int32()))], [*b.schema.names, out_col])

    return df.mapInArrow(run, _same(df, f"`{out_col}` array<int>"))


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", model: str | None = None) -> DataFrame:
    """The input's columns and `out_col`, the text of the ids; a column of that name is replaced."""
    bounded(df.sparkSession)
    df = df.drop(out_col)
    at = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = Vocabulary(model).raw
        for b in batches:
            texts = [None if x is None else decoded(raw, x).decode("utf-8", "replace") for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, out_col])

    return df.mapInArrow(run, _same(df, f"`{out_col}` string"))


def encode_checked(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", model: str | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """doc_id, ids, n_pieces, ids_crc32 (of little-endian 32-bit ids), decoded_sha256 and lossless (ids decode to the text) of every row."""
    bounded(df.sparkSession)
    data = keyed_text(df, key_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sampler(model, alpha, seed)
        raw = own.vocabulary.raw
        for b in slices(batches, most=SLICE):
            texts = b.column("text").cast(pa.binary()).to_pylist()
            ids, ends = own.encode([t or b"" for t in texts], b.column("doc_id").to_pylist())
            rows = []
            for t, s, e in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                back = decoded(raw, ids[s:e].tolist())
                rows.append((e - s, zlib.crc32(ids[s:e]), hashlib.sha256(back).hexdigest(), back == t) if t is not None else (None, None, None, True))
            n, crc, sha, same = zip(*rows, strict=True)
            null = pa.array([t is None for t in texts] + [False], pa.bool_())
            places = pa.compute.if_else(null, pa.scalar(None, pa.int32()), pa.array(ends, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(places, pa.array(ids, pa.int32())), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_pieces", "ids_crc32", "decoded_sha256", "lossless"])

    kind = data.schema["doc_id"].dataType.simpleString()
    return data.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_checked(table(spark, sf_dir, "documents"))
