"""Language identification by a linear-chain conditional random field over words.

A word's label scores sum the weights of its affixes, inner n-grams and lexicon entries; learned
transitions join neighbours; forward-backward gives each word's marginals, also where languages alternate. A text's
language has the largest sum of marginals, and its score is that sum over the number of words.

The field is fitted on the driver to all words of at most SAMPLE_DOCS different labelled texts, dealt evenly over the languages
by a hash of the row, with sequences that join stretches of texts of different languages. Texts over SAMPLE_TEXT bytes
aren't sampled, but for a language's shortest where it has no other; so a bounded number of bytes comes to the driver,
however the corpus grows. Beyond SAMPLE_DOCS languages those with the most texts are learned.

Null texts and texts without a letter are `und` with score 0. Without any labelled text all are `und`. Rows are
judged alone: repeated rows give equal results, and null or repeated ids are ids like others. Of equal sums the
alphabetically first language wins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded, keyed_text, slices, table

#: Texts that training takes at most, and bytes of one.
SAMPLE_DOCS, SAMPLE_TEXT = 800, 32 << 10
BITS = 16
BUCKETS = 1 << BITS
GRAM = 5
MIX = np.uint64(0x9E3779B97F4A7C15)
SEQUENCE, STRETCH, ROUNDS, BATCH, RATE, DECAY = 24, 8, 2, 64, 0.2, 1e-6
SCALE = 8
#: Occurrences in the sample of a word of the lexicon.
MIN_COUNT = 3
CACHE_WORDS = 200_000
WORD = re.compile(r"[^\W\d_]+")
SCHEMA = "held_out boolean, lang_pred string, score double, n_words long, n_other long"


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    found = WORD.findall(text.lower()) if text else []
    return found if "".join(found).isalpha() else [w for w in found if any(c.isalpha() for c in w)]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the UTF-8 of `^word$` for n up to GRAM, those at an edge being its affixes: (buckets, places at which each word's begin, and the end)."""
    coded = [b"^%b$" % w.encode() for w in words]
    size = np.array([len(x) for x in coded], np.int64)
    data = np.frombuffer(b"".join(coded) + bytes(GRAM), np.uint8).astype(np.uint64)
    n = len(data) - GRAM
    left = np.repeat(np.cumsum(size), size) - np.arange(n)  # bytes from here to the word's end
    out = np.full((n, GRAM), -1, np.int64)
    key = np.zeros(n, np.uint64)
    for k in range(GRAM):
        key = (key + data[k : n + k] + np.uint64(1)) * MIX
        key ^= key >> np.uint64(29)
        out[:, k] = np.where(left > k, (key >> np.uint64(64 - BITS)).astype(np.int64), -1)
    flat = out.ravel()
    valid = flat >= 0
    ends = np.concatenate([[0], np.cumsum(valid)])[np.concatenate([[0], np.cumsum(size)]) * GRAM]
    return flat[valid], ends


class Field:
    """Weights: buckets x labels, words of the lexicon x labels, transitions."""

    def __init__(self, labels: list[str], lexicon: list[str]):
        self.labels, self.lexicon = labels, {w: i for i, w in enumerate(lexicon)}
        n = len(labels)
        self.weights = np.zeros((BUCKETS + len(lexicon), n))
        self.move = np.zeros((n, n))

    def active(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the weights that words use, and where each word's begin."""
        grams, ends = features(words)
        entry = np.array([self.lexicon.get(w, -1) for w in words], np.int64)
        known = np.flatnonzero(entry >= 0)
        return np.insert(grams, ends[known + 1], BUCKETS + entry[known]), ends + np.concatenate([[0], np.cumsum(entry >= 0)])

    def scores(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.labels)))
        flat, ends = self.active(words)
        return np.add.reduceat(self.weights[flat], ends[:-1], axis=0)


def forward_backward(emit: np.ndarray, lengths: np.ndarray, move: np.ndarray, expect: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of every position of sequences that lie one after another in `emit`, and, if asked for, expected transitions.

    All sequences advance together, the longest first, so rows are put in order of time and a step works on one stretch of
    them; alpha and beta are scaled every SCALE steps, as only proportions count.
    """
    n, most = len(move), int(lengths.max(initial=0))
    begin = np.cumsum(lengths) - lengths
    rank = np.empty(len(lengths), np.int64)
    rank[np.argsort(-lengths, kind="stable")] = np.arange(len(lengths))
    live = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(most), "right")  # sequences longer than t
    first = np.cumsum(live) - live
    time = np.arange(len(emit)) - np.repeat(begin, lengths)
    place = first[time] + np.repeat(rank, lengths)
    e = np.empty_like(emit)
    e[place] = np.exp(emit - emit.max(axis=1, keepdims=True))
    a = np.exp(move - move.max())
    back = np.ascontiguousarray(a.T)
    alpha, pairs = np.empty_like(e), np.zeros((n, n))
    steps = list(zip(first.tolist(), live.tolist(), strict=True))
    for t, (s, k) in enumerate(steps):
        now = alpha[s : s + k]
        if t:
            np.matmul(alpha[steps[t - 1][0] : steps[t - 1][0] + k], a, out=now)
            now *= e[s : s + k]
        else:
            now[:] = e[:k]
        if t % SCALE == 0:
            now /= now.sum(axis=1, keepdims=True)
    beta = np.ones((len(lengths), n))
    for t in range(most - 1, -1, -1):
        s, k = steps[t]
        now = beta[:k]
        ahead = now * e[s : s + k]
        if expect and t:
            last = alpha[steps[t - 1][0] : steps[t - 1][0] + k]
            pairs += (last.T @ (ahead / ((last @ a) * ahead).sum(axis=1, keepdims=True))) * a
        alpha[s : s + k] *= now
        np.matmul(ahead, back, out=now)
        if t % SCALE == 0:
            now /= now.sum(axis=1, keepdims=True)
    alpha /= alpha.sum(axis=1, keepdims=True)
    return alpha[place], pairs


def fit(texts: list[tuple[str, str]], seed: int = 7) -> Field:
    """A field from (text, label) pairs, by AdaGrad on the log-likelihood."""
    labels = sorted({x for _, x in texts})
    rng = np.random.default_rng(seed)
    stretches: list[tuple[list[str], int]] = []
    counts: Counter = Counter()
    for text, label in sorted(texts):
        w, y = words_of(text), labels.index(label)
        stretches += [(w[i : i + STRETCH], y) for i in range(0, len(w), STRETCH)]
        counts.update(w)
    field = Field(labels, sorted(w for w, c in counts.items() if c >= MIN_COUNT))
    known = sorted(counts)
    number = {w: i for i, w in enumerate(known)}
    flat, first = field.active(known)
    width = np.diff(first)
    squares, moved = np.full_like(field.weights, 1e-8), np.full_like(field.move, 1e-8)
    coded = [(np.array([number[x] for x in p]), y) for p, y in stretches]
    language = np.array([y for _, y in coded], np.int64)
    for _ in range(ROUNDS):
        # every stretch once: half in sequences of one language, half in such that switch
        order = rng.permutation(len(coded))
        split = rng.random(len(coded)) < 0.5
        mixed, plain = order[split[order]], order[~split[order]]
        plain = plain[np.argsort(language[plain], kind="stable")]
        step = SEQUENCE // STRETCH
        sequences = [part[i : i + step].tolist() for part in (mixed, plain) for i in range(0, len(part), step)]
        rng.shuffle(sequences)
        for s in range(0, len(sequences), BATCH):
            chosen = sequences[s : s + BATCH]
            ids = np.concatenate([coded[i][0] for p in chosen for i in p])
            gold = np.concatenate([np.full(len(coded[i][0]), coded[i][1]) for p in chosen for i in p])
            lengths = np.array([sum(len(coded[i][0]) for i in p) for p in chosen])
            # the batch's features, word by word
            n = width[ids]
            place = np.repeat(first[ids] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            active, word = flat[place], np.repeat(np.arange(len(ids)), n)
            emit = np.add.reduceat(field.weights[active], np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0)
            p, pairs = forward_backward(emit, lengths, field.move, True)
            wrong = -p
            wrong[np.arange(len(ids)), gold] += 1
            rows, at = np.unique(active, return_inverse=True)
            grad = np.stack([np.bincount(at, wrong[word, y], len(rows)) for y in range(len(labels))], axis=1) / len(chosen) - DECAY * field.weights[rows]
            squares[rows] += grad**2
            field.weights[rows] += RATE * grad / np.sqrt(squares[rows])
            inner = np.ones(len(ids), bool)
            inner[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = False
            at = np.flatnonzero(inner)
            seen = np.zeros_like(pairs)
            np.add.at(seen, (gold[at - 1], gold[at]), 1)
            step = (seen - pairs) / len(chosen)
            moved += step**2
            field.move += RATE * step / np.sqrt(moved)
    return field


class Labeller:
    """Word marginals of texts; scores of words are kept for as many as CACHE_WORDS."""

    def __init__(self, field: Field):
        self.field, self.known, self.table = field, {}, np.zeros((0, len(field.labels)))

    def marginals(self, texts: list[list[str]]) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.known, self.table = {}, self.table[:0]
        flat = [w for t in texts for w in t]
        new = sorted(set(flat).difference(self.known))
        base = len(self.known)
        self.known.update((w, base + i) for i, w in enumerate(new))
        if new:
            self.table = np.concatenate([self.table, self.field.scores(new)])
        ids = np.array(list(map(self.known.__getitem__, flat)), np.int64)
        lengths = np.array([len(t) for t in texts if t])
        return forward_backward(self.table[ids], lengths, self.field.move)[0] if len(ids) else np.zeros((0, len(self.field.labels)))

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, int, int]]:
        """(language, score, words, words of another language) of each text."""
        words = [words_of(t) for t in texts]
        if not self.field.labels:
            return [("und", 0.0, len(w), 0) for w in words]
        p, out, at = self.marginals(words), [], 0
        for w in words:
            if not w:
                out.append(("und", 0.0, 0, 0))
                continue
            own = p[at : at + len(w)]
            at += len(w)
            mean = own.mean(axis=0)
            best = int(mean.argmax())
            out.append((self.field.labels[best], float(min(1.0, mean[best])), len(w), int((own.argmax(axis=1) != best).sum())))
        return out


def is_held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def sampled(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = SAMPLE_DOCS, longest: int = SAMPLE_TEXT) -> DataFrame:
    """text and lang of at most `most` labelled texts that aren't held out, about equally many of each language."""
    own = df.filter(~is_held_out(id_col)).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    size = F.octet_length("text")
    told = own.groupBy("lang").agg(F.count("*").alias("all"), F.count_if(size <= longest).alias("n"), F.min(size).alias("least"))
    languages = told.orderBy(F.desc("all"), "lang").limit(most).collect()
    if not languages:
        return own.select("text", "lang")
    each = most // len(languages)
    place = F.pmod(F.xxhash64("id", "text", "lang"), F.lit(1 << 40)) / float(1 << 40)
    # twice the wanted share, from which the first ones by the hash are taken
    share = F.create_map(*(F.lit(x) for r in languages for x in (r.lang, min(1.0, 2 * each / r.n) if r.n else 1.0)))
    limit = F.create_map(*(F.lit(x) for r in languages for x in (r.lang, longest if r.n else r.least)))
    near = own.filter((size <= limit[F.col("lang")]) & (place < share[F.col("lang")]))
    different = near.groupBy("lang", "text").agg(F.min(place).alias("place"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("place", "text"))
    return different.withColumn("rank", rank).filter(F.col("rank") <= F.when(limit[F.col("lang")] > longest, 1).otherwise(each)).select("text", "lang")


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Field:
    """A field fitted to `sampled` texts."""
    rows = sampled(df, id_col, text_col, lang_col).collect()
    return fit([(r.text, r.lang) for r in rows]) if rows else Field([], [])


def identify(df: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_words, n_other of every row."""
    bounded(df.sparkSession)
    told = df.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(told.value)
        for b in slices(batches):
            lang, score, n, other = zip(*labeller.judge(b.column("text").to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(n, pa.int64()), pa.array(other, pa.int64())], ["doc_id", "held_out", "lang_pred", "score", "n_words", "n_other"])

    data = keyed_text(df, id_col, text_col).withColumn("held_out", is_held_out("doc_id"))
    return data.mapInArrow(run, f"doc_id {data.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def keep(df: DataFrame, field: Field, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, all columns as they were, whose language is found with a score of `least` or more."""
    bounded(df.sparkSession)
    told = df.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(told.value)
        for b in slices(batches, text_col):
            yield b.filter(pa.array([x[0] != "und" and x[1] >= least for x in labeller.judge(b.column(text_col).to_pylist())], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
