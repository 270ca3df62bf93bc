import itertools
import math
import random
from collections import Counter

import numpy as np
import sentencepiece

from tallyframe.llm import pieces

from .conftest import odd_texts


def paths(vocabulary, chunk):
    """All segmentations of a chunk with their weights, by recursion over the pieces."""
    bare = [not any(chunk[i : i + n] in vocabulary.piece for n in range(1, 5)) for i in range(len(chunk))]
    if not chunk:
        return [((), 1.0)]
    out = []
    for n in range(1, len(chunk) + 1):
        if (p := vocabulary.piece.get(chunk[:n])) is not None:
            out += [((p[0], *rest), w * math.exp(-p[1] / pieces.UNIT)) for rest, w in paths(vocabulary, chunk[n:])]
    if bare[0] and not out:
        out += [((vocabulary.byte[chunk[0]], *rest), w * math.exp(-vocabulary.cheap / pieces.UNIT)) for rest, w in paths(vocabulary, chunk[1:])]
    return out


def test_samples_follow_the_weights_of_whole_paths():
    v = pieces.Vocabulary()
    s = pieces.Sampler(v)
    text = b"Thetion"
    want = paths(v, b" " + text)
    total = sum(w for _, w in want)
    n = 20000
    ids, ends = s.encode([text] * n, list(range(n)))
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in itertools.pairwise(ends.tolist()))
    assert set(seen) <= {p for p, _ in want} and len(seen) > 3
    for p, w in want:
        q = w / total
        assert abs(seen[p] / n - q) < 5 * math.sqrt(q * (1 - q) / n) + 1e-4


def test_rows_are_reproducible_whatever_they_are_encoded_with(monkeypatch):
    v = pieces.Vocabulary()
    texts = [(t or "").encode() for t in odd_texts()]
    keys = list(range(len(texts)))
    one, ends = pieces.Sampler(v).encode(texts, keys)
    monkeypatch.setattr(pieces, "CACHE_CHUNKS", 5)
    monkeypatch.setattr(pieces, "LEARN", 3)
    other = pieces.Sampler(v)
    for k in reversed(keys):
        ids, _ = other.encode([texts[k]], [k])
        assert np.array_equal(ids, one[ends[k] : ends[k + 1]])
    again, _ = pieces.Sampler(v, seed=99).encode(texts, keys)
    assert not np.array_equal(again, one)


def test_encode_and_decode_are_lossless(make, nothing):
    rng = random.Random(4)
    texts = odd_texts() + ["".join(rng.choices("ab \n▁é中\U0001f600<s></s>0x41", k=rng.randint(0, 40))) for _ in range(60)]
    df = make(texts).drop("ids")
    back = {r.doc_id: r for r in pieces.decode(pieces.encode(df)).collect()}
    assert [back[i].decoded for i in range(len(texts))] == texts
    assert back[18].ids is None and back[20].ids == []
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path(None))
    assert model.decode(back[0].ids) == texts[0]
    assert pieces.decode(pieces.encode(nothing.drop("ids"))).count() == 0
    checked = {r.doc_id: r for r in pieces.encode_checked(df).collect()}
    assert all(r.lossless for r in checked.values())
    assert all(checked[i].ids == back[i].ids for i in range(len(texts)))


def test_long_chunks_give_the_ids_of_tables(monkeypatch):
    v, rng = pieces.Vocabulary(), random.Random(3)
    texts = ["".join(rng.choices(letters, k=n)).encode() for letters in ("abcdetionings", "aA0+/", "\u4e2d\u6587\u00e9a\U0001f600", "z") for n in (30, 200, 450)]
    keys = list(range(len(texts)))
    monkeypatch.setattr(pieces, "LONG", 1 << 20)
    one, ends = pieces.Sampler(v).encode(texts, keys)
    cuts = [v.cuts(np.frombuffer(b" " + t, np.uint8)) for t in texts]
    monkeypatch.setattr(pieces, "LONG", 4)
    monkeypatch.setattr(pieces, "SECTION", 64)
    assert all(np.array_equal(v.cuts(np.frombuffer(b" " + t, np.uint8)), c) for t, c in zip(texts, cuts))
    monkeypatch.setattr(v, "cuts", lambda data: np.zeros(0, np.int64))
    other, places = pieces.Sampler(v).encode(texts, keys)
    assert np.array_equal(one, other) and np.array_equal(ends, places)


def test_no_arc_crosses_a_cut():
    v, rng = pieces.Vocabulary(), random.Random(9)
    for _ in range(40):
        data = np.frombuffer("".join(rng.choices("ab\u4e2d\u6587\u00e9\U0001f600xyz09", k=300)).encode(), np.uint8)
        start, length, _ = v.arcs(data, len(data) - np.arange(len(data)))
        crossed = {p for s, n in zip(start.tolist(), length.tolist()) for p in range(s + 1, s + n)}
        assert v.cuts(data).tolist() == [p for p in range(1, len(data)) if p not in crossed]


def test_five_megabytes_without_a_break():
    own, rng = pieces.Sampler(pieces.Vocabulary()), random.Random(1)
    for text in (b"a" * 300_000, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=5_000_000)).encode(), ("\u4e2d\u6587\u65e5" * 30_000).encode()):
        ids, ends = own.encode([text], [None])
        assert pieces.decoded(own.vocabulary.raw, ids.tolist()) == text
        assert own.states < 2 * pieces.CACHE_BYTES


def test_rows_without_an_own_key(make):
    rows = {(r.doc_id, r.text): tuple(r.ids) for r in pieces.encode(make(["The nation", "The nation", "x"], [None, None, None])).collect()}
    assert len(rows) == 2
