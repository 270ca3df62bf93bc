import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import blocks, substring, suffixarray, winnow

from .conftest import odd_texts, prose


def sha(b):
    return hashlib.sha256(b).hexdigest()


def bytes_removed(texts, size=200):
    own, first, hit = [(t or "").encode() for t in texts], {}, {}
    for i, b in enumerate(own):
        for p in range(len(b) - size + 1):
            w = b[p : p + size]
            if w in first:
                hit.setdefault(i, set()).add(p)
                hit.setdefault(first[w][0], set()).add(first[w][1])
            else:
                first[w] = (i, p)
    out = []
    for i, b in enumerate(own):
        gone = np.zeros(len(b) + 1, int)
        for p in hit.get(i, ()):
            gone[p] += 1
            gone[p + size] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        n_spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), n_spans, sha(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    return out


def words_removed(texts, ids, size=50):
    own, least = [(t or "").encode().split() for t in texts], {}
    rank = [blocks.NO_ID if i is None else i for i in ids]
    for i, w in zip(rank, own, strict=True):
        for p in range(len(w) - size + 1):
            k = tuple(w[p : p + size])
            least[k] = min(least.get(k, i), i)
    out = []
    for i, w in zip(rank, own, strict=True):
        gone = set()
        for p in range(len(w) - size + 1):
            if least[tuple(w[p : p + size])] < i:
                gone.update(range(p, p + size))
        out.append((len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def corpus():
    rng = random.Random(21)
    texts = odd_texts()
    passage = prose(rng, 75)
    for k in range(30):  # one passage in many contexts, cut at different ends
        w = passage.split(" ")
        texts.append(prose(rng, rng.randint(5, 40)) + " " + " ".join(w[: len(w) - k % 4]) + " " + prose(rng, rng.randint(5, 40)))
    long = prose(rng, 200)
    for _ in range(20):  # near copies
        w = long.split(" ")
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize(("hot", "parts"), [(256, 6), (2, 6), (3, 2)])
def test_both_operators_equal_brute_force(make, monkeypatch, hot, parts):
    monkeypatch.setattr(blocks, "HOT", hot)
    monkeypatch.setattr(blocks, "PARTS", parts)
    texts = corpus()
    df = make(texts)
    got = {r.doc_id: tuple(r)[1:] for r in suffixarray.digest(suffixarray.spans(df)).collect()}
    assert [got[i] for i in range(len(texts))] == bytes_removed(texts)
    got = {r.doc_id: tuple(r)[1:] for r in substring.digest(substring.spans(df)).collect()}
    assert [got[i] for i in range(len(texts))] == words_removed(texts, range(len(texts)))


def test_null_and_repeated_ids(make, nothing):
    texts = corpus()[:24]
    texts = texts + texts[:3]
    ids = [None if i % 5 == 0 else i // 2 for i in range(24)] + [None, 0, 1]
    df = make(texts, ids)
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    got = sorted((tuple(r) for r in suffixarray.digest(suffixarray.spans(df)).collect()), key=key)
    assert got == sorted(((i, *x) for i, x in zip(ids, bytes_removed(texts), strict=True)), key=key)
    got = sorted((tuple(r) for r in substring.digest(substring.spans(df)).collect()), key=key)
    assert got == sorted(((i, *x) for i, x in zip(ids, words_removed(texts, ids), strict=True)), key=key)
    assert suffixarray.digest(suffixarray.spans(nothing)).count() == 0 and substring.digest(substring.spans(nothing)).count() == 0


def test_many_equal_rows(make):
    texts = corpus()[:6]
    texts, ids = texts + [texts[0]] * 60, [*range(6)] + [0] * 60
    df = make(texts, ids)
    got = sorted(tuple(r) for r in suffixarray.digest(suffixarray.spans(df)).collect())
    assert got == sorted((i, *x) for i, x in zip(ids, bytes_removed(texts), strict=True))
    got = sorted(tuple(r) for r in substring.digest(substring.spans(df)).collect())
    assert got == sorted((i, *x) for i, x in zip(ids, words_removed(texts, ids), strict=True))


def test_sections_of_a_long_text_miss_nothing(make, monkeypatch):
    monkeypatch.setattr(winnow, "SECTION", 900)
    units = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    t, s, n, off, *_ = winnow.runs(units, np.array([300, 4600, 100]), 200, 32)
    places = sorted((a, x) for a, b, c in zip(t.tolist(), s.tolist(), n.tolist(), strict=True) for x in range(b, b + c))
    assert places == [(0, x) for x in range(101)] + [(1, x) for x in range(4401)]
    assert ((off >= n - 1) & (off <= 168)).all()


def test_equal_windows_pick_equal_anchors():
    rng = np.random.default_rng(5)
    part, pads = rng.integers(0, 4, 260).astype(np.uint64), [rng.integers(0, 4, k).astype(np.uint64) for k in (0, 13, 400, 57)]
    found = set()
    for a, b in zip(pads, reversed(pads), strict=True):
        text = np.concatenate([a, part, b]) * np.uint64(0xD6E8FEB86659FD93)
        t, s, n, off, h, *_ = winnow.runs(text, np.array([len(text)]), 200, 32)
        found.add(tuple((int(h[k]), int(off[k] - (p - s[k]))) for p in range(len(a), len(a) + 61) for k in [int(np.searchsorted(s, p, "right")) - 1]))
    assert len(found) == 1


def test_prefix_groups_hold_whole_trees():
    rng = np.random.default_rng(3)
    words = rng.integers(1, 3, 3000)
    starts = np.arange(2950)
    group = substring.prefix_groups(words, starts, 50, 40)
    trees = list(substring.trees(group, 40))
    assert sorted(np.concatenate(trees).tolist()) == starts.tolist()
    owner = {int(s): k for k, t in enumerate(trees) for s in t}
    seen = {}
    for s in starts.tolist():  # equal windows are in one tree
        assert owner[s] == seen.setdefault(words[s : s + 50].tobytes(), owner[s])


def equal_short_hashes(spark):
    """Two unlike texts with one 32-bit hash as Spark computes it."""
    rng = random.Random(4)
    base = [prose(rng, 80), prose(rng, 80)]
    rows = spark.range(300_000).select("id", *(F.hash(F.concat(F.lit(t + " "), F.col("id").cast("string"))).alias(f"h{k}") for k, t in enumerate(base)))
    a, b = rows.select("h0", F.col("id").alias("a")), rows.select(F.col("h1").alias("h0"), F.col("id").alias("b"))
    r = a.join(b, "h0").first()
    return f"{base[0]} {r.a}", f"{base[1]} {r.b}"


def test_unlike_texts_of_one_id_and_one_short_hash_are_kept_apart(make, spark):
    one, other = equal_short_hashes(spark)
    for ids in ([None, None, 5], [7, 7, 9]):
        df = make([one, other, one], ids)
        got = sorted((r.n_bytes, r.n_removed) for r in suffixarray.digest(suffixarray.spans(df)).collect())
        assert got == sorted([(len(one), len(one)), (len(one), len(one)), (len(other), 0)])
        got = {(r.doc_id, r.n_removed) for r in substring.digest(substring.spans(df)).collect()}
        assert got == {(ids[0], 0), (ids[2], len(one.split()))}


def test_ids_of_any_ordered_type(spark):
    rng = random.Random(8)
    p, q = prose(rng, 70), prose(rng, 70)
    rows = [("b", p), ("a", p + " " + q), ("c", q), (None, "alone " + prose(rng, 60)), ("", "short")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: r.n_removed for r in substring.digest(substring.spans(df)).collect()}
    assert got == {"a": 0, "b": 70, "c": 70, None: 0, "": 0}
    got = {r.doc_id: r.n_removed for r in suffixarray.digest(suffixarray.spans(df)).collect()}
    assert got["b"] == len(p) and got["c"] == len(q) and got[""] == 0


def test_external_files_hold_the_transform_of_each_column(tmp_path):
    rng = random.Random(5)
    docs = [bytes(rng.choice(b"ab") for _ in range(rng.randint(9, 90))) for _ in range(40)]
    off = np.array([rng.randint(0, len(d) - 1) for d in docs])
    files = suffixarray.External(f"file://{tmp_path}")
    names = suffixarray.construct(files, docs, np.zeros(len(docs), np.int64), off, 1000)
    assert len(names) > 1
    later = None
    for name in names:
        with files.read(name) as runs:
            while run := suffixarray.get(runs):
                x, symbols, order, common = run
                own = [d for d in range(len(docs)) if 0 <= x + off[d] < len(docs[d])]
                tails = [docs[d][x + off[d] :] for d in order.tolist()]
                assert sorted(order.tolist()) == own and tails == sorted(tails)
                assert common.tolist() == [0] * bool(tails) + [next((k for k, (a, b) in enumerate(zip(s, t)) if a != b), min(len(s), len(t))) for s, t in zip(tails, tails[1:])]
                assert sorted(symbols.tolist()) == sorted(docs[d][x + off[d]] for d in own)
                if later is not None:  # the symbols before the suffixes one column to the right in their order, those of ending documents first
                    right = [d for d in later if x + off[d] >= 0]
                    assert symbols.tolist()[len(own) - len(right) :] == [docs[d][x + off[d]] for d in right]
                later = order.tolist()
    files.clear()
    assert not list(tmp_path.iterdir())


def test_without_a_store_that_python_reads_files_are_in_memory():
    files = suffixarray.External("viewfs://cluster/shared")
    out = files.write("x")
    out.write(b"abc")
    files.done("x", out)
    assert files.read("x").read() == b"abc"


def test_nodes_of_a_suffix_tree():
    text = "b a n a n a".split()
    tails = sorted(text[i:] for i in range(6))
    common = [0] + [next((k for k, (a, b) in enumerate(zip(s, t)) if a != b), min(len(s), len(t))) for s, t in zip(tails, tails[1:])]
    assert substring.nodes(np.array(common)) == [(3, 1, 3), (1, 0, 3), (2, 4, 6), (0, 0, 6)]
    assert substring.deep(substring.nodes(np.array(common)), 2) == [(1, 3), (4, 6)]
