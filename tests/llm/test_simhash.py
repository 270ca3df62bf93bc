import random

import numpy as np
import pytest
import xxhash

from tallyframe.llm import components, simhash

from .conftest import odd_texts


def plain_fp(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(values):
    """Smallest number that each place reaches over pairs at 3 bits or fewer."""
    label = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 3 and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def test_planes_meet_every_five_positions():
    from itertools import combinations

    assert len(simhash.PLANES) == 14
    assert all(any(set(p) <= set(five) for p in simhash.PLANES) for five in combinations(range(8), 5))


def test_classes_equal_brute_force(make):
    texts = odd_texts()
    texts += [texts[0].upper(), texts[3].replace("paper", "Paper"), texts[11] + " x"]
    fp = [plain_fp(t) for t in texts]
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.classes(make(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == list(zip(fp, classes(fp), strict=True))


def clusters(rng, n, spread):
    out = set()
    centres = [rng.getrandbits(64) for _ in range(4)]
    while len(out) < n:
        x = rng.choice(centres)
        for _ in range(rng.randint(0, spread)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def dense(rng, n):
    """Numbers that differ in 12 bits of two bytes only: every list of the other bytes has all of them."""
    base = rng.getrandbits(64) & ~0xFFF0
    return sorted(base | x << 4 for x in rng.sample(range(1 << 12), n))


@pytest.mark.parametrize(("n", "spread", "block", "short"), [(300, 4, 512, 32), (300, 4, 512, 4), (300, 4, 40, 32), (260, 6, 8, 4), (200, 9, 16, 8), (300, 0, 16, 4), (60, 0, 4, 2)])
def test_links_connect_the_same_classes_however_lists_are_split(spark, monkeypatch, n, spread, block, short):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SHORT", short)
    values = dense(random.Random(n), n) if not spread else clusters(random.Random(n + block), n, spread)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    place = {x: i for i, x in enumerate(signed)}
    label = list(range(n))
    for a, b in ((place[r.a], place[r.b]) for r in links):
        low, high = sorted((label[a], label[b]))
        label = [low if x == high else x for x in label]
    assert label == classes(values)


def test_components_of_chains_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(200, 200), (301, 300), (300, 301), (-5, 40)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {-5} and {got[i] for i in range(100, 160)} == {100} and got[301] == 300 and 200 not in got
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_class_stays(make, nothing):
    texts = odd_texts()
    df = make(texts)
    label = classes([plain_fp(t) for t in texts])
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(label))
    again = simhash.one_of_each(df.unionByName(df))
    assert sorted(r.doc_id for r in again.collect()) == sorted(set(label))
    assert simhash.one_of_each(nothing).count() == 0 and simhash.classes(nothing).count() == 0


def test_finer_lists_keep_every_near_pair_together():
    rng = random.Random(2)
    for mask in (simhash.MASKS[0], simhash.finer(simhash.MASKS[3])[1], (1 << 60) - 1):
        for _ in range(200):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample([b for b in range(64) if not mask >> b & 1], rng.randint(0, 3)):
                y ^= 1 << b
            assert any(x & m == y & m for m in simhash.finer(mask))


def test_postings_tally_the_shared_positional_bytes():
    rng = np.random.default_rng(6)
    values = rng.integers(0, 4, (60, 8)).astype(np.uint8).view(np.int64).ravel()
    group = np.sort(rng.integers(0, 5, 60))
    fixed = np.zeros((60, 8), bool)
    data = values.view(np.uint8).reshape(-1, 8)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if group[i] == group[j] and (data[i] == data[j]).sum() >= 5}
    a, b = simhash.tallied(group, fixed, values)
    assert {(min(i, j), max(i, j)) for i, j in zip(a.tolist(), b.tolist())} == want and want


def test_rows_without_an_own_id_lose_no_unique_text(make):
    words = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa".split()
    text = lambda k: " ".join(random.Random(k).choices(words, k=40))
    a, b, c, d, e, f, g = map(text, range(7))
    for rows in ([(1, a), (None, a), (None, b), (None, c), (7, d), (7, e), (5, a)], [(3, b), (7, b), (7, f), (9, g)], [(None, a), (None, a), (2, c), (2, c)]):
        ids, texts = zip(*rows)
        kept = [(r.doc_id, r.text) for r in simhash.one_of_each(make(texts, ids)).collect()]
        assert sorted(t for _, t in kept) == sorted(set(texts))
        least = {t: min((i for i, x in rows if x == t and i is not None), default=None) for t in texts}
        assert all(i == least[t] for i, t in kept)


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_columns_with_the_names_used_inside(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "GONE", most)  # broadcast or joined
    df = spark.createDataFrame([(1, "a b c d", 5, 6, 7, 8, 9), (2, "a b c d", 5, 6, 7, 8, 9), (3, "other words here", 5, 6, 7, 8, 9)], "doc_id long, text string, fp int, row int, gone int, first int, fp_of int")
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns and sorted(tuple(r) for r in kept.collect()) == [(1, "a b c d", 5, 6, 7, 8, 9), (3, "other words here", 5, 6, 7, 8, 9)]
