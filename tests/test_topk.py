import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import models, topk
from tallyframe.operators.sweep import sweep


def frame(spark, rows):
    return spark.createDataFrame(rows, "frame_id long, n long")


def test_ties_go_to_the_smaller_frame(spark):
    df = frame(spark, [(5, 2), (3, 2), (9, 7), (1, 0)])
    assert [(r.frame_id, r.n) for r in topk.top(df, 3).collect()] == [(9, 7), (3, 2), (5, 2)]
    assert topk.top(frame(spark, []), 3).count() == 0


def test_top_of_each_group_however_it_is_salted(spark, monkeypatch):
    monkeypatch.setattr(topk, "SALTS", 3)
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 5)) for i in range(300)]
    df = frame(spark, rows).withColumn("g", F.when(F.col("frame_id") < 250, "hot").otherwise("cold"))
    got = {(r.g, r.frame_id) for r in topk.top_per_group(df, ["g"], [F.desc("n"), F.asc("frame_id")], 4).collect()}
    want = {(g, f) for g, own in (("hot", rows[:250]), ("cold", rows[250:])) for f, _ in sorted(own, key=lambda r: (-r[1], r[0]))[:4]}
    assert got == want


@pytest.mark.parametrize(("gap", "inclusive"), [(0, False), (1, False), (1, True), (7, False), (1000, False)])
def test_gap(spark, gap, inclusive):
    rng = random.Random(gap)
    rows = [(i, rng.randint(0, 9)) for i in range(120)]
    chosen = []
    for f, n in sorted(rows, key=lambda r: (-r[1], r[0])):
        if len(chosen) < 6 and all(abs(f - c) > gap or inclusive and abs(f - c) >= gap for c, _ in chosen):
            chosen.append((f, n))
    got = topk.top_gap(frame(spark, rows), 6, gap, inclusive=inclusive).collect()
    assert sorted((r.frame_id, r.n) for r in got) == sorted(chosen)


def cdfs(rng, n, top):
    out = []
    for f in range(n):
        w = [rng.random() * (rng.random() < 0.7) for _ in range(top + 1)]
        w[rng.randint(0, top)] += 0.1
        s, acc, cdf = sum(w), 0.0, []
        for x in w:
            acc += x / s
            cdf.append(min(acc, 1.0))
        cdf[-1] = 1.0
        out.append((f, cdf))
    return out


def test_confidence_equals_enumeration(spark):
    rng = random.Random(4)
    table = cdfs(rng, 5, 3)
    confirmed = [(0, 2.0), (1, 1.0)]
    total = 0.0
    pmf = {f: [c[0]] + [b - a for a, b in itertools.pairwise(c)] for f, c in table}
    for counts in itertools.product(range(4), repeat=3):
        if max(counts) <= 1:
            total += pmf[2][counts[0]] * pmf[3][counts[1]] * pmf[4][counts[2]]
    df = spark.createDataFrame(table, "frame_id long, cdf array<double>")
    known = spark.createDataFrame(confirmed, "frame_id long, score double")
    assert topk.confidence(df, known, 2) == pytest.approx(total)
    assert topk.confidence(df, known, 3) == 0.0


@pytest.mark.parametrize("k", [1, 2, 3])
def test_expected_confidence_equals_enumeration(spark, k):
    rng = random.Random(10 + k)
    table = cdfs(rng, 5, 4)
    df = spark.createDataFrame(table, "frame_id long, cdf array<double>")
    sums, zeros = topk.log_products(df)
    for scores in ([3, 2, 1], [2, 2, 2], [4, 1, 0], [1, 1, 0]):
        s_k, s_p = scores[k - 1], scores[k - 2] if k > 1 else None
        got = {r.frame_id: r.e for r in df.select("frame_id", topk._expected(s_k, s_p, sums, zeros).alias("e")).collect()}
        for f, c in table:
            want = 0.0
            for x, p in enumerate([c[0]] + [b - a for a, b in itertools.pairwise(c)]):
                new = sorted([*scores[:k], x], reverse=True)[k - 1]
                product = 1.0
                for g, d in table:
                    if g != f:
                        product *= d[min(new, 4)]
                want += p * product
            assert got[f] == pytest.approx(want, abs=1e-9), (scores, f)


@pytest.mark.parametrize(("gap", "level"), [(0, 1.0), (0, 0.8), (3, 1.0)])
def test_probabilistic_top_confirms_until_sure(spark, gap, level):
    rng = random.Random(7)
    truth = {f: rng.choice([0, 0, 1, 1, 2, 3, 4, 5]) for f in range(60)}
    rows = []
    for f, n in truth.items():  # distributions that allow the truth
        low, high = max(0, n - 1), min(5, n + 1)
        rows.append((f, [0.0 if c < low else 1.0 if c >= high else (c - low + 1) / (high - low + 1) for c in range(6)]))
    table = spark.createDataFrame(rows, "frame_id long, cdf array<double>")
    counts = frame(spark, list(truth.items()))
    out = topk.probabilistic_top(table, models.table_confirmer(counts), 5, level, 8, gap)
    assert out.confidence >= level and out.n_rounds == len(out.n_confirmed)
    if level == 1.0:
        best = topk.GapList(gap, 5) if gap else None
        ranked = sorted(truth.items(), key=lambda x: (-x[1], x[0]))
        if best:
            for f, n in ranked:
                best.push(n, f)
        want = [n for n, _ in best.top] if best else [n for _, n in ranked[:5]]
        assert out.values == want
        assert sum(out.n_confirmed) < 60


def test_fewer_frames_than_k_and_none(spark):
    table = spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.2, 1.0])], "frame_id long, cdf array<double>")
    out = topk.probabilistic_top(table, models.table_confirmer(frame(spark, [(1, 1)])), 5, 0.9, 8)
    assert out.frames == [1, 2] and out.values == [1.0, 0.0]
    none = topk.probabilistic_top(table.limit(0), models.table_confirmer(frame(spark, [])), 5, 0.9, 8)
    assert none.frames == [] and none.n_rounds == 0


def test_a_detector_is_called_for_chosen_frames_only(spark):
    frames = spark.createDataFrame([(i, bytes([i])) for i in range(20)], "frame_id long, content binary")

    def load():
        return lambda images: [[(0.0, 0.0, 1.0, 1.0, 0.9, 1.0, 2)] * (b[0] % 4) for b in images]

    assert models.detect(frames, load, 7).count() == sum(i % 4 for i in range(20))
    confirm = models.count_confirmer(frames, load, 2)
    got = {r.frame_id: r.score for r in confirm(frames.select("frame_id").filter("frame_id < 6")).collect()}
    assert got == {i: float(i % 4) for i in range(6)}


def test_sweep(spark):
    table = spark.createDataFrame([(i, [0.0] * (i % 5) + [1.0] * (5 - i % 5)) for i in range(30)], "frame_id long, cdf array<double>")
    counts = frame(spark, [(i, i % 5) for i in range(30)])
    truth = [(r.frame_id, float(r.n)) for r in topk.top(counts, 30).collect()]
    rows = sweep(spark, table, models.table_confirmer(counts), truth, (1, 4), (0.5, 1.0), gap=1, batch=4).collect()
    assert len(rows) == 4 and all(r.precision == 1.0 and r.score_error == 0.0 for r in rows)


def test_lower_confidences_are_reached_on_the_way(spark):
    rng = random.Random(9)
    truth = {f: rng.choice([0, 1, 1, 2, 3, 4]) for f in range(50)}
    table = spark.createDataFrame([(f, [min(1.0, 0.15 * (c + 1)) if c < n else 0.6 if c == n else 1.0 for c in range(6)]) for f, n in truth.items()], "frame_id long, cdf array<double>")
    confirm = models.table_confirmer(frame(spark, list(truth.items())))
    whole = topk.probabilistic_top(table, confirm, 3, 0.95, 4)
    for level in (0.3, 0.8, 0.95):
        own, part = topk.probabilistic_top(table, confirm, 3, level, 4), whole.at(level)
        assert (own.frames, own.values, own.n_rounds, own.n_confirmed, own.confidence) == (part.frames, part.values, part.n_rounds, part.n_confirmed, part.confidence)


@pytest.mark.parametrize("gap", [0, 2])
def test_confidences_below_one_equal_an_enumeration(spark, gap):
    """The confidence that a search stops at is the probability that no unconfirmed frame is above the k-th value."""
    rng = random.Random(31 + gap)
    table = cdfs(rng, 9, 3)
    truth = {f: rng.randint(0, 3) for f, _ in table}
    df = spark.createDataFrame(table, "frame_id long, cdf array<double>")
    seen = []

    def confirm(first):
        own = models.table_confirmer(frame(spark, list(truth.items())))(first)
        seen.extend(r.frame_id for r in own.collect())
        return own

    out = topk.probabilistic_top(df, confirm, 2, 0.55, 2, gap)
    pmf = {f: [c[0]] + [b - a for a, b in itertools.pairwise(c)] for f, c in table}
    rest = [f for f, _ in table if f not in seen]
    total = 0.0
    for counts in itertools.product(range(4), repeat=len(rest)):
        if all(n <= out.values[-1] for n in counts):
            p = 1.0
            for f, n in zip(rest, counts):
                p *= pmf[f][n]
            total += p
    assert out.confidence == pytest.approx(total) and out.confidence >= 0.55
    assert sorted(out.values, reverse=True) == out.values and all(truth[f] == v for f, v in zip(out.frames, out.values))
