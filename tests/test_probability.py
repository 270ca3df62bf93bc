import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.functions import probability as P
from tallyframe.operators import calibration, density, uncertain


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lits(values):
    return F.array(*(F.lit(float(v)) for v in values))


def test_normal_cdf_is_exact(spark):
    z = np.linspace(-5, 5, 201)
    rows = spark.createDataFrame([(float(x),) for x in z], "z double").select(P.normal_cdf(F.col("z")).alias("p")).collect()
    for r, x in zip(rows, z, strict=True):
        want = 0.5 * math.erfc(-x / math.sqrt(2))
        assert r.p == pytest.approx(want, rel=1e-12) and math.log(r.p) == pytest.approx(math.log(want), rel=1e-12, abs=1e-15)


def test_golden_mixture(spark):
    df = spark.createDataFrame([(1, [0.25, 0.75], [1.0, 3.0], [0.5, 1.0])], "frame_id long, pi array<double>, mu array<double>, sigma array<double>")
    df = df.select("frame_id", P.mixture(F.col("pi"), F.col("mu"), F.col("sigma")).alias("parts"))
    assert uncertain.largest_count(df, F.col("parts")) == 8
    cdf = uncertain.from_mixtures(df, F.col("parts")).first().cdf
    assert cdf == pytest.approx([0.006700, 0.142063, 0.363304, 0.624992, 0.881009, 0.982937, 0.998988, 0.999976, 1.0], abs=2e-6)
    assert df.select(P.mixture_mean(F.col("parts"))).first()[0] == pytest.approx(2.5)
    want = -math.log(sum(w * math.exp(-0.5 * ((2 - m) / s) ** 2) / (s * math.sqrt(2 * math.pi)) for w, m, s in ((0.25, 1, 0.5), (0.75, 3, 1))))
    assert uncertain.log_loss(df, F.col("parts"), F.lit(2.0)).first().loss == pytest.approx(want)


def test_golden_count_distribution(spark):
    pmf = one(spark, P.count_pmf(lits([0.2, 0.5, 0.9])))
    assert pmf == pytest.approx([0.04, 0.41, 0.46, 0.09])
    assert one(spark, P.mean_count(lits(pmf))) == pytest.approx(1.6)
    assert one(spark, P.running(lits(pmf))) == pytest.approx([0.04, 0.45, 0.91, 1.0])
    assert one(spark, P.count_pmf(F.array().cast("array<double>"))) == [1.0]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(0, 1), max_size=6))
def test_count_distribution_equals_enumeration(spark, p):
    want = [0.0] * (len(p) + 1)
    for hits in itertools.product((0, 1), repeat=len(p)):
        want[sum(hits)] += math.prod(q if h else 1 - q for q, h in zip(p, hits, strict=True))
    assert one(spark, P.count_pmf(lits(p) if p else F.array().cast("array<double>"))) == pytest.approx(want)


def test_softmax_and_quantised(spark):
    got = one(spark, P.softmax(lits([1000.0, 1000.0, 999.0])))
    assert sum(got) == pytest.approx(1) and got[0] == got[1] > got[2]
    assert one(spark, P.quantised(F.lit(1.23456749))) == 1.234567


def test_padded_distributions(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, 1.0)], "frame_id long, p double")
    got = {r.frame_id: r.cdf for r in uncertain.from_detections(df, F.col("p")).collect()}
    assert got == {1: [0.25, 0.75, 1.0], 2: [0.0, 1.0, 1.0]}


def pav(x, y):
    blocks = []
    for a, b in sorted(zip(x, y, strict=True)):
        blocks.append([b, 1, [a]])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            m, n, xs = blocks.pop()
            k = blocks[-1]
            blocks[-1] = [(k[0] * k[1] + m * n) / (k[1] + n), k[1] + n, k[2] + xs]
    return {a: m for m, _, xs in blocks for a in xs}


def test_isotonic_regression(spark):
    x = [i / 20 for i in range(20)]
    y = [0, 0, 1, 0, 0, 1, 1, 0, 1, 0, 0, 1, 1, 1, 0, 1, 1, 0, 1, 1]
    df = spark.createDataFrame(list(zip(x, y, strict=True)), "prob double, label int")
    model = calibration.fit(df)
    got = {r.prob: r.calibrated for r in calibration.calibrated(model, df).collect()}
    assert got == pytest.approx(pav(x, y))
    outside = spark.createDataFrame([(-1.0,), (2.0,), (None,)], "prob double")
    ends = {r.prob: r.calibrated for r in calibration.calibrated(model, outside).collect()}
    assert (ends[-1.0], ends[2.0]) == (0.0, 1.0)
    assert calibration.mean_squared_error(calibration.calibrated(model, df)).first().mse == pytest.approx(np.mean([(pav(x, y)[a] - b) ** 2 for a, b in zip(x, y, strict=True)]))


def test_density_sums_to_the_count(spark):
    inside = density.density(np.array([[100, 100], [100.4, 100.2], [300, 10]]), 240, 320, 5.0)
    assert inside.sum() == pytest.approx(1 + 1 - 0.02, abs=0.03)  # two points share a cell; one is cut by the border
    assert density.density(np.array([[-1, 5], [400, 5]]), 240, 320).sum() == 0
    df = spark.createDataFrame([(1, 0.5, 0.5), (1, 0.25, 0.5), (2, 0.5, 0.5)], "frame_id long, xc double, yc double")
    got = {r.frame_id: sum(r.density) for r in density.density_maps(df, 120, 160, 4.0).collect()}
    assert got == pytest.approx({1: 2.0, 2: 1.0}, abs=1e-3)
