import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import counting as C
from tallyframe.operators import splits
from tallyframe.operators import windows as V


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "frame_id long")


@pytest.mark.parametrize("parts", [1024, 3])
def test_positions(spark, monkeypatch, parts):
    monkeypatch.setattr(V, "PARTS", parts)
    values = random.Random(1).sample(range(-500, 10**6), 400)
    got = {r.frame_id: r.pos for r in V.with_position(ids(spark, values)).collect()}
    assert got == {v: i for i, v in enumerate(sorted(values))}
    assert V.with_position(ids(spark, [])).count() == 0


def test_missing_frames_and_gaps(spark):
    df = ids(spark, [3, 4, 8, 8, 12, 13])
    assert sorted(r.frame_id for r in C.missing(df).collect()) == [5, 6, 7, 9, 10, 11]
    assert C.missing_count(df).first().n_missing == 6
    assert sorted(tuple(r) for r in C.gaps(df).collect()) == [(4, 8, 3), (8, 12, 3)]
    assert C.missing(ids(spark, [])).count() == 0 and C.gaps(ids(spark, [])).count() == 0
    wide = ids(spark, [0, 10**6, 10**6 + 5000])
    assert sorted(tuple(r) for r in C.gaps(wide).collect()) == [(0, 10**6, 10**6 - 1), (10**6, 10**6 + 5000, 4999)]


def test_counts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (4, "b"), (4, "a"), (4, "a")], "frame_id long, class_name string")
    assert C.class_total(df, "a").first().n == 3 and C.class_total(df.limit(0), "a").first().n == 0
    assert {r.frame_id: r.n for r in C.dense(C.frame_counts(df, "a")).collect()} == {1: 1, 2: 0, 3: 0, 4: 2}


def test_mean_by_count_has_empty_counts(spark):
    df = spark.createDataFrame([(i, 0 if i < 15 else 2, float(i)) for i in range(16)], "frame_id long, gt long, m double")
    got = {r.gt_count: (r.n, r.mean, r.frames) for r in C.mean_by_count(df, F.col("gt"), F.col("m")).collect()}
    assert got == {0: (15, 7.0, list(range(10))), 1: (0, 0.0, []), 2: (1, 15.0, [15])}


def test_channel_statistics_are_means_of_each_image(spark):
    df = spark.createDataFrame([(1, [1.0, 3.0], [0.0, 0.0]), (2, [5.0, 5.0], [2.0, 4.0])], "image_id long, r array<double>, g array<double>")
    got = {r.channel: (r.mean, r.std) for r in C.channel_statistics(df, F.array("r", "g")).collect()}
    assert got[0] == pytest.approx((3.5, 2**0.5 / 2)) and got[1] == pytest.approx((1.5, 2**0.5 / 2))


def test_class_weights_and_rounding(spark):
    df = spark.createDataFrame([(0,)] * 3 + [(1,)], "label int")
    assert {r.label: r.weight for r in C.class_weights(df, F.col("label")).collect()} == pytest.approx({0: 25.0, 1: 75.0})
    half = spark.createDataFrame([(0.5, 0), (1.5, 2), (2.5, 3)], "p double, y int")
    assert C.accuracy(half, F.col("p"), F.col("y")).first().accuracy == pytest.approx(2 / 3)


def test_skip_runs(spark):
    flags = [1, 0, 0, 1, 1, 0, 0, 0]
    df = spark.createDataFrame([(7, i, f) for i, f in enumerate(flags)] + [(8, 0, 1)], "video long, i long, f int")
    got = {r.video: (r.max_skip, r.open_run) for r in V.skip_runs(df, F.col("f") == 1, ["video"], ["i"]).collect()}
    assert got == {7: (3, 4), 8: (0, 1)}


def test_forward_fill(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 5.0), (1, 2, None), (2, 0, 1.0), (2, 1, None)], "video long, i long, v double")
    got = [r.filled for r in V.forward_filled(df, "v", ["video"], ["i"]).orderBy("video", "i").collect()]
    assert got == [None, 5.0, 5.0, 1.0, 1.0]


@pytest.mark.parametrize(("template", "want"), [("zero", [True, False, True]), ("last", [True, False, True])])
def test_key_batches(spark, template, want):
    rows = [(i, [0.1, 0.1] if i < 4 else [3.0, 3.0]) for i in range(6)]
    df = V.with_batch(V.with_position(spark.createDataFrame(rows, "frame_id long, pixels array<double>")), 2)
    out = V.key_batches(df, "pixels", 1.0, template=template).orderBy("batch").collect()
    assert [r.is_key for r in out] == want
    assert all(r.is_key for r in V.key_batches(df, "pixels", 0.0, template=template).collect())


@pytest.mark.parametrize(("n", "hour", "sizes"), [(80, 1, (24, 24, 24)), (60, 1, (24, 12, 24)), (48, 1, (24, 0, 24)), (30, 1, (1, 1, 28)), (10, 4, (3, 3, 4)), (2, 9, (0, 0, 2))])
def test_splits(spark, n, hour, sizes):
    out = splits.split(ids(spark, range(100, 100 + n)), hour).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in out} == {p: s for p, s in zip(("train", "val", "test"), sizes, strict=True) if s}
    with pytest.raises(ValueError):
        splits.parts_of(10, 0)


def test_samples_are_reproducible(spark):
    df = ids(spark, range(200))
    a = {r.frame_id for r in splits.sample(df, 20, 1, F.col("frame_id") % 2 == 0).collect()}
    b = {r.frame_id for r in splits.sample(df.repartition(7), 20, 1, F.col("frame_id") % 2 == 0).collect()}
    assert a == b and len(a) == 20 and all(x % 2 == 0 for x in a)
    assert a != {r.frame_id for r in splits.sample(df, 20, 2, F.col("frame_id") % 2 == 0).collect()}


@pytest.mark.parametrize("parts", [1, 3, 1024])
def test_ranges_don_t_change_what_is_carried_or_counted(spark, monkeypatch, parts):
    monkeypatch.setattr(V, "PARTS", parts)
    rng = random.Random(parts)
    rows = [(rng.choice([1, 1, 1, None]), i, rng.choice([None, None, float(i)]), rng.choice([0, 0, 1])) for i in rng.sample(range(1000), 120)]
    df = spark.createDataFrame(rows, "video long, i long, v double, f int")
    last, filled, island, runs = {}, {}, {}, {}
    for video, i, v, f in sorted(rows, key=lambda r: r[1]):
        last[video] = last.get(video) if v is None else v
        filled[i] = last[video]
        island[video] = island.get(video, 0) + f
        runs.setdefault(video, {}).setdefault(island[video], 0)
        runs[video][island[video]] += 1
    assert {r.i: r.filled for r in V.forward_filled(df, "v", ["video"], ["i"]).collect()} == filled
    want = {video: (max([n for k, n in own.items() if k < max(own)], default=0), own[max(own)]) for video, own in runs.items()}
    assert {r.video: (r.max_skip, r.open_run) for r in V.skip_runs(df, F.col("f") == 1, ["video"], ["i"]).collect()} == want
    assert V.forward_filled(df.limit(0), "v", ["video"], ["i"]).count() == 0 == V.skip_runs(df.limit(0), F.col("f") == 1, ["video"], ["i"]).count()
