import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.functions import geometry as G
from tallyframe.operators import matching as M


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def box(*v):
    return G.Corners(*(F.lit(float(x)) for x in v))


def test_overlaps_of_the_golden_boxes(spark):
    a, b = box(0, 0, 10, 10), box(5, 5, 15, 15)
    assert one(spark, G.iou(a, b)) == pytest.approx(0.142857, abs=1e-6)
    assert one(spark, G.iou_pixels(a, b)) == pytest.approx(0.174757, abs=1e-6)
    assert one(spark, G.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) is None
    assert one(spark, G.iou_sizes(F.lit(2.0), F.lit(4.0), F.lit(4.0), F.lit(2.0))) == pytest.approx(4 / 12)


def test_columns_and_arrays_agree(spark):
    rng = np.random.default_rng(1)
    a, b = (np.sort(rng.random((40, 2, 2)) * 20, axis=1).reshape(40, 4)[:, [0, 1, 2, 3]] for _ in range(2))
    rows = spark.createDataFrame([(*map(float, x), *map(float, y)) for x, y in zip(a, b, strict=True)], "a double, b double, c double, d double, e double, f double, g double, h double")
    p, q = G.Corners(*map(F.col, "abcd")), G.Corners(*map(F.col, "efgh"))
    got = rows.select(G.iou(p, q).alias("x"), G.iou_pixels(p, q).alias("y")).collect()
    for r, x, y in zip(got, a, b, strict=True):
        assert r.x == pytest.approx(M.overlap_plain(x[None], y[None])[0, 0]) and r.y == pytest.approx(M.overlap_pixels(x[None], y[None])[0, 0])


def test_scaling_undoes_padding(spark):
    r = spark.range(1).select(*G.rescaled(box(0, 52, 416, 364), 416, 640, 480)).first()
    assert tuple(r) == (0.0, 0.0, 640.0, 480.0)
    back = G.normalised(G.denormalised(box(0.1, 0.2, 0.3, 0.4), F.lit(64.0), F.lit(48.0)), F.lit(64.0), F.lit(48.0))
    assert tuple(spark.range(1).select(*back).first()) == pytest.approx((0.1, 0.2, 0.3, 0.4))


def test_matching_rules():
    pred, truth = np.array([[0, 0, 1, 1], [5, 5, 6, 6]], float), np.array([[9, 9, 10, 10]], float)
    assert M.match(pred, truth, 0.0).tolist() == [1, 0] and M.match(pred, truth, 0.5).tolist() == [0, 0]
    same = np.array([[0, 0, 2, 2], [0, 0, 2, 2]], float)
    assert M.match(same[:1], same, 0.5).tolist() == [1] and M.match(same, same[:1], 0.5).tolist() == [1, 0]
    assert M.match(pred, np.zeros((0, 4)), 0.5).tolist() == [0, 0]
    flat = np.array([[3, 3, 3, 3]], float)  # no area: the overlap isn't a number and passes
    assert M.match(flat, flat, 0.9).tolist() == [1]


@pytest.mark.parametrize("seed", range(6))
def test_matching_takes_the_best_free_box(seed):
    rng = np.random.default_rng(seed)
    grid = lambda n: np.sort(rng.integers(0, 4, (n, 2, 2)), axis=1).reshape(n, 4).astype(float)
    pred, truth = grid(9), grid(6)  # many equal overlaps, and boxes without area
    got, taken = M.match(pred, truth, 0.3), set()
    for i, own in enumerate(M.overlap_plain(pred, truth).tolist()):
        best, place = 0.3, None
        for j, v in enumerate(own):
            if j not in taken and (v >= best or v != v or best != best):
                best, place = v, j
        assert got[i] == (place is not None)
        taken.add(place)


def test_frames_without_an_id_are_left_out(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0, 0.9, 1.0, 0, 1), (None, 0.0, 0.0, 1.0, 1.0, 0.9, 1.0, 0, 2)], "frame_id long, x1 double, y1 double, x2 double, y2 double, obj_conf double, cls_conf double, class_id int, rank long")
    assert [r.frame_id for r in M.non_max_suppression(df).collect()] == [1]


def test_suppression_merges_like_boxes(spark):
    boxes = np.array([[0, 0, 10, 10], [1, 1, 11, 11], [50, 50, 60, 60]], float)
    (head, merged), other = M.suppress(boxes, np.array([0.9, 0.6, 0.5]), np.array([0, 0, 0]), np.array([0.9, 0.6, 0.5]), 0.45)
    assert head == 0 and merged == pytest.approx([0.4, 0.4, 10.4, 10.4]) and other[0] == 2
    assert len(M.suppress(boxes[:2], np.array([0.9, 0.6]), np.array([0, 1]), np.array([0.9, 0.6]), 0.45)) == 2
    assert M.overlap_pixels(boxes[:1], boxes[1:2])[0, 0] == pytest.approx(0.704225, abs=1e-6)
    rows = [(f, *map(float, b), o, 1.0, 0, i) for f in (1, 2) for i, (b, o) in enumerate(zip(boxes, (0.9, 0.6, 0.2), strict=True))]
    df = spark.createDataFrame(rows, "frame_id long, x1 double, y1 double, x2 double, y2 double, obj_conf double, cls_conf double, class_id int, rank int")
    out = M.non_max_suppression(df, 0.5, 0.45).collect()
    assert sorted(r.frame_id for r in out) == [1, 2] and out[0].x1 == pytest.approx(0.4)


def test_true_positive_rules():
    truth = np.array([[0, 0, 10, 10], [20, 20, 30, 30]], float)
    pred = np.array([[0, 0, 10, 10], [0, 0, 10, 10], [20, 20, 30, 30]], float)
    tp = M.positives(pred, np.array([0, 0, 1]), truth, np.array([0, 1]), 0.5)
    assert tp.tolist() == [1, 0, 1]
    assert M.positives(pred, np.array([1, 7, 1]), truth, np.array([0, 1]), 0.5).tolist() == [1, 0, 1]  # the best box's class doesn't count


def test_match_and_true_positives_over_frames(spark):
    rows = [(1, 0.0, 0.0, 10.0, 10.0, 0.9, 1, 0), (1, 0.0, 0.0, 10.0, 10.0, 0.5, 2, 0), (2, 0.0, 0.0, 1.0, 1.0, 0.4, 1, 0)]
    pred = spark.createDataFrame(rows, "frame_id long, x1 double, y1 double, x2 double, y2 double, prob double, rank long, class_id int").withColumn("score", F.col("prob"))
    truth = pred.filter("frame_id = 1 and rank = 1").drop("prob", "score")
    assert sorted((r.frame_id, r["rank"], r.matched) for r in M.match_boxes(pred, truth).collect()) == [(1, 1, 1), (1, 2, 0), (2, 1, 0)]
    assert sorted((r.frame_id, r["rank"], r.tp) for r in M.true_positives(pred, truth).collect()) == [(1, 1, 1), (1, 2, 0), (2, 1, 0)]


def test_best_class(spark):
    score, place = M.best_class(F.array(F.lit(0.1), F.lit(0.7), F.lit(0.7)))
    assert tuple(spark.range(1).select(score, place).first()) == (0.7, 1)


def test_sides_of_a_frame_meet_when_each_comes_from_its_own_window(spark):
    """Both tables are already dealt by frame, by exchanges of unlike size that adaptive execution merges unlike."""

    def boxes(n, *more):
        x = F.floor(F.col("id") / 100) * 9.0
        own = spark.range(0, 100 * n, 1, 3).select((F.col("id") % 100).alias("frame_id"), x.alias("x1"), F.lit(0.0).alias("y1"), (x + 2).alias("x2"), F.lit(2.0).alias("y2"), *more)
        return own.withColumn("rank", F.row_number().over(W.partitionBy("frame_id").orderBy("x1")))

    asked = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k"}
    for key, value in asked.items():
        spark.conf.set(key, value)
    try:
        found = M.match_boxes(boxes(20, F.rand(1).alias("prob")), boxes(1)).collect()
    finally:
        for key in asked:
            spark.conf.unset(key)
    assert len(found) == 2000 and sum(r.matched for r in found) == 100
