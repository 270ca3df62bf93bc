import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import models, training
from tallyframe.sources import sinks

ANCHORS = [(1.0, 2.0), (3.0, 1.5)]


def boxes(spark, rows):
    return spark.createDataFrame(rows, "frame_id long, rank int, class_id int, xc double, yc double, w double, h double")


def test_boxes_go_to_cells_and_the_likest_anchor(spark):
    df = boxes(spark, [(1, 0, 2, 0.55, 0.25, 0.1, 0.2), (1, 1, 1, 0.56, 0.26, 0.1, 0.2), (2, 0, 0, 0.0, 0.99, 0.3, 0.15)])
    rows = {(r.frame_id, r.anchor, r.cell_x, r.cell_y): r for r in training.assigned(df, ANCHORS, 10).collect()}
    assert set(rows) == {(1, 0, 5, 2), (2, 1, 0, 9)}
    r = rows[1, 0, 5, 2]  # of two boxes in one place the last counts
    assert (r.class_id, r.tx, r.ty) == (1, pytest.approx(0.6), pytest.approx(0.6)) and r.tw == pytest.approx(0) == r.th
    assert training.ignored(df, ANCHORS, 10, 0.99).count() == 2 and training.ignored(df, ANCHORS, 10, 0.1).count() == 4
    assert training.assigned(df.limit(0), ANCHORS, 10).count() == 0


def test_losses_of_places(spark):
    targets = training.assigned(boxes(spark, [(1, 0, 1, 0.25, 0.25, 0.5, 1.0)]), [(1.0, 2.0)], 2)
    skipped = training.ignored(boxes(spark, [(1, 0, 1, 0.25, 0.25, 0.5, 1.0)]), [(1.0, 2.0)], 2)
    rows = [(1, 0, x, y, 0.4, 0.5, 0.1, 0.0, 0.8 if x == y == 0 else 0.1, [0.2, 0.9]) for x in range(2) for y in range(2)]
    pred = spark.createDataFrame(rows, "frame_id long, anchor int, cell_x int, cell_y int, x double, y double, w double, h double, conf double, scores array<double>")
    r = training.losses(pred, targets, skipped).first()
    assert (r.x, r.y, r.w, r.h) == (pytest.approx(0.01), pytest.approx(0), pytest.approx(0.01), pytest.approx(0, abs=1e-12))
    assert r.conf == pytest.approx(-math.log(0.8) - 100 * math.log(0.9)) and r.cls == pytest.approx(-(math.log(0.8) + math.log(0.9)) / 2)
    assert r.loss == pytest.approx(r.x + r.y + r.w + r.h + r.conf + r.cls) and (r.conf_obj, r.conf_noobj) == (0.8, pytest.approx(0.1))


def test_batches_and_their_boxes(spark):
    placed = training.batches(spark.range(50, 73).withColumnRenamed("id", "frame_id"), 4, 1)
    rows = placed.collect()
    assert sorted((r.batch, r.sample) for r in rows) == [(i // 4, i % 4) for i in range(23)] and {r.side for r in rows} <= set(range(320, 513, 32)) and {r.flipped for r in rows} == {True, False}
    met = {r.frame_id: r for r in training.collated(placed, boxes(spark, [(51, 0, 1, 0.2, 0.5, 0.1, 0.1), (99, 0, 1, 0.2, 0.5, 0.1, 0.1)])).collect()}
    flipped = next(r.flipped for r in rows if r.frame_id == 51)
    assert set(met) == {51} and met[51].xc == pytest.approx(0.8 if flipped else 0.2) and met[51].sample == 1
    assert models.random_side(np.random.default_rng(1)) in range(288, 449, 32)


def test_files_and_scalars_are_written(spark, tmp_path):
    df = spark.createDataFrame([("1.jpg", b"a"), ("no/folder.jpg", b"b")], "name string, content binary")
    assert {r.name: r.written for r in sinks.write_files(df, f"file://{tmp_path}/out").collect()} == {"1.jpg": True, "no/folder.jpg": False}
    assert (tmp_path / "out" / "1.jpg").read_bytes() == b"a"
    for step in (1, 2):
        sinks.log_scalars(spark, str(tmp_path / "log"), step, {"loss": 1 / step, "map": 0.5})
    assert spark.read.parquet(str(tmp_path / "log")).filter(F.col("tag") == "loss").agg(F.sum("value")).first()[0] == 1.5
