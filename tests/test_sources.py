import json
import os
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import text as X
from tallyframe.operators import models
from tallyframe.session import removed, shared_dir, written
from tallyframe.sources import labels, sinks

LINE = "121.61,96.68,181.47,365.60,0.99994,0.99997,0.0"


def test_path_functions(spark):
    df = spark.createDataFrame([("data/images/10.jpg",), ("data/images/9.JPEG",), ("x/100.png",), ("images/images/7.txt.jpg",), ("a.jpg",)], "p string")
    rows = df.orderBy(*X.natural(F.col("p"))).select(X.frame_id(F.col("p")).alias("i"), X.is_image(F.col("p")).alias("m"), X.sibling(F.col("p"), "labels", "txt").alias("s")).collect()
    assert [(r.i, r.m) for r in rows] == [(None, True), (100, False), (10, True), (9, True), (7, True)]
    assert rows[4].s == "labels/labels/7.txt.txt"


def test_detection_files_round_trip(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "12.txt").write_text(f"{LINE}\n\n{LINE.replace('0.0', '16.0')}")
    (tmp_path / "d" / "13.txt").write_text("")
    rows = labels.detection_files(spark, str(tmp_path / "d"))
    got = rows.orderBy("rank").collect()
    assert [(r.frame_id, r["rank"], r.class_id, r.x1) for r in got] == [(12, 0, 0, 121.61), (12, 1, 16, 121.61)]
    frames = spark.createDataFrame([(12,), (13,)], "frame_id long")
    texts = {r.frame_id: r.text for r in sinks.frame_texts(frames, rows).collect()}
    assert texts[13] == "" and texts[12].count("\n") == 2 and texts[12].startswith("121.61,96.68")


def test_truth_files(spark, tmp_path):
    (tmp_path / "3.txt").write_text("0 0.515 0.5 0.21694873 0.18286777\n")
    rows = labels.truth_files(spark, str(tmp_path))
    r = rows.first()
    assert (r.frame_id, r.class_id, r.xc, r.h) == (3, 0, 0.515, 0.18286777)
    assert sinks.truth_lines(rows).first().text == "0 0.515 0.5 0.21694873 0.18286777"


def test_path_lists(spark, tmp_path):
    (tmp_path / "list.txt").write_text("v/10.jpg\n v/9.jpg\nv/100.jpg\n\n")
    assert sorted(r.frame_id for r in labels.path_list(spark, str(tmp_path / "list.txt")).collect()) == [9, 10, 100]
    assert [r.frame_id for r in labels.path_list(spark, str(tmp_path / "list.txt"), 2).collect()] == [9, 10]
    sinks.write_path_list(labels.path_list(spark, str(tmp_path / "list.txt")), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 3


def test_images_of_a_folder(spark, tmp_path):
    for name in ("1.jpg", "2.JPEG", "3.png"):
        (tmp_path / name).write_bytes(name.encode())
    assert sorted((r.frame_id, bytes(r.content)) for r in labels.listing(spark, str(tmp_path)).collect()) == [(1, b"1.jpg"), (2, b"2.JPEG")]


def test_json_labels_and_distributions(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"timestamp": 2, "count": 3, "image_path": "b"}, {"timestamp": 1, "count": 0, "image_path": "a"}]))
    assert sorted((r.timestamp, r["count"]) for r in labels.count_labels(spark, str(tmp_path / "c.json")).collect()) == [(1, 0), (2, 3)]
    assert [r.timestamp for r in labels.count_labels(spark, str(tmp_path / "c.json"), 1).collect()] == [1]
    (tmp_path / "u.json").write_text('[{"timestamp":1,"prob":[0.1,0.6,1.0],"image_path":"images/1.jpg"}]')
    table = labels.uncertain_table(spark, str(tmp_path / "u.json"))
    assert table.first().prob == [0.1, 0.6, 1.0]
    sinks.write_records(table, str(tmp_path / "w"))
    assert spark.read.schema(labels.UNCERTAIN).json(str(tmp_path / "w")).first() == table.first()
    (tmp_path / "t.json").write_text('{"baseline": {"inference": 8.0}, "ours": {"inference": 2.0}}')
    assert tuple(labels.timings(spark, str(tmp_path / "t.json")).first()) == (8.0, 2.0)


def test_class_names(spark):
    assert labels.class_names("person\nbus\n") == ["person", "bus"] == labels.class_names("person\nbus")
    assert labels.class_id(["person", " Bus "], "bus") == 1
    with pytest.raises(ValueError):
        labels.class_id(["person"], "cat")
    assert labels.class_table(spark, ["a", "b"]).count() == 2


def test_small_files():
    assert labels.timing("days:1\nseconds:2\nmicroseconds:214852") == 86402.214852
    assert labels.settings("classes=80\n# x\nnames = a.names\n\ngpus=1") == {"gpus": "1", "num_workers": "10", "classes": "80", "names": "a.names"}
    blocks = labels.network("[net]\nheight=416\n#c\n[convolutional]\nfilters = 32\n[yolo]\nmask = 0,1\n")
    assert [b["type"] for b in blocks] == ["net", "convolutional", "yolo"] and blocks[1] == {"type": "convolutional", "batch_normalize": "0", "filters": "32"}
    assert labels.merged_options({"k": None, "gap": 1}, {"k": 100, "gap": 0}) == {"k": 100, "gap": 1}


def test_store_keeps_the_last_text(spark, tmp_path):
    path = str(tmp_path / "store")
    for text in ("old", "new"):
        sinks.write_store(spark.createDataFrame([(1, text), (2, "")], "frame_id long, text string"), path, 4)
    assert sinks.lookup(spark, path, 1, 4) == "new" and sinks.lookup(spark, path, 2, 4) == "" and sinks.lookup(spark, path, 3, 4) is None
    assert {r.frame_id: r.text for r in sinks.store(spark, path).collect()} == {1: "new", 2: ""}


def test_image_geometry():
    flat = np.full((4, 6, 3), 7.0)
    assert np.allclose(models.resized(flat, 9, 5), 7.0) and models.padded_square(flat).shape == (6, 6, 3)
    ramp = np.arange(8.0).reshape(1, 8, 1)
    assert np.allclose(models.resized(ramp, 1, 4)[0, :, 0], [0.5, 2.5, 4.5, 6.5])
    image, boxes = models.flipped(ramp, np.array([[0.25, 0.5, 0.1, 0.1]]))
    assert image[0, 0, 0] == 7 and boxes[0, 0] == 0.75
    assert models.tensor(np.full((8, 8, 3), 255, np.uint8), 16).shape == (3, 16, 16)
    pi, mu, sigma = np.ones((2, 1)), np.zeros((2, 1)), np.ones((2, 1))
    assert (pi.shape, mu.shape, sigma.shape) == ((2, 1),) * 3


def test_estimates(spark):
    frames = spark.createDataFrame([(i, bytes([i])) for i in range(5)], "frame_id long, content binary")

    def load():
        return lambda images: (np.ones((len(images), 1)), np.array([[float(b[0])] for b in images]), np.ones((len(images), 1)))

    got = {r.frame_id: (r.pi, r.mu) for r in models.estimate(frames, load, 2).collect()}
    assert got[3] == ([1.0], [3.0])


def test_every_record_is_read_back(spark, tmp_path):
    rows = [(i, i % 4, f"images/{i}.jpg") for i in range(100)]
    df = spark.createDataFrame(rows, labels.COUNTS)
    for parts in (1, 3):  # many records in a part, and several parts
        sinks.write_records(df.coalesce(1).repartition(parts), str(tmp_path / f"c{parts}"))
        assert sorted(tuple(r) for r in labels.count_labels(spark, str(tmp_path / f"c{parts}")).collect()) == rows
    table = spark.createDataFrame([(i, [0.25, 1.0], f"{i}.jpg") for i in range(10)], labels.UNCERTAIN)
    sinks.write_records(table.coalesce(1), str(tmp_path / "u"))
    assert sorted(labels.uncertain_table(spark, str(tmp_path / "u")).collect()) == sorted(table.collect())


def test_a_cluster_must_name_a_shared_folder():
    def session(master, named):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: named), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master=master))

    assert shared_dir(session("spark://host:7077", "hdfs://x/shared/"), "t").startswith("hdfs://x/shared/t-")
    assert shared_dir(session("local[4]", None), "t").startswith("/tmp/")
    with pytest.raises(ValueError):
        shared_dir(session("spark://host:7077", None), "t")


def test_scratch_tables_are_removed_and_settings_come_back(spark, tmp_path):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    df = written(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "scratch")
    assert df.count() == 7 and spark.conf.get(key) == before
    folder = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert os.path.isdir(folder)
    removed(spark, df)
    assert not os.path.exists(folder)
