import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import probability as P
from tallyframe.operators import calibration, counting, flow, labelling, models, topk
from tallyframe.sources import images, labels, network


def bmp(pixels):
    """An uncompressed bitmap of height x width x 3 red, green, blue bytes."""
    h, w = pixels.shape[:2]
    row = b"".join(pixels[y, :, ::-1].tobytes() + bytes(-3 * w % 4) for y in range(h - 1, -1, -1))
    return b"BM" + struct.pack("<IHHI", 54 + len(row), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(row), 2835, 2835, 0, 0) + row


def test_images_are_read_as_rgb(spark, tmp_path):
    pixels = np.random.default_rng(1).integers(0, 256, (4, 5, 3)).astype(np.uint8)
    (tmp_path / "12.bmp").write_bytes(bmp(pixels))
    (tmp_path / "13.bmp").write_bytes(b"not an image")
    df = images.images(spark, str(tmp_path))
    r = df.first()
    assert df.count() == 1 and (r.frame_id, r.height, r.width) == (12, 4, 5)
    assert np.array_equal(np.frombuffer(bytes(r.pixels), np.uint8).reshape(4, 5, 3), pixels)
    r = images.mapped(df, lambda p: models.resized(models.padded_square(p), 10, 10)).first()
    assert (r.height, r.width, len(r.pixels)) == (10, 10, 300)


def test_video_frames_are_numbered_from_one(spark, tmp_path):
    frames = [b"\xff\xd8\xff\xe0" + bytes([i]) * 9 + b"\xff\xd9" for i in range(5)]
    (tmp_path / "v.mjpeg").write_bytes(b"junk" + b"--x".join(frames) + b"\xff\xd8\xff cut")
    got = images.video_frames(spark, str(tmp_path)).orderBy("frame_id").collect()
    assert [(r.frame_id, bytes(r.content)) for r in got] == list(enumerate(frames, 1))
    assert images.video_frames(spark, str(tmp_path), 2).count() == 2


def test_training_rows(spark):
    frames = spark.createDataFrame([(1,), (2,)], "frame_id long")
    truth = spark.createDataFrame([(1, 0.5)], "frame_id long, xc double")
    maps = spark.createDataFrame([(1, [0.5]), (2, [0.0])], "frame_id long, density array<double>")
    assert {r.frame_id: r.label for r in images.training_rows(frames, truth, maps).collect()} == {1: 1, 2: 0}


def test_weight_files_round_trip():
    text = "[net]\nchannels=3\n[convolutional]\nbatch_normalize=1\nfilters=4\nsize=3\n[convolutional]\nfilters=2\nsize=1\n[route]\nlayers=-1,0\n[convolutional]\nfilters=1\nsize=1\n"
    blocks = labels.network(text)
    assert network.layers(blocks) == [(0, True, 4, 3, 3), (1, False, 2, 4, 1), (3, False, 1, 6, 1)]
    n = 4 * 4 + 4 * 27 + 2 + 8 + 1 + 6
    data = struct.pack("<5i", 0, 2, 0, 7, 0) + np.arange(n, dtype="<f4").tobytes()
    header, arrays = network.load(blocks, data)
    assert header == (0, 2, 0, 7, 0) and arrays[3]["kernel"].ravel()[-1] == n - 1 and arrays[0]["scale"][0] == 4
    assert network.save(header, arrays) == data
    assert set(network.load(blocks, data, 1)[1]) == {0}


def test_labels_from_a_detector(spark):
    def detector():  # a box of class 2 for each unit of an image's first byte, and the like of each
        return lambda found: [[(50.0 * i, 0.0, 50.0 * i + 20, 20.0, 0.9 - d / 10, 1.0, 2) for i in range(b[0]) for d in range(2)] for b in found]

    frames = spark.createDataFrame([(i, bytes([i % 3]), f"v/{i}.jpg") for i in range(9)], "frame_id long, content binary, path string")
    found = labelling.detections(frames, detector)
    counts = {r.timestamp: r["count"] for r in labelling.count_labels(frames, found, 2).collect()}
    assert counts == {i: i % 3 for i in range(9)}
    boxes = labelling.box_labels(found, 2, 100, 20)
    assert boxes.count() == 9 and boxes.agg(F.max("h")).first()[0] == pytest.approx(1.0)
    assert labelling.box_labels(found, 2, 100, 20, 2).select("frame_id").distinct().count() == 2


def test_a_whole_query(spark, tmp_path):
    rng = random.Random(5)
    truth = {i: rng.choice([0, 1, 2, 3, 5, 8]) for i in range(80)}
    frames = spark.createDataFrame([(i, bytes([n])) for i, n in truth.items()], "frame_id long, content binary")

    def cheap():  # a wide guess around the truth
        def run(found):
            n = np.array([[float(b[0])] for b in found])
            return np.ones_like(n), n + 0.3, np.full_like(n, 0.8)

        return run

    table = flow.build_table(frames, cheap, str(tmp_path / "t"))
    assert flow.read_table(spark, str(tmp_path / "t")).count() == 80
    counts = spark.createDataFrame(list(truth.items()), "frame_id long, n long")
    for gap in (0, 2):
        query = flow.Query(k=5, confidence=0.95, gap=gap, batch=8)
        out = flow.answer(table, models.count_confirmer(frames, lambda: lambda found: [[(0.0, 0.0, 1.0, 1.0, 0.9, 1.0, 0)] * b[0] for b in found], 0), query)
        row = flow.judge(spark, out, counts, query).first()
        assert row.precision == row.recall == 1.0 and row.score_error == 0 and row.confidence >= 0.95 and row.n_confirmed < 80


def test_calibrators_are_saved(spark, tmp_path):
    model = calibration.fit(spark.createDataFrame([(0.1, 0), (0.9, 1)], "prob double, label int"))
    calibration.save(model, str(tmp_path / "m"))
    df = spark.createDataFrame([(0.5,)], "prob double")
    assert calibration.calibrated(calibration.load(str(tmp_path / "m")), df).first().calibrated == pytest.approx(0.5)


def test_dense_numbering_is_required(spark):
    ids = lambda v: spark.createDataFrame([(x,) for x in v], "frame_id long")
    assert counting.require_dense(ids([1, 2, 3])) == 3 and counting.require_dense(ids([])) == 0
    for v in ([1, 3], [2, 3]):
        with pytest.raises(ValueError):
            counting.require_dense(ids(v))
    assert labels.timing(labels.timing_text(86402.25)) == 86402.25


def test_mixture_heads_and_samples(spark):
    x = F.array(F.lit(1.0), F.lit(2.0))
    parts = P.mixture_head(x, ([[0.0, 0.0], [0.0, 0.0]], [0.0, 0.0]), ([[0.0, 0.0], [0.0, 0.0]], [-3.0, -3.0]), ([[1.0, 1.0], [5.0, 5.0]], [0.0, 0.0]))
    df = spark.range(3000).select(F.explode(F.array(parts)).alias("parts"))
    assert df.first().parts[1].mu == 15.0
    draws = [r.v for r in df.select(P.mixture_sample(F.col("parts"), 3).alias("v")).collect()]
    low = [v for v in draws if v < 9]
    assert 0.45 < len(low) / 3000 < 0.55 and abs(np.mean(low) - 3) < 0.02


def test_gap_list():
    g = topk.GapList(2, 2)
    assert g.push(5, 10) and g.push(4, 11) and not g.push(3, 13) and g.top == [(5, 10), (3, 13)]
