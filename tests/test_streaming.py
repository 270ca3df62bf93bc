from datetime import datetime

import duckdb
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql.readwriter import DataFrameWriter

from tallyframe.plans import catalogue, files
from tallyframe.sources import sinks
from tallyframe.streaming import frames as S


def events(spark, folder, rows):
    df = spark.createDataFrame([(i, t, u, "click", v, "{}") for i, t, u, v in rows], S.EVENTS)
    df.coalesce(1).write.mode("append").parquet(str(folder))


def rows():
    return [(i, datetime(2024, 1, 1, i // 4), i % 2, float(i % 5 * 10)) for i in range(24)]


def drained(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_windowed_counts_equal_the_batch(spark, tmp_path):
    events(spark, tmp_path, rows()[:12])
    events(spark, tmp_path, rows()[12:])
    got = drained(S.windowed_counts(S.stream(spark, str(tmp_path))), "counts", "complete")
    assert sorted((r.w.start.hour, r.n) for r in got) == [(h, 4) for h in range(6)]


def test_state_carries_key_frames_over_batches(spark, tmp_path):
    events(spark, tmp_path, rows()[:10])
    events(spark, tmp_path, rows()[10:])
    got = {r.frame_id: r.carried for r in drained(S.carried(S.stream(spark, str(tmp_path)), 15.0), "carried", "append")}
    last, want = {}, {}
    for i, _, u, v in rows():
        if u not in last or abs(v - last[u]) >= 15:
            last[u] = v
        want[i] = last[u]
    assert got == want


def test_upserts_are_idempotent(spark, tmp_path):
    events(spark, tmp_path / "in", rows())
    texts = S.stream(spark, str(tmp_path / "in")).selectExpr("frame_id", "class_name as text")
    for k in range(2):  # the same input twice
        S.upsert(texts, str(tmp_path / "store"), str(tmp_path / f"check{k}")).awaitTermination()
    assert sinks.store(spark, str(tmp_path / "store")).count() == 24
    assert sinks.lookup(spark, str(tmp_path / "store"), 5) == "click"


def test_carried_whatever_the_files(spark, tmp_path, monkeypatch):
    """The query gives the same rows however many files its events are in, and in whatever order they are written."""
    data = [(i, datetime(2024, 1, 1), i % 2, float(i * 7 % 50), "click", "{}") for i in range(60)]
    (tmp_path / "sf").mkdir()
    spark.createDataFrame([(i, t, u, c, v, p) for i, t, u, v, c, p in data], S.EVENTS).write.parquet(str(tmp_path / "sf/events.parquet"))
    write = DataFrameWriter.parquet

    def backwards(self, path, *more, **options):
        if "/stream-" not in path:
            return write(self, path, *more, **options)
        for i in range(55, -1, -5):
            write(self._df.filter(f"event_id between {i} and {i + 4}").coalesce(1).write.mode("append"), path)

    monkeypatch.setattr(DataFrameWriter, "parquet", backwards)
    got = {r.frame_id: r.carried for r in files.stream_carried(spark, str(tmp_path / "sf")).collect()}
    last, want = {}, {}
    for i, _, u, v, *_ in data:
        if u not in last or abs(v - last[u]) >= 30:
            last[u] = v
        want[i] = last[u]
    assert got == want


def test_late_frames_are_an_error(spark, tmp_path):
    events(spark, tmp_path, rows()[10:])
    events(spark, tmp_path, rows()[:10])
    with pytest.raises(StreamingQueryException, match="must come in order"):
        drained(S.carried(S.stream(spark, str(tmp_path)), 15.0), "late", "append")


@pytest.mark.parametrize("cuts", [[], [1], [1, 2, 5, 9]])
def test_carried_nulls_and_nans_as_in_sql(spark, tmp_path, cuts):
    nan, inf = float("nan"), float("inf")
    values = {0: [None, 5.0, 90.0, nan, None], 1: [1.0, None, 20.0, nan, 21.0, None, 22.0, 40.0], 2: [nan, None, 3.0, inf, inf, 4.0], 3: [nan], 4: [None]}
    data = sorted((i * 5 + u, u, v) for u, own in values.items() for i, v in enumerate(own))
    for a, b in zip([0, *cuts], [*cuts, len(data)]):
        events(spark, tmp_path, [(i, datetime(2024, 1, 1), u, v) for i, u, v in data[a:b]])
    got = drained(S.carried(S.stream(spark, str(tmp_path)), 30.0), f"odd{len(cuts)}", "append")
    with duckdb.connect() as con:
        con.sql(f"create view events as select * from '{tmp_path}/*.parquet'")
        told = con.sql(catalogue.ORACLE_SQL["stream_carried"]).fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, told))


def test_carried_without_ids_or_videos(spark, tmp_path):
    """Ids beyond 2^53 stay whole beside null ones; frames without an id come last, and none without a video is lost."""
    big = 2**53 + 1
    events(spark, tmp_path, [(big + 2 * i if i < 3 else None, datetime(2024, 1, 1), u, 10.0 * (i + 1)) for u in (1, big) for i in range(4)] + [(i, datetime(2024, 1, 1), None, 50.0 * i) for i in range(3)])
    got = drained(S.carried(S.stream(spark, str(tmp_path)), 30.0), "without", "append")
    want = [(u, big + 2 * i if i < 3 else None, 40.0 if i == 3 else 10.0) for u in (1, big) for i in range(4)] + [(None, i, 50.0 * i) for i in range(3)]
    assert sorted(repr((r.video, r.frame_id, r.carried)) for r in got) == sorted(map(repr, want))


def test_carried_whatever_the_arrow_batches(spark, tmp_path):
    """A video's frames are in several Arrow batches, each with frames of the whole range."""
    data = [(i, datetime(2024, 1, 1), i % 2, float(i * 7 % 50)) for i in range(60)]
    for k in range(4):
        events(spark, tmp_path, data[k::4])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        got = {r.frame_id: r.carried for r in drained(S.carried(S.stream(spark, str(tmp_path), 4), 30.0), "batches", "append")}
    finally:
        spark.conf.set(key, before)
    last, want = {}, {}
    for i, _, u, v in data:
        if u not in last or abs(v - last[u]) >= 30:
            last[u] = v
        want[i] = last[u]
    assert got == want
