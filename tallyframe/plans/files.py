"""Files, stores, pluggable models and streams: what is written is read again by the operators that users call."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import probability as P
from ..functions import text as X
from ..functions.probability import quantised
from ..operators import flow, labelling, matching, models, training
from ..operators import counting as C
from ..session import passing, shared_dir
from ..sources import images, labels, sinks
from ..sources.tables import detections, frames, mixtures, table
from ..streaming import frames as S
from .distributions import SQL as MIXTURES
from .ranking import _counts, _search, _uncertain
from .registry import query


def folder(spark: SparkSession, name: str) -> str:
    """A folder of the shared one that goes with the application."""
    path = shared_dir(spark, name)
    passing(spark, path)
    return f"{path}/files"


def _paths(of: Column) -> Column:
    return F.concat(F.lit("data/images/"), of.cast("string"), F.lit(".jpg"))


@query("select event_id as timestamp, cast(floor(value / 10) as integer) as count, 'data/images/' || event_id || '.jpg' as image_path from events")
def count_label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count labels, written as records and read."""
    path, f = folder(spark, "counts"), frames(spark, sf_dir)
    sinks.write_records(f.select(F.col("frame_id").alias("timestamp"), F.floor(F.col("value") / 10).cast("int").alias("count"), _paths(F.col("frame_id")).alias("image_path")), path)
    return labels.count_labels(spark, path)


@query("select vec_id as timestamp, floor((label + 4) / 20e0 * 1e3) / 1e3 as last, 4 as size, 'images/' || vec_id || '.jpg' as image_path from embeddings")
def uncertain_table_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distributions, written as records and read: the last number and how many there are."""
    path = folder(spark, "uncertain")
    prob = F.array(*(F.floor((F.col("label") + i) / 20.0 * 1e3) / 1e3 for i in range(1, 5)))
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("timestamp"), prob.alias("prob"), F.concat(F.lit("images/"), F.col("vec_id").cast("string"), F.lit(".jpg")).alias("image_path"))
    sinks.write_records(own, path)
    return labels.uncertain_table(spark, path).select("timestamp", "image_path", F.element_at("prob", -1).alias("last"), F.size("prob").alias("size"))


@query("select path, cast(split_part(split_part(path, '/', -1), '.', 1) as bigint) as frame_id from (select 'data/images/' || event_id || '.jpg' as path from events) order by length(path), path limit 1000")
def path_list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 1000 paths of a list, written and read."""
    path = folder(spark, "paths")
    sinks.write_path_list(table(spark, sf_dir, "events").select(_paths(F.col("event_id")).alias("path")), path)
    return labels.path_list(spark, path, 1000)


@query("select l_orderkey as frame_id, l_linenumber as class_id, count(*) as n, floor(sum(l_discount * 10) * 1e6 + 0.5) / 1e6 as conf from lineitem group by 1, 2")
def detection_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections as a text for each frame, parsed by the reader of such files."""
    d = detections(spark, sf_dir)
    rows = d.select("frame_id", F.col("order").alias("rank"), F.col("xc").alias("x1"), F.col("yc").alias("y1"), F.col("w").alias("x2"), F.col("h").alias("y2"), F.col("conf").alias("obj_conf"), F.lit(1.0).alias("cls_conf"), F.col("line").cast("double").alias("class_id"))
    texts = sinks.frame_texts(d.select("frame_id").distinct(), rows).select(F.concat(F.lit("labels/"), F.col("frame_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    found = labels.parsed_detections(texts)
    return found.groupBy("frame_id", "class_id").agg(F.count("*").alias("n"), quantised(F.sum("obj_conf")).alias("conf"))


@query("select l_orderkey as frame_id, 0 as class_id, count(*) as n, floor(sum(l_quantity / 50) * 1e6 + 0.5) / 1e6 as xc, floor(sum(l_quantity / 100) * 1e6 + 0.5) / 1e6 as h from lineitem where l_returnflag = 'R' group by 1")
def truth_box_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth boxes as a text for each frame that has any, parsed by the reader of such files."""
    d = detections(spark, sf_dir).filter("class_name = 'R'").withColumn("rank", F.col("order"))
    texts = sinks.truth_lines(d).select(F.concat(F.lit("labels/"), F.col("frame_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    return labels.parsed_truth(texts).groupBy("frame_id", "class_id").agg(F.count("*").alias("n"), quantised(F.sum("xc")).alias("xc"), quantised(F.sum("h")).alias("h"))


@query("select event_id as frame_id, event_type || case when event_id % 3 = 0 then ' again' else '' end as text from events")
def store_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed store in which every third frame is written again: the last text counts."""
    path, f = folder(spark, "store"), frames(spark, sf_dir)
    sinks.write_store(f.select("frame_id", F.col("class_name").alias("text")), path, 8)
    sinks.write_store(f.filter("frame_id % 3 = 0").select("frame_id", F.concat("class_name", F.lit(" again")).alias("text")), path, 8)
    return sinks.store(spark, path)


@query("select floor((1 + max(value)) * 1e6 + 0.5) / 1e6 as baseline, floor((1 + min(value)) * 1e6 + 0.5) / 1e6 as ours from events group by user_id")
def timing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of inference by video, written as nested records and read."""
    path, f = folder(spark, "timings"), frames(spark, sf_dir)
    sinks.write_records(f.groupBy("video").agg(F.struct((1 + F.max("value")).alias("inference")).alias("baseline"), F.struct((1 + F.min("value")).alias("inference")).alias("ours")), path)
    return labels.timings(spark, path).select(quantised(F.col("baseline")).alias("baseline"), quantised(F.col("ours")).alias("ours"))


@query("select vec_id as frame_id, cast(case when label >= 5 then 2 else 0 end as bigint) as label, 64 as cells from embeddings")
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with their density map and count of truth boxes."""
    e = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "frame_id")
    truth = e.filter("label >= 5").select("frame_id", F.explode(F.array(F.lit(0.25), F.lit(0.75))).alias("xc"))
    rows = images.training_rows(e.select("frame_id"), truth, e.select("frame_id", F.col("embedding").alias("density")))
    return rows.select("frame_id", F.col("label").cast("long").alias("label"), F.size("density").alias("cells"))


@query("select vec_id as frame_id, (list_position(embedding[1:10], list_max(embedding[1:10])) - 1)::integer as class_id, floor(cast(list_max(embedding[1:10]) as double) * 1e6 + 0.5) / 1e6 as score from embeddings")
def best_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of the largest of ten scores."""
    score, place = matching.best_class(F.slice("embedding", 1, 10))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), place.alias("class_id"), quantised(score.cast("double")).alias("score"))


@query(f"""{MIXTURES}
run as (select frame_id, i, mu, sigma, sum(pi) over (partition by frame_id order by i) as upto, (frame_id * 37 % 100) / 100e0 as u, (frame_id % 7 - 3) / 2e0 as z from parts)
select frame_id, floor(coalesce(arg_min(mu + sigma * z, i) filter (upto >= u), arg_max(mu + sigma * z, i)) * 1e6 + 0.5) / 1e6 as draw from run group by 1""")
def mixture_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draw of each mixture for given uniform and normal numbers."""
    u, z = (F.col("frame_id") * 37 % 100) / 100.0, (F.col("frame_id") % 7 - 3) / 2.0
    return mixtures(spark, sf_dir).select("frame_id", quantised(P.mixture_draw(F.col("parts"), u, z)).alias("draw"))


@query("""
with x as (select vec_id as frame_id, cast(embedding[1] as double) as a, cast(embedding[2] as double) as b from embeddings),
h as (select frame_id, exp(a) / (exp(a) + exp(b + 0.5)) as p, exp(0.1 * a) as s1, exp(0.2 * b - 1) as s2, 2 * a + 3 as m1, a - b as m2 from x)
select frame_id, floor((p * m1 + (1 - p) * m2) * 1e6 + 0.5) / 1e6 as mean, floor(greatest(m1 + 4.2645878e0 * s1, m2 + 4.2645878e0 * s2) * 1e6 + 0.5) / 1e6 as bound from h""")
def mixture_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixtures of two parts from features by linear heads: mean and bound."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), F.transform(F.slice("embedding", 1, 2), lambda v: v.cast("double")).alias("x"))
    parts = P.mixture_head(F.col("x"), ([[1.0, 0.0], [0.0, 1.0]], [0.0, 0.5]), ([[0.1, 0.0], [0.0, 0.2]], [0.0, -1.0]), ([[2.0, 0.0], [1.0, -1.0]], [3.0, 0.0]))
    return e.select("frame_id", F.explode(F.array(parts)).alias("parts")).select("frame_id", quantised(P.mixture_mean(F.col("parts"))).alias("mean"), quantised(P.mixture_bound(F.col("parts"))).alias("bound"))


@query("select count(distinct event_id) as n from events")
def dense_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many frames are numbered without a hole."""
    f = frames(spark, sf_dir)
    first = f.agg(F.min("frame_id")).first()[0]
    return spark.range(1).select(F.lit(C.require_dense(f, first=first)).cast("long").alias("n"))


@query("select event_id as timestamp, cast(floor(value / 25) as integer) as count, 'data/images/' || event_id || '.jpg' as image_path from events")
def detector_count_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count labels from a detector, called for batches of images: it sees a box, twice, for each 25 of a frame's value."""

    def load():
        return lambda found: [[(50.0 * i, 0.0, 50.0 * i + 20, 20.0, 0.9 - d / 10, 1.0, 2) for i in range(int(float(x) // 25)) for d in range(2)] for x in found]

    f = frames(spark, sf_dir).select("frame_id", F.col("value").cast("string").cast("binary").alias("content"), _paths(F.col("frame_id")).alias("path"))
    return labelling.count_labels(f, labelling.detections(f, load), 2)


@query("select event_id as frame_id, floor((0.25 * value + 0.75 * (value + 2)) * 1e6 + 0.5) / 1e6 as mean from events")
def estimator_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the mixtures that an estimator, called for batches of images, gives."""

    def load():
        def run(found):
            v = np.array([[float(x)] for x in found])
            return np.tile([0.25, 0.75], (len(v), 1)), np.hstack([v, v + 2]), np.ones((len(v), 2))

        return run

    f = frames(spark, sf_dir).select("frame_id", F.col("value").cast("string").cast("binary").alias("content"))
    own = models.estimate(f, load)
    return own.select("frame_id", quantised(P.mixture_mean(P.mixture(F.col("pi"), F.col("mu"), F.col("sigma")))).alias("mean"))


@query(f"""{_search(10, 0.9, 0, 16)},
w as (select * from s order by rounds desc limit 1), e as (select list(cast(n as double) order by n desc, frame_id)[1:10] as exact from u),
m as (select (select count(*) from (select unnest(list_transform(best, lambda x: x.v)) intersect all select unnest(exact))) / 10e0 as precision,
  list_sum(list_transform(range(1, 11), lambda i: abs(best[i].v - exact[i]))) / 10e0 as score_error, rounds, len(seen) as seen, conf from w, e)
select precision, precision as recall, score_error, rounds as n_rounds, seen as n_confirmed, floor(conf * 1e6 + 0.5) / 1e6 as confidence from m""")
def evaluate_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measures of a probabilistic top-k against the truth."""
    distributions, counts = _uncertain(spark, sf_dir)
    asked = flow.Query(k=10, confidence=0.9, batch=16)
    out = flow.answer(distributions, models.table_confirmer(counts), asked)
    return flow.judge(spark, out, _counts(spark, sf_dir), asked).withColumn("confidence", quantised(F.col("confidence")))


@query("select vec_id as frame_id, row as r, floor(list_sum(list_transform(embedding[row * 16 + 1:row * 16 + 16], lambda x: cast(x as double))) * 1e6 + 0.5) / 1e6 as total from embeddings, unnest(range(0, 4)) as t(row)")
def reshaped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as rows of 16 numbers."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), F.posexplode(P.reshaped(F.transform("embedding", lambda v: v.cast("double")), 16)).alias("r", "values"))
    return e.select("frame_id", F.col("r").cast("long").alias("r"), quantised(P.total(F.col("values"))).alias("total"))


@query(f"""{MIXTURES} grid as (select unnest(range(0, 9)) * 2.5e0 as x)
select frame_id, x, floor(sum(pi * exp(-0.5 * power((x - mu) / sigma, 2)) / (sigma * sqrt(2 * pi()))) * 1e6 + 0.5) / 1e6 as density from parts, grid group by 1, 2""")
def density_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixture densities at nine points from 0 to 20."""
    points = mixtures(spark, sf_dir).select("frame_id", "parts", F.explode(P.linspace(0, 20, 9)).alias("x"))
    return points.select("frame_id", "x", quantised(P.mixture_pdf(F.col("parts"), F.col("x"))).alias("density"))


@query("select split_part(split_part(p, '/', -1), '.', 1) as name, count(*) as n from (select unnest(list_concat(list(path) filter (k = 0), list(path) filter (k = 1))) as p from (select 'v/' || event_type || '.jpg' as path, event_id % 2 as k from events)) group by 1")
def joined_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of two batches, each a table with lists of them, as one."""
    own = frames(spark, sf_dir).select(F.concat(F.lit("v/"), "class_name", F.lit(".jpg")).alias("path"), (F.col("frame_id") % 2).alias("k"), "video")
    lists = lambda k: own.filter(F.col("k") == k).groupBy("video").agg(F.collect_list("path").alias("paths"))
    every = lists(0).unionByName(lists(1)).select(F.explode("paths").alias("path"))
    return every.groupBy(F.substring_index(X.basename(F.col("path")), ".", 1).alias("name")).agg(F.count("*").alias("n"))


@query("select event_id as frame_id, cast(floor(value / 50) as bigint) as n from events where value >= 50 order by md5(event_id || ':3'), event_id limit 40")
def sampled_box_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised boxes of 40 frames at random that show the class, by frame."""
    f = frames(spark, sf_dir).filter("value >= 50").select("frame_id", F.explode(F.sequence(F.lit(1), F.floor(F.col("value") / 50).cast("int"))).alias("i"))
    found = f.select("frame_id", (F.col("i") * 30.0).alias("x1"), F.lit(0.0).alias("y1"), (F.col("i") * 30.0 + 20).alias("x2"), F.lit(10.0).alias("y2"), F.lit(0.9).alias("obj_conf"), F.lit(0).alias("class_id"))
    return labelling.box_labels(found, 0, 640, 480, 40, 3).groupBy("frame_id").agg(F.count("*").alias("n"))


@query("select time_bucket(interval '1 hour', ts) as start, event_type as class_name, count(*) as n from events group by 1, 2")
def stream_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windowed counts of a stream of event files, drained."""
    source, out = folder(spark, "stream"), folder(spark, "hours")
    table(spark, sf_dir, "events").write.parquet(source)
    counts = S.windowed_counts(S.stream(spark, source)).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "class_name", "n")
    S.drained(counts, out, "complete")
    return spark.read.parquet(out)


@query("""
with recursive o as (select user_id as video, event_id as frame_id, value, row_number() over (partition by user_id order by event_id) as i from events),
r as (
  select video, frame_id, value, i, value as carried from o where i = 1
  union all
  select o.video, o.frame_id, o.value, o.i, case when abs(o.value - carried) >= 30 then o.value else carried end from r join o on o.video = r.video and o.i = r.i + 1
)
select frame_id, video, value, carried from r""")
def stream_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of key frames carried over like ones, by a stream with state for each video.

    All files are one micro-batch: those of one write have no order, however many there are.
    """
    source, out = folder(spark, "stream"), folder(spark, "carried")
    table(spark, sf_dir, "events").write.parquet(source)
    S.drained(S.carried(S.stream(spark, source, None), 30.0), out, "append")
    return spark.read.parquet(out).drop("batch")


_ANCHORS = [(1.0, 2.0), (3.0, 1.5), (4.0, 4.0)]
_TRUTH = """
with b as (select l_orderkey as frame_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as rank, l_linenumber % 3 as class_id,
  least(l_quantity / 51, 0.99) * 8 as gx, l_tax / 0.081 * 8 as gy, l_linenumber / 1e1 * 8 as gw, l_quantity / 100 * 8 as gh from lineitem),
a(anchor, aw, ah) as (values (0, 1e0, 2e0), (1, 3e0, 1.5e0), (2, 4e0, 4e0)),
o as (select b.*, anchor, aw, ah, least(aw, gw) * least(ah, gh) / (aw * ah + 1e-16 + gw * gh - least(aw, gw) * least(ah, gh)) as iou from b, a),
m as (select *, row_number() over (partition by frame_id, rank order by iou desc, anchor) as nth, cast(floor(gx) as integer) as cell_x, cast(floor(gy) as integer) as cell_y from o),
t as (select * from (select *, row_number() over (partition by frame_id, anchor, cell_x, cell_y order by rank desc) as last from m where nth = 1) where last = 1)
"""


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    rank = F.row_number().over(W.partitionBy("frame_id").orderBy("order"))
    return d.select("frame_id", rank.alias("rank"), (F.col("line") % 3).alias("class_id"), F.least(F.col("xc") * 50 / 51, F.lit(0.99)).alias("xc"), (F.col("yc") * 0.08 / 0.081).alias("yc"), "w", "h")


@query(_TRUTH + "select frame_id, anchor, cell_x, cell_y, class_id, floor((gx - floor(gx)) * 1e5 + 0.5) / 1e5 as tx, floor((gy - floor(gy)) * 1e5 + 0.5) / 1e5 as ty, floor(ln(gw / aw + 1e-16) * 1e5 + 0.5) / 1e5 as tw, floor(ln(gh / ah + 1e-16) * 1e5 + 0.5) / 1e5 as th from t")
def anchor_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors and cells of boxes on a grid of 8."""
    out = training.assigned(_truth(spark, sf_dir), _ANCHORS, 8)
    return out.select("frame_id", "anchor", "cell_x", "cell_y", "class_id", *((F.floor(F.col(c) * 1e5 + 0.5).cast("double") / 1e5).alias(c) for c in ("tx", "ty", "tw", "th")))


@query(_TRUTH + "select distinct frame_id, anchor, cell_x, cell_y from m where nth = 1 or iou > 0.5")
def anchor_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places that don't count as empty."""
    return training.ignored(_truth(spark, sf_dir), _ANCHORS, 8, 0.5)


@query("""
with p as (select event_id as frame_id, row_number() over (order by event_id) - 1 as pos from events)
select frame_id, pos // 8 as batch, pos % 8 as sample, cast(320 + 32 * (cast('0x' || substr(md5((pos // 8 // 10) || ':5'), 1, 8) as bigint) % 7) as integer) as side,
  cast('0x' || substr(md5(frame_id || ':6'), 1, 8) as bigint) % 2 = 1 as flipped from p""")
def training_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 8 frames, their image sizes, and which frames are mirrored."""
    return training.batches(frames(spark, sf_dir), 8, 5)
