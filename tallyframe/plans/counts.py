"""Scans, projections, counts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.probability import quantised
from ..operators import counting as C
from ..operators import splits
from ..operators.topk import top_per_group
from ..sources import labels
from ..sources.sinks import frame_texts
from ..sources.tables import detections, frames, mixtures, table
from .registry import query

#: The event classes, by id.
CLASSES = ["click", "error", "purchase", "signup", "view"]


@query("select count(*) as n from lineitem where l_returnflag = 'R'")
def class_count_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.class_total(detections(spark, sf_dir), "R")


@query("""
select cast(r.frame_id as bigint) as frame_id, coalesce(n, 0) as n
from (select unnest(range((select min(l_orderkey) from lineitem), (select max(l_orderkey) from lineitem) + 1)) as frame_id) r
left join (select l_orderkey as frame_id, count(*) filter (l_returnflag = 'R') as n from lineitem group by 1) c using (frame_id)
""")
def frame_class_count_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dense(C.frame_counts(detections(spark, sf_dir), "R"))


@query("""
select cast(frame_id as bigint) as frame_id from
(select unnest(range((select min(l_orderkey) from lineitem), (select max(l_orderkey) from lineitem) + 1)) as frame_id
 except select l_orderkey from lineitem)
""")
def missing_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.missing(detections(spark, sf_dir))


@query("select max(l_orderkey) - min(l_orderkey) + 1 - count(distinct l_orderkey) as n_missing from lineitem")
def missing_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.missing_count(detections(spark, sf_dir))


@query("""
select f as after, nxt as before, nxt - f - 1 as n
from (select f, lead(f) over (order by f) as nxt from (select distinct l_orderkey as f from lineitem)) where nxt - f > 1
""")
def frame_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.gaps(detections(spark, sf_dir))


@query("""
select path, cast(split_part(split_part(path, '/', -1), '.', 1) as bigint) as frame_id
from (select 'data/images/' || event_id || '.jpg' as path from events) order by length(path), path limit 1000
""")
def natural_order_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "events").select(F.concat(F.lit("data/images/"), F.col("event_id").cast("string"), F.lit(".jpg")).alias("path"))
    return paths.orderBy(*X.natural(F.col("path"))).limit(1000).select("path", X.frame_id(F.col("path")).alias("frame_id"))


@query("""
select event_id as frame_id, 'data/labels/' || event_id || '.txt' as label_path, 'data/density/' || event_id || '.npy' as density_path, event_id % 3 <> 2 as is_image
from events
""")
def path_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "events").select("event_id")
    path = F.concat(F.lit("data/images/"), F.col("event_id").cast("string"), F.lit(".jpg"))
    name = F.concat(F.col("event_id").cast("string"), F.element_at(F.array(F.lit(".JPG"), F.lit(".jpeg"), F.lit(".png")), (F.col("event_id") % 3 + 1).cast("int")))
    return ids.select(X.frame_id(path).alias("frame_id"), X.sibling(path, "labels", "txt").alias("label_path"), X.sibling(path, "density", "npy").alias("density_path"), X.is_image(name).alias("is_image"))


@query("select l_linenumber as class_id, count(*) as n from lineitem group by 1")
def label_text_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections written as lines of text for each frame, read again and counted by the class that ends a line."""
    d = detections(spark, sf_dir)
    rows = d.select("frame_id", F.col("order").alias("rank"), F.col("xc").alias("x1"), F.col("yc").alias("y1"), F.col("w").alias("x2"), F.col("h").alias("y2"), F.col("conf").alias("obj_conf"), F.lit(1.0).alias("cls_conf"), F.col("line").cast("double").alias("class_id"))
    texts = frame_texts(d.select("frame_id").distinct(), rows)
    lines = texts.select(F.explode(X.lines(F.col("text"))).alias("line"))
    return lines.groupBy(X.last_class(F.col("line")).alias("class_id")).agg(F.count("*").alias("n"))


@query("""
select doc_id, count(*) filter (trim(line, ' ') <> '') as n_lines from
(select doc_id, unnest(string_split(text, chr(10))) as line from documents) group by 1
""")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.lines(F.col("text"))).cast("long").alias("n_lines"))


@query("""
with c(class_id, class_name) as (values (0, 'click'), (1, 'error'), (2, 'purchase'), (3, 'signup'), (4, 'view'))
select class_id, class_name, count(event_id) as n from c left join events on event_type = class_name group by 1, 2
""")
def class_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = labels.class_table(spark, CLASSES)
    n = frames(spark, sf_dir).groupBy("class_name").agg(F.count("*").alias("n"))
    return names.join(n, "class_name", "left").select("class_id", "class_name", F.coalesce("n", F.lit(0)).alias("n"))


@query("select l_returnflag as class_name, count(*) as n from lineitem where l_discount * 10 >= 0.5 group by 1")
def detection_conf_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).filter("conf >= 0.5").groupBy("class_name").agg(F.count("*").alias("n"))


@query("select label, floor(1e2 / n / sum(1e0 / n) over () * 1e6 + 0.5) / 1e6 as weight from (select label, count(*) as n from embeddings group by 1)")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.class_weights(table(spark, sf_dir, "embeddings"), F.col("label")).select("label", quantised(F.col("weight")).alias("weight"))


@query("""
with px as (select vec_id, (i - 1) // 16 as channel, cast(embedding[i] as double) as v from embeddings, unnest(range(1, 65)) as t(i)),
each as (select vec_id, channel, avg(v) as m, stddev_samp(v) as s from px group by 1, 2)
select cast(channel as integer) as channel, floor(avg(m) * 1e6 + 0.5) / 1e6 as mean, floor(avg(s) * 1e6 + 0.5) / 1e6 as std from each group by 1
""")
def channel_normalizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    out = C.channel_statistics(e, F.array(*(F.slice("e", 16 * i + 1, 16) for i in range(4))))
    return out.select("channel", quantised(F.col("mean")).alias("mean"), quantised(F.col("std")).alias("std"))


@query("""
select frame_id, n from (select event_type, event_id as frame_id, value as n, row_number() over (partition by event_type order by value desc, event_id) as rn from events)
where event_type = 'click' and rn <= 10
""")
def top_values_of_a_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_per_group(frames(spark, sf_dir), ["class_name"], [F.desc("value"), F.asc("frame_id")], 10).filter("class_name = 'click'").select("frame_id", F.col("value").alias("n"))


@query("""
with t as (select event_id as timestamp, cast(floor(value / 10) as integer) as count, 'images/' || event_id || '.jpg' as image_path from events)
select timestamp, count, image_path from t
""")
def json_labels_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir).select(F.col("frame_id").alias("timestamp"), F.floor(F.col("value") / 10).cast("int").alias("count"), F.concat(F.lit("images/"), F.col("frame_id").cast("string"), F.lit(".jpg")).alias("image_path"))
    texts = rows.select(F.to_json(F.struct("*")).alias("j"))
    return texts.select(F.from_json("j", labels.COUNTS).alias("r")).select("r.*")


@query("select event_id as frame_id, cast(json_extract(props, '$.k') as integer) as k from events")
def json_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("frame_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


def _split_sql(hour: str) -> str:
    return f"""
    with n as (select count(*) as n, cast({hour} as bigint) as hour from events),
    p as (select event_id as frame_id, row_number() over (order by event_id) - 1 as pos from events)
    select frame_id, pos, part from (select frame_id, pos, case
      when n >= 72 * hour then case when pos < 24 * hour then 'train' when pos < 48 * hour then 'val' when pos < 72 * hour then 'test' end
      when n >= 48 * hour then case when pos < 24 * hour then 'train' when pos < n - 24 * hour then 'val' else 'test' end
      when n >= 3 * hour then case when pos < hour then 'train' when pos < 2 * hour then 'val' else 'test' end
      else case when pos < n // 3 then 'train' when pos < 2 * (n // 3) then 'val' else 'test' end end as part
      from p, n) where part is not null
    """


def _split(spark: SparkSession, sf_dir: str, share: int) -> DataFrame:
    f = frames(spark, sf_dir).select("frame_id")
    return splits.split(f, max(1, f.count() // share)).select("frame_id", "pos", "part")


@query(_split_sql("greatest(1, count(*) // 75)"))
def dataset_split_days3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir, 75)


@query(_split_sql("greatest(1, count(*) // 55)"))
def dataset_split_days2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir, 55)


@query(_split_sql("greatest(1, count(*) // 10)"))
def dataset_split_hours3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir, 10)


@query(_split_sql("greatest(1, count(*) // 1)"))
def dataset_split_thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir, 1)


@query("select event_id as frame_id, value from events where event_type = 'click' order by md5(event_id || ':11'), event_id limit 500")
def random_frame_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 frames with a click, the same for a seed."""
    return splits.sample(frames(spark, sf_dir), 500, 11, F.col("class_name") == "click").select("frame_id", "value")


@query("""
select event_id as frame_id, cast(floor(event_id / 3e1 / 86400) as bigint) as days, cast(floor(event_id / 3e1) - 86400 * floor(event_id / 3e1 / 86400) as bigint) as seconds,
cast(floor((event_id / 3e1 - floor(event_id / 3e1)) * 1e6 + 0.5) as bigint) as micros from (select event_id * 1000 as event_id from events)
""")
def frame_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time from a video's start at 30 frames a second, in days, seconds and microseconds."""
    at = F.col("frame_id") / F.lit(30.0)
    days, seconds, micros = X.elapsed_parts(at)
    own = frames(spark, sf_dir).select((F.col("frame_id") * 1000).alias("frame_id"))
    return own.select("frame_id", days.alias("days"), seconds.alias("seconds"), micros.alias("micros"))


@query("select vec_id as frame_id, label from embeddings join (select distinct event_id from events) e on vec_id = event_id")
def frames_with_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images joined to their labels by frame id."""
    return mixtures(spark, sf_dir).select("frame_id", "label").join(frames(spark, sf_dir).select("frame_id"), "frame_id", "left_semi")
