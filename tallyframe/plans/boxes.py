"""Box geometry, matching and suppression over detections made from line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.probability import quantised
from ..operators import density, matching
from ..sources.tables import detections
from .registry import query

#: The boxes as SQL, with a number for each detection of a frame.
SQL = """
with d as (select l_orderkey as frame_id, l_linestatus as status, l_discount * 10 as conf, l_linenumber as line, l_quantity / 50 as xc, l_tax / 0.08 as yc,
  l_linenumber / 1e1 as w, l_quantity / 100 as h,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as rank from lineitem),
b as (select frame_id, status, conf, line, rank, xc, yc, w, h, xc - w / 2 as x1, yc - h / 2 as y1, xc + w / 2 as x2, yc + h / 2 as y2 from d)
"""
_PAIRS = """
select p.frame_id, p.rank as pred, t.rank as truth, floor({measure} * 1e6 + 0.5) / 1e6 as iou
from b p join b t using (frame_id) where p.status = 'F' and t.status = 'O'
"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with a rank in their frame and corners."""
    rank = F.row_number().over(W.partitionBy("frame_id").orderBy("order")).cast("long")
    d = detections(spark, sf_dir).withColumn("rank", rank)
    c = G.corners(F.col("xc"), F.col("yc"), F.col("w"), F.col("h"))
    return d.select("frame_id", "class_name", "status", "conf", "line", "rank", "xc", "yc", "w", "h", *(v.alias(n) for n, v in zip(matching.BOX, c, strict=True)))


def _box(df_prefix: str = "") -> G.Corners:
    return G.Corners(*(F.col(f"{df_prefix}{c}") for c in matching.BOX))


def _rounded(box: G.Corners):
    return [quantised(v).alias(n) for n, v in zip(matching.BOX, box, strict=True)]


def _q(*values: str) -> str:
    return ", ".join(f"floor(({v}) * 1e6 + 0.5) / 1e6 as {n}" for n, v in zip(matching.BOX, values, strict=True))


@query(f"{SQL} select frame_id, rank, {_q('x1', 'y1', 'x2', 'y2')} from b")
def box_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).select("frame_id", "rank", *_rounded(_box()))


@query(f"{SQL} select frame_id, rank, {_q('x1 / 640e0', 'y1 / 480e0', 'x2 / 640e0', 'y2 / 480e0')} from b")
def box_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).select("frame_id", "rank", *_rounded(G.normalised(_box(), F.lit(640.0), F.lit(480.0))))


@query(f"{SQL} select frame_id, rank, {_q('x1 * 416 / 416e0 * 640', '(y1 * 416 - 52) / 312e0 * 480', 'x2 * 416 / 416e0 * 640', '(y2 * 416 - 52) / 312e0 * 480')} from b")
def box_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the pixels of a padded 416 square to those of a 640 x 480 image."""
    pixels = G.denormalised(_box(), F.lit(416.0), F.lit(416.0))
    return boxes(spark, sf_dir).select("frame_id", "rank", *_rounded(G.rescaled(pixels, 416, 640, 480)))


_INTER = "(greatest(least(p.x2, t.x2) - greatest(p.x1, t.x1), 0e0) * greatest(least(p.y2, t.y2) - greatest(p.y1, t.y1), 0e0))"
_PLAIN = f"({_INTER} / nullif((p.x2 - p.x1) * (p.y2 - p.y1) + (t.x2 - t.x1) * (t.y2 - t.y1) - {_INTER}, 0))"
_INTER1 = "(greatest(least(p.x2, t.x2) - greatest(p.x1, t.x1) + 1e0, 0e0) * greatest(least(p.y2, t.y2) - greatest(p.y1, t.y1) + 1e0, 0e0))"
_PIXELS = f"({_INTER1} / ((p.x2 - p.x1 + 1e0) * (p.y2 - p.y1 + 1e0) + (t.x2 - t.x1 + 1e0) * (t.y2 - t.y1 + 1e0) - {_INTER1} + 1e-16))"
_SIZES = "(least(p.w, t.w) * least(p.h, t.h) / (p.w * p.h + 1e-16 + t.w * t.h - least(p.w, t.w) * least(p.h, t.h)))"


def _pairs(spark: SparkSession, sf_dir: str, measure) -> DataFrame:
    b = boxes(spark, sf_dir)
    out = matching.pairs(b.filter("status = 'F'"), b.filter("status = 'O'"), measure)
    return out.withColumn("iou", quantised(F.col("iou")))


@query(SQL + _PAIRS.format(measure=_PLAIN))
def iou_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, G.iou)


@query(SQL + _PAIRS.format(measure=_PIXELS))
def iou_plus_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, G.iou_pixels)


@query(SQL + _PAIRS.format(measure=_SIZES))
def iou_wh(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    side = lambda s, n, k: b.filter(f"status = '{s}'").select("frame_id", F.col("rank").alias(n), F.col("w").alias(f"{k}w"), F.col("h").alias(f"{k}h"))
    met = side("F", "pred", "p").join(side("O", "truth", "t"), "frame_id")
    return met.select("frame_id", "pred", "truth", quantised(G.iou_sizes(F.col("pw"), F.col("ph"), F.col("tw"), F.col("th"))).alias("iou"))


@query(f"select * from ({SQL} {_PAIRS.format(measure=_PLAIN)}) where iou >= 0.5")
def iou_pairs_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iou_plain(spark, sf_dir).filter("iou >= 0.5")


@query(f"""{SQL.replace("with d", "with recursive d", 1)},
p as (select *, row_number() over (partition by frame_id order by conf desc, rank) as i from b where status = 'F'),
c as (select p.frame_id, i, p.rank, p.conf, coalesce(list(t.rank order by {_PLAIN} desc, t.rank desc) filter (t.rank is not null and {_PLAIN} >= 0.5), []) as able
  from p left join b t on p.frame_id = t.frame_id and t.status = 'O' group by 1, 2, 3, 4),
g(frame_id, i, rank, prob, taken, pick) as (
  select distinct frame_id, cast(0 as bigint), cast(0 as bigint), 0e0, cast([] as bigint[]), cast(null as bigint) from p
  union all
  select frame_id, i, rank, conf, case when pick is null then taken else list_append(taken, pick) end, pick
  from (select c.frame_id, c.i, c.rank, c.conf, taken, list_filter(able, lambda x: not list_contains(taken, x))[1] as pick from g join c on c.frame_id = g.frame_id and c.i = g.i + 1)
)
select frame_id, rank, prob, case when pick is null then 0 else 1 end as matched from g where i > 0
""")
def box_match_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    return matching.match_boxes(b.filter("status = 'F'").withColumn("prob", F.col("conf")), b.filter("status = 'O'"), 0.5)


_LIKE = _PIXELS.replace("x1", "x1 * 416").replace("x2", "x2 * 416").replace("y1", "y1 * 416").replace("y2", "y2 * 416")


@query(f"""{SQL.replace("with d", "with recursive d", 1)},
e as (select *, row_number() over (partition by frame_id order by conf desc, rank) as i from b where conf >= 0.3),
a as (select p.frame_id, p.i, list(t.i order by t.i) filter (p.i = t.i or p.line % 3 = t.line % 3 and {_LIKE} > 0.4) as own from e p join e t using (frame_id) group by 1, 2),
f as (select frame_id, list(own order by i) as owns from a group by 1),
g(frame_id, owns, rest, head, members) as (
  select frame_id, owns, range(1, len(owns) + 1), cast(0 as bigint), cast([] as bigint[]) from f
  union all
  select frame_id, owns, list_filter(rest, lambda x: not list_contains(owns[rest[1]], x)), rest[1], list_filter(rest, lambda x: list_contains(owns[rest[1]], x)) from g where len(rest) > 0
),
m as (select frame_id, head, unnest(members) as i from g where head > 0)
select m.frame_id, {", ".join(f"floor(sum(e.conf * e.{c} * 416) / sum(e.conf) * 1e4 + 0.5) / 1e4 as {c}" for c in matching.BOX)},
  any_value(h.conf) as obj_conf, 1e0 as cls_conf, any_value(h.line % 3) as class_id
from m join e on e.frame_id = m.frame_id and e.i = m.i join e h on h.frame_id = m.frame_id and h.i = m.head group by m.frame_id, m.head
""")
def nms_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).select("frame_id", "rank", *(F.col(c) * 416 for c in matching.BOX), F.col("conf").alias("obj_conf"), F.lit(1.0).alias("cls_conf"), (F.col("line") % 3).cast("int").alias("class_id"))
    named = b.toDF("frame_id", "rank", *matching.BOX, "obj_conf", "cls_conf", "class_id")
    out = matching.non_max_suppression(named, 0.3, 0.4)
    return out.select("frame_id", *((F.floor(F.col(c) * 1e4 + 0.5).cast("double") / 1e4).alias(c) for c in matching.BOX), "obj_conf", "cls_conf", "class_id")


@query(f"""{SQL},
n as (select frame_id, p.rank, {_PIXELS} as v, t.rank as other from b p join b t using (frame_id) where p.status = 'F' and t.status = 'O'),
m as (select frame_id, rank, max(v) as v, min(other) filter (v = top) as best from (select *, max(v) over (partition by frame_id, rank) as top from n) group by 1, 2),
k as (select m.frame_id, m.rank, row_number() over (partition by m.frame_id, best order by m.rank) as turn from m join b using (frame_id, rank)
  where v >= 0.5 and exists (select 1 from b t where t.frame_id = m.frame_id and t.status = 'O' and t.line % 3 = b.line % 3))
select b.frame_id, b.rank, b.conf as score, b.line % 3 as class_id, coalesce(cast(turn = 1 as integer), 0) as tp from b left join k using (frame_id, rank) where b.status = 'F'
""")
def true_positive_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).withColumn("class_id", (F.col("line") % 3).cast("int")).withColumn("score", F.col("conf"))
    return matching.true_positives(b.filter("status = 'F'"), b.filter("status = 'O'"), 0.5)


@query(f"""{SQL}
select frame_id, rank, floor((1 / (1 + exp(-xc)) + line) * 32 * 1e6 + 0.5) / 1e6 as px, floor((1 / (1 + exp(-yc)) + line) * 32 * 1e6 + 0.5) / 1e6 as py,
floor(exp(w) * 116 * 1e6 + 0.5) / 1e6 as pw, floor(exp(h) * 90 * 1e6 + 0.5) / 1e6 as ph from b""")
def grid_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw grid predictions to pixels, on a grid of 32 pixels with one anchor."""
    line = F.col("line").cast("double")
    out = G.grid_box(F.col("xc"), F.col("yc"), F.col("w"), F.col("h"), line, line, F.lit(116.0), F.lit(90.0), F.lit(32.0))
    return boxes(spark, sf_dir).select("frame_id", "rank", *(quantised(v).alias(n) for n, v in zip(("px", "py", "pw", "ph"), out, strict=True)))


@query("""
with w as (select k, exp(-0.5 * (k / 2e0) * (k / 2e0)) as v from unnest(range(-8, 9)) as t(k)),
n as (select k, v / (select sum(v) from w) as v from w),
b as (select l_orderkey as frame_id, cast(trunc(l_quantity / 50 * 40) as bigint) as x, cast(trunc(l_tax / 0.08 * 30) as bigint) as y from lineitem where l_returnflag = 'R'),
c as (select distinct frame_id, x, y from b where x between 0 and 39 and y between 0 and 29),
s as (select c.frame_id, (select sum(v) from n where c.x + k between 0 and 39) * (select sum(v) from n where c.y + k between 0 and 29) as part from c)
select f.frame_id, 1200 as cells, floor(coalesce(sum(part), 0) * 1e6 + 0.5) / 1e6 as total from (select distinct frame_id from b) f left join s on f.frame_id = s.frame_id group by 1
""")
def density_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the density maps of frames with detections of class R sum to, and their cells' number."""
    b = boxes(spark, sf_dir).filter("class_name = 'R'").select("frame_id", "xc", "yc")
    maps = density.density_maps(b, 30, 40, 2.0, "double")
    return maps.select("frame_id", F.size("density").alias("cells"), quantised(F.aggregate("density", F.lit(0.0), lambda s, v: s + v)).alias("total"))
