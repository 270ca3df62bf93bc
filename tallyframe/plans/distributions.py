"""Count distributions: mixtures, sums of independent detections, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import probability as P
from ..functions.probability import quantised
from ..operators import calibration
from ..operators import counting as C
from ..operators import uncertain as U
from ..sources.tables import detections, mixtures
from .registry import query

#: Mixtures as SQL: a row for each part.
SQL = """
with v as (select vec_id as frame_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
m as (select frame_id, label, i, exp(e[i] - list_max(e[1:20])) as raw, exp(e[20 + i]) as sigma, 5 + 10 * e[40 + i] as mu from v, unnest(range(1, 21)) as t(i)),
s as (select frame_id, sum(raw) as whole from m group by 1),
parts as (select m.frame_id, label, i, raw / whole as pi, mu, sigma from m join s on m.frame_id = s.frame_id),
"""
#: The normal CDF of z by its series, z to the n over the product of the odd numbers up to n, and far out by its limits.
PHI = """(case when z < -6.5 then 0e0 when z > 6.5 then 1e0 else 0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * sign(z)
  * list_sum(list_transform(range(0, 70), lambda n: exp((2 * n + 1) * ln(greatest(abs(z), 1e-300)) - (n + 1) * ln(2) - lgamma(n + 1.5) + 0.5 * ln(pi())))) end)"""
CDF = f"""
top as (select cast(ceil(max(mu + 4.2645878e0 * sigma)) as bigint) as c from parts),
grid as (select unnest(range(0, c + 1)) as c from top),
terms as (select frame_id, label, pi, c, (c - mu) / sigma as z from parts, grid),
cdf as (select frame_id, label, c, sum(pi * {PHI}) as f from terms group by 1, 2, 3)
"""


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id and cdf from mixtures."""
    return U.from_mixtures(mixtures(spark, sf_dir), F.col("parts"))


@query(f"{SQL} mean as (select frame_id, sum(pi * mu) as m from parts group by 1) select frame_id, floor(m * 1e6 + 0.5) / 1e6 as mean from mean")
def mixture_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixtures(spark, sf_dir).select("frame_id", quantised(P.mixture_mean(F.col("parts"))).alias("mean"))


@query(f"{SQL} mean as (select frame_id, label, sum(pi * mu) as m from parts group by 1, 2) select avg(case when round_even(m, 0) = label then 1e0 else 0e0 end) as accuracy from mean")
def accuracy_half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.accuracy(mixtures(spark, sf_dir), P.mixture_mean(F.col("parts")), F.col("label"))


@query(f"{SQL} mean as (select frame_id, label, sum(pi * mu) as m from parts group by 1, 2) select label, count(*) as n, floor(avg(m) * 1e6 + 0.5) / 1e6 as mean, floor(avg((m - label) * (m - label)) * 1e6 + 0.5) / 1e6 as mse from mean group by 1")
def error_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.error_by_label(mixtures(spark, sf_dir), P.mixture_mean(F.col("parts")), F.col("label"))
    return out.select("label", "n", quantised(F.col("mean")).alias("mean"), quantised(F.col("mse")).alias("mse"))


@query(f"{SQL} {CDF} select frame_id, cast(c as integer) as c, floor(f * 1e6 + 0.5) / 1e6 as f from cdf")
def mixture_cdf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir).select("frame_id", F.posexplode("cdf").alias("c", "f")).select("frame_id", "c", quantised(F.col("f")).alias("f"))


@query(f"{SQL} top as (select cast(ceil(max(mu + 4.2645878e0 * sigma)) as bigint) as max_count from parts) select max_count from top")
def mixture_max_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixtures(spark, sf_dir).agg(F.ceil(F.max(P.mixture_bound(F.col("parts")))).alias("max_count"))


@query(f"""{SQL} d as (select frame_id, sum(pi * exp(-0.5 * power((label - mu) / sigma, 2)) / (sigma * sqrt(2 * pi()))) as p from parts group by 1)
select floor(avg(-ln(greatest(p, 2.2250738585072014e-308))) * 1e6 + 0.5) / 1e6 as loss from d""")
def mdn_log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.log_loss(mixtures(spark, sf_dir), F.col("parts"), F.col("label").cast("double")).select(quantised(F.col("loss")).alias("loss"))


_POIBIN = """
with recursive p as (select l_orderkey as frame_id, list(l_discount * 10 order by l_discount) as ps from lineitem group by 1),
r(frame_id, i, ps, d) as (
  select frame_id, 1, ps, [1e0] from p
  union all
  select frame_id, i + 1, ps, list_transform(range(1, len(d) + 2), lambda c: (case when c <= len(d) then d[c] * (1e0 - ps[i]) else 0e0 end) + (case when c > 1 then d[c - 1] * ps[i] else 0e0 end))
  from r where i <= len(ps)
),
pmf as (select frame_id, d from r where i = len(ps) + 1)
"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    return d.groupBy("frame_id").agg(F.sort_array(F.collect_list("conf")).alias("p"), F.count_if(F.col("class_name") == "R").alias("gt"))  # a frame's detections


@query(_POIBIN + "select frame_id, cast(c as integer) as c, floor(d[c + 1] * 1e6 + 0.5) / 1e6 as p from (select frame_id, d, unnest(range(0, len(d))) as c from pmf)")
def poibin_pmf(spark: SparkSession, sf_dir: str) -> DataFrame:
    pmf = P.count_pmf(F.col("p"))
    return _events(spark, sf_dir).select("frame_id", F.posexplode(pmf).alias("c", "p")).select("frame_id", "c", quantised(F.col("p")).alias("p"))


@query("select l_orderkey as frame_id, floor(sum(l_discount * 10) * 1e6 + 0.5) / 1e6 as mean from lineitem group by 1")
def poibin_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("frame_id", quantised(P.mean_count(P.count_pmf(F.col("p")))).alias("mean"))


@query("""
with f as (select l_orderkey as frame_id, count(*) filter (l_returnflag = 'R') as gt, sum(l_discount * 10) as m from lineitem group by 1),
g as (select unnest(range(0, (select max(gt) from f) + 1)) as gt_count)
select cast(gt_count as bigint) as gt_count, count(frame_id) as n, floor(coalesce(avg(m), 0) * 1e6 + 0.5) / 1e6 as mean, coalesce(array_to_string(list_sort(list(frame_id) filter (frame_id is not null))[1:10], ','), '') as frames
from g left join f on gt = gt_count group by 1
""")
def mean_by_true_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _events(spark, sf_dir).withColumn("mean", P.mean_count(P.count_pmf(F.col("p"))))
    return C.mean_by_count(own, F.col("gt"), F.col("mean")).select("gt_count", "n", quantised(F.col("mean")).alias("mean"), F.array_join("frames", ",").alias("frames"))


@query("select l_returnflag as class_name, floor(sum(cast(l_discount as decimal(18, 2))) * 10 * 1e6 + 0.5) / 1e6 as expected from lineitem group by 1")
def expected_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of confidences by class."""
    d = detections(spark, sf_dir)
    return d.groupBy("class_name").agg(quantised(F.sum((F.col("conf") / 10).cast("decimal(18,2)")).cast("double") * 10).alias("expected"))


_PAV = """
with g as (select l_discount * 10 as prob, sum(case when l_linestatus = 'F' then 1e0 else 0e0 end) as y, count(*) as w from lineitem group by 1),
n as (select prob, y, w, row_number() over (order by prob) as k from g),
s as (select a.k as i, b.k as j, sum(m.y) / sum(m.w) as mean from n a join n b on a.k <= b.k join n m on m.k between a.k and b.k group by 1, 2),
iso as (select k, prob, (select max(low) from (select min(mean) as low from s where i <= n.k and j >= n.k group by i)) as c from n)
"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).select(F.col("conf").alias("prob"), (F.col("status") == "F").cast("int").alias("label"))


@query(_PAV + "select floor(prob * 1e6 + 0.5) / 1e6 as prob, floor(c * 1e6 + 0.5) / 1e6 as calibrated from iso")
def isotonic_calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir)
    out = calibration.calibrated(calibration.fit(hits), hits.select("prob").distinct())
    return out.select(quantised(F.col("prob")).alias("prob"), quantised(F.col("calibrated")).alias("calibrated"))


@query(_PAV + "select floor(avg(power(c - case when l_linestatus = 'F' then 1 else 0 end, 2)) * 1e6 + 0.5) / 1e6 as mse from lineitem join iso on l_discount * 10 = prob")
def calibration_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir)
    return calibration.mean_squared_error(calibration.calibrated(calibration.fit(hits), hits)).select(quantised(F.col("mse")).alias("mse"))
