"""Top-k in all its forms, and how rankings and detectors are judged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.probability import quantised
from ..operators import counting as C
from ..operators import evaluation as E
from ..operators import topk as T
from ..operators import uncertain as U
from ..operators.models import table_confirmer
from ..operators.sweep import sweep
from ..sources.tables import detections, frames
from .distributions import CDF, SQL, tables
from .registry import query


def _counts(spark: SparkSession, sf_dir: str, name: str = "R") -> DataFrame:
    return C.frame_counts(detections(spark, sf_dir), name)


_COUNTS = "select l_orderkey as frame_id, count(*) filter (l_returnflag = '{0}') as n from lineitem group by 1"


@query(f"select frame_id, n from ({_COUNTS.format('R')}) order by n desc, frame_id limit 100")
def topk_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 frames with the most detections of class R; ties go to the smaller frame id."""
    return T.top(_counts(spark, sf_dir), 100)


@query("""
select class_name, frame_id, n from (select class_name, frame_id, n, row_number() over (partition by class_name order by n desc, frame_id) as rn
from (select l_returnflag as class_name, l_orderkey as frame_id, count(*) as n from lineitem group by 1, 2)) where rn <= 10
""")
def topk_frames_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = detections(spark, sf_dir).groupBy("class_name", "frame_id").agg(F.count("*").alias("n"))
    return T.top_per_group(n, ["class_name"], [F.desc("n"), F.asc("frame_id")], 10)


@query(f"""
with recursive o as (select frame_id, n, row_number() over (order by n desc, frame_id) as rn from ({_COUNTS.format('R')}) order by n desc, frame_id limit 420),
g(rn, picked) as (
  select 0, cast([] as bigint[])
  union all
  select g.rn + 1, case when len(picked) < 20 and not list_bool_or(list_concat([false], list_transform(picked, lambda p: abs(p - frame_id) <= 10))) then list_append(picked, frame_id) else picked end
  from g join o on o.rn = g.rn + 1
)
select frame_id, n from o where list_contains((select picked from g order by rn desc limit 1), frame_id)
""")
def topk_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 frames that are more than 10 apart."""
    return T.top_gap(_counts(spark, sf_dir), 20, 10)


def _uncertain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every frame's distribution of class R by its detections' confidences, and the true counts."""
    d = detections(spark, sf_dir)
    return U.from_detections(d, F.col("conf"), keep=F.col("class_name") == "R"), _counts(spark, sf_dir)


def _search(k: int, level: float, gap: int, batch: int) -> str:
    """The rounds of a search as table s: rounds, seen (frames), best (values and frames) and conf.

    A frame's gain is what the confidence is expected to become when it is confirmed: over its counts x, the product of the
    others' F at the k-th value that x would make.
    """
    far = f"not list_bool_or(list_prepend(false, list_transform(a, lambda y: abs(y.f - x[1].f) <= {gap})))" if gap else "true"
    kept = f"list_reduce(list_prepend(cast([] as struct(v double, f bigint)[]), list_transform(ranked, lambda x: [x])), lambda a, x: case when len(a) < {k} and {far} then list_concat(a, x) else a end)"
    others = "case when zeros[{c} + 1] - case when f[{c} + 1] <= 0 then 1 else 0 end > 0 then 0e0 else exp(sums[{c} + 1] - case when f[{c} + 1] <= 0 then 0e0 else ln(f[{c} + 1]) end) end"
    second = f"least(x, {f'cast(best[{k - 1}].v as bigint)' if k > 1 else 'x'})"
    gain = f"case when len(best) < {k} then 0e0 else case when zeros[c_k + 1] > 0 then 0e0 else exp(sums[c_k + 1]) end + coalesce(list_sum(list_transform(range(c_k + 1, c_top + 1), lambda x: (f[x + 1] - f[x]) * ({others.format(c=second)}))), 0e0) end"
    return f"""
with recursive p as (select l_orderkey as frame_id, coalesce(list(l_discount * 10 order by l_discount) filter (l_returnflag = 'R'), []) as ps, count(*) filter (l_returnflag = 'R') as n from lineitem group by 1),
r(frame_id, n, i, ps, d) as (
  select frame_id, n, 1, ps, [1e0] from p
  union all
  select frame_id, n, i + 1, ps, list_transform(range(1, len(d) + 2), lambda c: (case when c <= len(d) then d[c] * (1e0 - ps[i]) else 0e0 end) + (case when c > 1 then d[c - 1] * ps[i] else 0e0 end)) from r where i <= len(ps)
),
top as (select max(n) as c_top from p),
t as (select frame_id, n, list_transform(range(1, c_top + 2), lambda i: case when i > len(ps) then 1e0 else least(1e0, list_sum(d[1:i])) end) as f from r, top where i = len(ps) + 1),
u as (select frame_id, n, f, len(f) - list_sum(f) as mean from t),
l as (select frame_id, unnest(range(0, len(f))) as c, unnest(f) as p from u),
s(rounds, seen, best, conf) as (
  select 0, cast([] as bigint[]), cast([] as struct(v double, f bigint)[]), 0e0
  union all
  select rounds + 1, now, kept, case when len(kept) < {k} then 0e0 else coalesce((select case when sum(case when p <= 0 then 1 else 0 end) > 0 then 0e0 else exp(sum(ln(p))) end from l where c = least(kept[{k}].v, (select c_top from top)) and not list_contains(now, frame_id)), 1e0) end
  from (select *, {kept} as kept from (
    select rounds, now, (select list({{'v': cast(n as double), 'f': frame_id}} order by n desc, frame_id) from u where list_contains(now, frame_id)) as ranked
    from (select rounds, list_concat(seen, (select list(frame_id order by gain desc, mean desc, frame_id)[1:case when rounds = 0 then {max(k, batch)} else {batch} end] from (
        select frame_id, mean, {gain} as gain from u where not list_contains(seen, frame_id) and (len(best) < {k} or f[c_k + 1] < 1)))) as now
      from (select *, case when len(best) < {k} then 0 else least(best[{k}].v, c_top)::bigint end as c_k,
        (select list(z order by c) from (select c, count(*) filter (p <= 0) as z from l where not list_contains(seen, frame_id) group by 1)) as zeros,
        (select list(z order by c) from (select c, sum(case when p > 0 then ln(p) else 0 end) as z from l where not list_contains(seen, frame_id) group by 1)) as sums
        from s, top where conf < {level}))))
)
"""


@query(f"select frame_id, n from ({_COUNTS.format('R')}) order by n desc, frame_id limit 50")
def topk_probabilistic_sure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With confidence 1 the answer is exact, though only frames that could be among the best are confirmed."""
    # a count can exceed what confidences of 0 allow, so at confidence 1 each detection is given the same chance
    table = U.from_detections(detections(spark, sf_dir), F.lit(0.5), keep=F.col("class_name") == "R")
    out = T.probabilistic_top(table, table_confirmer(_counts(spark, sf_dir)), 50, 1.0, 256)
    return spark.createDataFrame(list(zip(out.frames, map(int, out.values), strict=True)), "frame_id long, n long")


@query(_search(20, 0.9, 0, 16) + "select x.f as frame_id, cast(x.v as bigint) as n from (select unnest(best) as x from (select best from s order by rounds desc limit 1))")
def topk_probabilistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best frames with confidence 0.9."""
    table, counts = _uncertain(spark, sf_dir)
    out = T.probabilistic_top(table, table_confirmer(counts), 20, 0.9, 16)
    return spark.createDataFrame(list(zip(out.frames, map(int, out.values), strict=True)), "frame_id long, n long")


@query(_search(10, 0.99, 10, 16) + "select x.f as frame_id, cast(x.v as bigint) as n from (select unnest(best) as x from (select best from s order by rounds desc limit 1))")
def topk_probabilistic_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 frames more than 10 apart, with confidence 0.99."""
    table, counts = _uncertain(spark, sf_dir)
    out = T.probabilistic_top(table, table_confirmer(counts), 10, 0.99, 16, gap=10)
    return spark.createDataFrame(list(zip(out.frames, map(int, out.values), strict=True)), "frame_id long, n long")


def _swept(k: int, levels: tuple[float, ...], batch: int) -> str:
    """Rows of a sweep for one k."""
    chosen = " union all ".join(f"(select cast({x} as double) as confidence, * from s where conf >= {x} order by rounds limit 1)" for x in levels)
    return f"""({_search(k, max(levels), 0, batch)}, w as ({chosen}),
e as (select list(cast(n as double) order by n desc, frame_id)[1:{k}] as exact, count(*) as frames from u)
select {k} as k, confidence, rounds as n_rounds, floor(len(seen) / rounds * 1e6 + 0.5) / 1e6 as mean_confirmed, floor(len(seen) / frames * 1e6 + 0.5) / 1e6 as share_confirmed, floor(conf * 1e6 + 0.5) / 1e6 as reached,
  (select count(*) from (select unnest(list_transform(best, lambda x: x.v)) intersect all select unnest(exact))) / {float(k)} as precision,
  list_sum(list_transform(range(1, {k + 1}), lambda i: abs(best[i].v - exact[i]))) / {float(k)} as score_error
from w, e)"""


@query(" union all ".join(f"select * from {_swept(k, (0.6, 0.9), 16)}" for k in (1, 10)))
def topk_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds, confirmed frames, confidence and quality for several k and confidences."""
    table, counts = _uncertain(spark, sf_dir)
    truth = [(r.frame_id, float(r.n)) for r in T.top(counts, 10).collect()]
    rows = sweep(spark, table, table_confirmer(counts), truth, (1, 10), (0.6, 0.9), batch=16)
    return rows.select("k", "confidence", "n_rounds", *(quantised(F.col(c)).alias(c) for c in ("mean_confirmed", "share_confirmed", "reached")), "precision", "score_error")


@query(f"""
{SQL} {CDF},
l as (select vec_id as frame_id, label as score from embeddings where vec_id % 5 = 0),
sk as (select score from (select score, row_number() over (order by score desc, frame_id) as rn from l) where rn = 10),
rest as (select f from cdf, sk where frame_id % 5 <> 0 and c = least(score, (select c from top)))
select case when count(*) filter (f <= 0) > 0 then 0e0 else floor(exp(sum(ln(f))) * 1e6 + 0.5) / 1e6 end as confidence from rest
""")
def topk_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of the top 10 when every fifth frame is confirmed."""
    confirmed = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("vec_id % 5 = 0").select(F.col("vec_id").alias("frame_id"), F.col("label").cast("double").alias("score"))
    p = T.confidence(tables(spark, sf_dir), confirmed, 10)
    return spark.range(1).select(quantised(F.lit(p)).alias("confidence"))


def _ranked(counts: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.orderBy(F.desc("n"), "frame_id")) - 1  # over the k rows that are left
    return T.top(counts, k).select("frame_id", F.col("n").alias("value"), rank.alias("rank"))


def _lists(spark: SparkSession, sf_dir: str, k: int) -> tuple[DataFrame, DataFrame]:
    """A ranking of every other frame's counts, and of all."""
    counts = _counts(spark, sf_dir)
    return _ranked(counts.filter("frame_id % 2 = 0"), k), _ranked(counts, k)


_LISTS = f"""
with c as ({_COUNTS.format('R')}),
a as (select n as value, row_number() over (order by n desc, frame_id) - 1 as rank from c where frame_id % 2 = 0 order by rank limit {{k}}),
e as (select n as value, row_number() over (order by n desc, frame_id) - 1 as rank from c order by rank limit {{k}})
"""
_SHARED = "select count(*) / 200e0 as {name} from (select value from a intersect all select value from e)"


@query(_LISTS.format(k=200) + _SHARED.format(name="precision"))
def eval_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.precision(*_lists(spark, sf_dir, 200), 200)


@query(_LISTS.format(k=200) + _SHARED.format(name="recall"))
def eval_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.recall(*_lists(spark, sf_dir, 200), 200)


@query(_LISTS.format(k=200) + "select sum(abs(a.value - e.value)) / 200e0 as score_error from a join e using (rank)")
def eval_score_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.score_error(*_lists(spark, sf_dir, 200), 200)




@query(
    "with recursive "
    + _LISTS.format(k=200).strip().removeprefix("with ")
    + """,
x as (select list(value order by rank) as xs from a), y as (select list(value order by rank) as ys from e),
g(i, j, total) as (
  select 0, 0, 0
  union all
  select i + 1,
    case when j > 199 then j when p is null then 199 else p + 1 end,
    total + abs(i - case when j > 199 or p is null then 200 else p end)
  from (select i, j, total, (select min(q) from unnest(range(least(j, 199), 200)) as t(q) where ys[q + 1] = xs[i + 1]) as p from g, x, y where i < 200)
)
select total / 200e0 as rank_distance from g where i = 200
"""
)
def eval_rank_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, e = _lists(spark, sf_dir, 200)
    arrays = [df.groupBy(F.lit(1).alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x.value).alias(n)) for df, n in ((a, "a"), (e, "e"))]
    return arrays[0].join(arrays[1], "k").select(E.rank_distance(F.col("a"), F.col("e"), 200).alias("rank_distance"))


def _flags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = detections(spark, sf_dir)
    cls = F.ascii("class_name").alias("class_id")
    found = d.select(cls, "conf", (F.col("status") == "F").cast("int").alias("tp"))
    return found, d.groupBy(cls).agg((F.count("*") + 1).alias("n_truth"))


_AP = """
with t as (select ascii(l_returnflag) as class_id, count(*) + 1 as n_truth from lineitem group by 1),
s as (select ascii(l_returnflag) as class_id, l_discount * 10 as conf, sum(case when l_linestatus = 'F' then 1 else 0 end) as tp, count(*) as n from lineitem group by 1, 2),
c as (select class_id, conf, sum(tp) over w as tp, sum(n) over w as n from s window w as (partition by class_id order by conf desc)),
p as (select class_id, conf, n, tp / n as precision, tp / (n_truth + 1e-16) as recall, n_truth from c join t using (class_id)),
v as (select *, max(precision) over (partition by class_id order by conf desc rows between current row and unbounded following) as top,
  lag(recall, 1, 0e0) over (partition by class_id order by conf desc) as before from p),
ap as (select class_id, any_value(n_truth) as n_truth, arg_max(precision, n) as precision, arg_max(recall, n) as recall, sum((recall - before) * top) as ap from v group by 1),
f as (select *, 2 * precision * recall / (precision + recall + 1e-16) as f1 from ap)
"""
_METRICS = ("precision", "recall", "ap", "f1")


@query(_AP + f"select class_id, n_truth, {', '.join(f'floor({m} * 1e6 + 0.5) / 1e6 as {m}' for m in _METRICS)} from f")
def ap_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.average_precision(*_flags(spark, sf_dir))
    return out.select("class_id", "n_truth", *(quantised(F.col(m)).alias(m) for m in _METRICS))


@query(_AP + f"select {', '.join(f'floor(avg({m}) * 1e6 + 0.5) / 1e6 as m_{m}' for m in _METRICS)} from f")
def mean_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.mean_average_precision(*_flags(spark, sf_dir))
    return out.select(*(quantised(F.col(f"m_{m}")).alias(f"m_{m}") for m in _METRICS))


@query("select user_id as video, floor(o / b * 1e6 + 0.5) / 1e6 as time_ratio, floor(b / o * 1e6 + 0.5) / 1e6 as speedup from (select user_id, 1 + min(value) as o, 1 + max(value) as b from events group by 1)")
def time_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = frames(spark, sf_dir).groupBy("video").agg((1 + F.min("value")).alias("o"), (1 + F.max("value")).alias("b"))
    ratio, faster = E.speedup(F.col("o"), F.col("b"))
    return t.select("video", quantised(ratio).alias("time_ratio"), quantised(faster).alias("speedup"))
