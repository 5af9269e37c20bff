"""Spread and informativeness of judge scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from weighbridge.catalog.base import JUDGED_DOCS, RESAMPLES, Tables, judged_docs, judged_long, query, sql_weights
from weighbridge.functions.answers import truthy
from weighbridge.operators import auroc as A
from weighbridge.operators import resample as R
from weighbridge.operators import spread as S
from weighbridge.operators.ranking import mid_ranks
from weighbridge.plans.audit import audit

SQL_SPREAD = """
spread as (
  select judge, sum(n)::bigint as n, count(*) as distinct_values,
         sum(case when pos <= 3 then n else 0 end) / sum(n) as top3_mass,
         sum(case when bin between 10 and 90 then n else 0 end) / sum(n) as interior_mass,
         sum(case when bin < 100 then 1 else 0 end) / 100 as gate_mobility
  from (select *, row_number() over (partition by judge order by n desc, bin) as pos from hist)
  group by judge
)"""


def sql_auroc(source: str, by: str, name: str, score: str = "score") -> str:
    """AUROC per group of a (by, score, pos, neg) table."""
    return f"""
{name} as (
  select {by}, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) as auroc,
         sum(pos)::bigint as positives, sum(neg)::bigint as negatives
  from (select *, coalesce(sum(neg) over (partition by {by} order by {score}
               rows between unbounded preceding and 1 preceding), 0) as below from {source})
  group by {by}
)"""


def sql_hist(source: str, by: str, name: str) -> str:
    return f"""
{name} as (
  select {by}, score, sum(case when label then 1 else 0 end) as pos, sum(case when label then 0 else 1 end) as neg
  from {source} group by {by}, score
)"""


@query(
    "judge_audit",
    f"""with {JUDGED_DOCS},
hist as (select judge, bin, count(*) as n from judged_long group by judge, bin), {SQL_SPREAD},
{sql_hist("judged_long", "judge, cluster", "chist")},
{sql_hist("judged_long", "judge", "ghist")}, {sql_auroc("ghist", "judge", "point")},
{sql_weights("judged_long", "judge")},
weighted as (
  select h.judge, w.replicate, h.score, sum(w.w * h.pos) as pos, sum(w.w * h.neg) as neg
  from weights w join chist h on h.judge = w.judge and h.cluster = w.cluster
  group by h.judge, w.replicate, h.score
), {sql_auroc("weighted", "judge, replicate", "reps")},
bounds as (select judge, quantile_cont(auroc, 0.025) as ci_lo, quantile_cont(auroc, 0.975) as ci_hi from reps group by judge)
select s.judge, s.n, s.distinct_values, round(s.top3_mass, 6) as top3_mass, round(s.interior_mass, 6) as interior_mass,
       round(s.gate_mobility, 6) as gate_mobility, round(p.auroc, 6) as auroc, p.positives, p.negatives,
       round(b.ci_lo, 6) as ci_lo, round(b.ci_hi, 6) as ci_hi,
       (select count(distinct cluster) from judged_docs) as clusters
from spread s join point p using (judge) join bounds b using (judge)""",
)
def judge_audit(spark, path):
    """Per judge: spread, AUROC and its cluster-bootstrap interval."""
    out = audit(judged_long(Tables(spark, path)), resamples=RESAMPLES, on_grid=True)
    digits = ("top3_mass", "interior_mass", "gate_mobility", "auroc", "ci_lo", "ci_hi")
    return out.select(
        "judge", "n", "distinct_values", "positives", "negatives", "clusters", *[F.round(c, 6).alias(c) for c in digits]
    )


RAW_SCORES = """raw as (
  select lang as judge, (n_chars % 1009) / 1009 as score from documents
),
binned as (
  select judge, floor(p) + case when up > 0 or (up = 0 and floor(p)::bigint % 2 <> 0) then 1 else 0 end as bin
  from (select judge, p, (p - floor(p) - 0.5) + ((hi * 100.0 - p) + (score - hi) * 100.0) as up
        from (select judge, score, score * 100.0::double as p,
                     score * 134217729.0::double - (score * 134217729.0::double - score) as hi from raw))
),
hist as (select judge, bin::int as bin, count(*) as n from binned group by judge, bin)"""


def _raw(t: Tables):
    return t.documents.select(F.col("lang").alias("judge"), ((F.col("n_chars") % 1009) / 1009).alias("score"))


@query(
    "score_spread",
    f"""with {RAW_SCORES}, {SQL_SPREAD}
select judge, n, distinct_values, round(top3_mass, 6) as top3_mass, round(interior_mass, 6) as interior_mass,
       round(gate_mobility, 6) as gate_mobility from spread""",
)
def score_spread(spark, path):
    """Spread of free scores after exact rounding to the 0.01 grid."""
    out = S.spread(S.score_histogram(_raw(Tables(spark, path)), ["judge"]), ["judge"])
    return out.select("judge", "n", "distinct_values", *[F.round(c, 6).alias(c) for c in ("top3_mass", "interior_mass", "gate_mobility")])


@query(
    "commonest_scores",
    f"""with {RAW_SCORES}
select judge, bin, n, round(share, 6) as share, position from (
  select judge, bin, n, n / sum(n) over (partition by judge) as share,
         row_number() over (partition by judge order by n desc, bin) as position from hist) where position <= 3""",
)
def commonest_scores(spark, path):
    out = S.top_values(S.score_histogram(_raw(Tables(spark, path)), ["judge"]), ["judge"])
    return out.select("judge", "bin", "n", F.round("share", 6).alias("share"), "position")


SQL_CURVE = """
curve as (
  select judge, bin, sum(n) over (partition by judge order by bin desc) / sum(n) over (partition by judge) as accepted
  from (select j.judge, g.range::int as bin, coalesce(h.n, 0) as n
        from (select distinct judge from hist) j cross join range(101) g
        left join hist h on h.judge = j.judge and h.bin = g.range)
)"""


@query("accept_curve", f"with {RAW_SCORES}, {SQL_CURVE} select judge, bin, round(accepted, 6) as accepted from curve")
def accept_curve(spark, path):
    curve = S.accept_curve(S.score_histogram(_raw(Tables(spark, path)), ["judge"]), ["judge"])
    return curve.select("judge", "bin", F.round("accepted", 6).alias("accepted"))


@query(
    "calibration_summary",
    f"""with {RAW_SCORES}, {SQL_SPREAD}, {SQL_CURVE},
moves as (select judge, sum(case when abs(accepted - prev) > 1e-9 then 1 else 0 end) / (count(*) - 1) as mobility
  from (select *, lag(accepted) over (partition by judge order by bin) as prev from curve) group by judge)
select judge, n, distinct_values, round(top3_mass, 4) as mass_top3_values, round(interior_mass, 4) as mass_interior,
       round(mobility, 4) as mobility, round(gate_mobility, 4) as gate_mobility from spread join moves using (judge)""",
)
def calibration_summary(spark, path):
    """The curve's mobility next to the histogram's: two routes to one number."""
    hist = S.score_histogram(_raw(Tables(spark, path)), ["judge"])
    moves = S.curve_mobility(S.accept_curve(hist, ["judge"]), ["judge"])
    return S.spread(hist, ["judge"]).join(moves, "judge").select(
        "judge", "n", "distinct_values", F.round("top3_mass", 4).alias("mass_top3_values"),
        F.round("interior_mass", 4).alias("mass_interior"), F.round("mobility", 4).alias("mobility"),
        F.round("gate_mobility", 4).alias("gate_mobility"),
    )


@query(
    "average_ranks",
    """with s as (select o_orderpriority as judge, floor(o_totalprice)::bigint % 997 / 997 as score from orders),
r as (select judge, score, rank() over (partition by judge order by score) as lo, count(*) over (partition by judge, score) as n from s)
select judge, round(score, 6) as score, n, max(lo + (n - 1) / 2) as mid_rank from r group by judge, score, n""",
)
def average_ranks(spark, path):
    price = F.col("o_totalprice")
    scores = Tables(spark, path).orders.select(
        F.col("o_orderpriority").alias("judge"), (F.floor(price) % 997 / 997).alias("score")
    )
    return mid_ranks(scores, ["judge"]).select("judge", F.round("score", 6).alias("score"), "n", "mid_rank")


FREE = """free as (
  select l.l_returnflag as judge, o.o_custkey % 40 as cluster, l.l_extendedprice / 200000 as score,
         o.o_orderstatus = 'F' as label
  from lineitem l join orders o on l.l_orderkey = o.o_orderkey
)"""


def _free(t: Tables):
    return t.lineitem.select("l_orderkey", "l_returnflag", "l_extendedprice").join(
        t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus"), "l_orderkey"
    ).select(
        F.col("l_returnflag").alias("judge"), (F.col("o_custkey") % 40).alias("cluster"),
        (F.col("l_extendedprice") / 200000).alias("score"), truthy(F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("no")).alias("label"),
    )


@query(
    "auroc_free_scores",
    f"""with {FREE}, {sql_hist("free", "judge", "h")}, {sql_auroc("h", "judge", "a")}
select judge, round(auroc, 6) as auroc, positives, negatives from a""",
)
def auroc_free_scores(spark, path):
    """AUROC over raw scores with as many distinct values as rows."""
    hist = A.label_histogram(_free(Tables(spark, path)), ["judge"])
    return A.auroc(hist, ["judge"]).withColumn("auroc", F.round("auroc", 6))


@query(
    "auroc_in_bucket",
    f"""with {JUDGED_DOCS},
inside as (select 1 as one, fine / 100 as score, label from judged_docs where coarse = 50),
{sql_hist("inside", "one", "h")}, {sql_auroc("h", "one", "a")} select round(auroc, 6) as auroc, positives, negatives from a""",
)
def auroc_in_bucket(spark, path):
    """Does the fine judge still rank where the coarse one says 0.50?"""
    docs = judged_docs(Tables(spark, path)).select(
        F.lit(1).alias("one"), (F.col("fine") / 100).alias("score"), (F.col("coarse") / 100).alias("other"), "label"
    )
    out = A.auroc_within(docs, ["one"], F.col("other"), 50, "score", "label")
    return out.select(F.round("auroc", 6).alias("auroc"), "positives", "negatives")


@query(
    "auroc_within_clusters",
    f"""with {JUDGED_DOCS}, {sql_hist("judged_long", "judge, cluster", "h")}, {sql_auroc("h", "judge, cluster", "a")}
select judge, round(sum(auroc * positives * negatives) / sum(positives * negatives), 6) as auroc_within,
       count(*) as clusters from a where auroc is not null group by judge""",
)
def auroc_within_clusters(spark, path):
    hist = A.label_histogram(judged_long(Tables(spark, path)), ["judge", "cluster"])
    out = A.within_clusters(hist, ["judge"], "cluster", on_grid=True)
    return out.withColumn("auroc_within", F.round("auroc_within", 6))


SQL_LOO = f"""
ones as (select distinct judge, cluster as left_out from judged_long),
rest as (select o.judge, o.left_out, j.score, j.label from ones o join judged_long j on j.judge = o.judge and j.cluster <> o.left_out),
{sql_hist("rest", "judge, left_out", "h")}, {sql_auroc("h", "judge, left_out", "loo")}"""


@query(
    "auroc_leave_one_out",
    f"with {JUDGED_DOCS}, {SQL_LOO} select judge, left_out as cluster, round(auroc, 6) as auroc_without from loo",
)
def auroc_leave_one_out(spark, path):
    hist = A.label_histogram(judged_long(Tables(spark, path)), ["judge", "cluster"])
    out = A.leave_one_out(hist, ["judge"], "cluster", on_grid=True)
    return out.withColumn("auroc_without", F.round("auroc_without", 6))


@query(
    "auroc_jackknife",
    f"""with {JUDGED_DOCS}, {SQL_LOO}, {sql_hist("judged_long", "judge", "g")}, {sql_auroc("g", "judge", "point")},
sp as (select judge, min(auroc) as loo_min, max(auroc) as loo_max, count(*) as clusters,
              sqrt((count(*) - 1) * var_pop(auroc)) as se from loo group by judge)
select judge, round(auroc, 6) as auroc, positives, negatives, round(loo_min, 6) as loo_min, round(loo_max, 6) as loo_max,
       clusters, round(auroc - 1.96 * se, 6) as ci_lo, round(auroc + 1.96 * se, 6) as ci_hi
from point join sp using (judge)""",
)
def auroc_jackknife(spark, path):
    hist = A.label_histogram(judged_long(Tables(spark, path)), ["judge", "cluster"])
    out = A.jackknife(hist, ["judge"], "cluster", on_grid=True)
    return out.select(
        "judge", "positives", "negatives", "clusters", *[F.round(c, 6).alias(c) for c in ("auroc", "loo_min", "loo_max", "ci_lo", "ci_hi")]
    )


@query(
    "bootstrap_free_scores",
    f"""with {FREE}, {sql_hist("free", "judge, cluster", "chist")}, {sql_hist("free", "judge", "g")},
{sql_auroc("g", "judge", "point")}, {sql_weights("free", "judge")},
beats as (
  select h.judge, h.cluster as c1, k.cluster as c2, h.pos,
         sum(case when h.cluster = k.cluster then h.neg else 0 end) over (partition by h.judge, k.cluster order by h.score
             range between unbounded preceding and current row) as upto,
         sum(case when h.cluster = k.cluster then h.neg else 0 end) over (partition by h.judge, k.cluster, h.score) as tied
  from chist h join (select distinct judge, cluster from free) k on k.judge = h.judge
), wins as (select judge, c1, c2, sum(pos * (upto - tied / 2)) as won from beats group by all),
size as (select judge, cluster, sum(pos) as pos, sum(neg) as neg from chist group by all),
total as (select s.judge, w.replicate, sum(w.w * s.pos) as pos, sum(w.w * s.neg) as neg
  from size s join weights w on w.judge = s.judge and w.cluster = s.cluster group by all),
won as (select x.judge, a.replicate, sum(a.w * b.w * x.won) as won from wins x
  join weights a on a.judge = x.judge and a.cluster = x.c1
  join weights b on b.judge = x.judge and b.cluster = x.c2 and b.replicate = a.replicate group by all),
reps as (select judge, won / nullif(pos * neg, 0) as auroc from won join total using (judge, replicate))
select judge, round(any_value(point.auroc), 6) as auroc, round(quantile_cont(reps.auroc, 0.025), 6) as ci_lo,
       round(quantile_cont(reps.auroc, 0.975), 6) as ci_hi
from reps join point using (judge) group by judge""",
)
def bootstrap_free_scores(spark, path):
    """Cluster bootstrap of AUROC over ungridded scores."""
    hist = A.label_histogram(_free(Tables(spark, path)), ["judge", "cluster"])
    out = R.auroc_with_interval(hist, ["judge"], resamples=RESAMPLES)
    return out.select("judge", *[F.round(c, 6).alias(c) for c in ("auroc", "ci_lo", "ci_hi")])


@query(
    "bootstrap_custom_statistic",
    f"""with {JUDGED_DOCS}, {sql_weights("judged_long", "judge")},
sums as (select judge, cluster, sum(score) as total, count(*) as n from judged_long group by all),
reps as (
  select w.judge, w.replicate, sum(w.w * j.total) / sum(w.w * j.n) as value
  from weights w join sums j on j.judge = w.judge and j.cluster = w.cluster group by w.judge, w.replicate
)
select judge, round(quantile_cont(value, 0.025), 6) as value_lo, round(quantile_cont(value, 0.975), 6) as value_hi
from reps group by judge""",
)
def bootstrap_custom_statistic(spark, path):
    """A user statistic (the weighted mean score) under the same resampling."""
    summary = judged_long(Tables(spark, path)).groupBy("judge", "cluster", "score").agg(F.count(F.lit(1)).alias("weight"))

    def mean_score(pdf: pd.DataFrame) -> float:
        return float((pdf["score"] * pdf["weight"]).sum() / pdf["weight"].sum())

    reps = R.bootstrap_statistic(summary, mean_score, ["judge"], ["score"], resamples=RESAMPLES)
    out = R.interval(reps, ["judge"], ["value"])
    return out.select("judge", F.round("value_lo", 6).alias("value_lo"), F.round("value_hi", 6).alias("value_hi"))
