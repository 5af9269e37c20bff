"""Grades, claim support, acceptance bars, arm comparison and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from weighbridge.catalog.base import JUDGED_DOCS, RECORDS, RESAMPLES, Tables, judged_long, prob, query, records, sql_prob, sql_weights
from weighbridge.functions.answers import judge_cost, parse_label, parse_letter
from weighbridge.operators import gates
from weighbridge.operators import scoring as S
from weighbridge.operators.auroc import label_histogram

SQL_RATES = """round((correct - incorrect) / nullif(n, 0), 6) as truthfulness,
       round(incorrect / nullif(correct + incorrect, 0), 6) as hallucination_rate,
       round((correct + incorrect) / nullif(n, 0), 6) as coverage"""
SQL_COUNTS = """count(label) as n, count(*) filter (label = 'correct') as correct,
       count(*) filter (label = 'incorrect') as incorrect, count(*) filter (label = 'not_attempted') as not_attempted"""
RATES = ("truthfulness", "hallucination_rate", "coverage")


@query(
    "answer_scores",
    f"""with {RECORDS}, c as (select arm, {SQL_COUNTS} from records group by arm)
select arm, n, correct, incorrect, not_attempted, correct + incorrect as attempted, {SQL_RATES} from c""",
)
def answer_scores(spark, path):
    out = S.answer_scores(records(Tables(spark, path)), ["arm"])
    return out.select("arm", "n", "correct", "incorrect", "not_attempted", "attempted", *[F.round(c, 6).alias(c) for c in RATES])


SQL_BOOT = f"""
cl as (select arm, question_id as cluster, count(*) as n, count(*) filter (label = 'correct') as correct,
       count(*) filter (label = 'incorrect') as incorrect from records where label is not null group by arm, question_id),
{sql_weights("cl", "arm")},
sums as (select w.arm, w.replicate, sum(w.w * c.n) as n, sum(w.w * c.correct) as correct, sum(w.w * c.incorrect) as incorrect
  from weights w join cl c on c.arm = w.arm and c.cluster = w.cluster group by w.arm, w.replicate),
reps as (select arm, (correct - incorrect) / nullif(n, 0) as truthfulness,
       incorrect / nullif(correct + incorrect, 0) as hallucination_rate, (correct + incorrect) / nullif(n, 0) as coverage from sums),
bounds as (select arm, {", ".join(f"round(quantile_cont({c}, {q}), 4) as {c}_{s}" for c in RATES for q, s in ((0.025, "lo"), (0.975, "hi")))}
  from reps group by arm)"""


@query(
    "answer_score_intervals",
    f"""with {RECORDS}, c as (select arm, {SQL_COUNTS} from records group by arm), {SQL_BOOT}
select c.*, {SQL_RATES}, bounds.* exclude (arm) from c join bounds using (arm)""",
)
def answer_score_intervals(spark, path):
    """Scores with question-bootstrap intervals, one job for all replicates."""
    out = S.answer_score_intervals(records(Tables(spark, path)), ["arm"], resamples=RESAMPLES)
    return out.drop("ungraded", "attempted").select(
        *[c for c in out.columns if c not in (*RATES, "ungraded", "attempted")], *[F.round(c, 6).alias(c) for c in RATES]
    )


SQL_CLAIMS = """
graded_claims as (
  select r.arm, r.question_id, case when l.l_linenumber % 7 = 0 then 'unreadable'
         when l.l_returnflag = 'R' then 'unsupported' else 'supported' end as label
  from records r join lineitem l on l.l_orderkey = r.o_orderkey where r.label <> 'not_attempted'
)"""


def _claims(t: Tables):
    flag = F.when(F.col("l_linenumber") % 7 == 0, "unreadable").when(F.col("l_returnflag") == "R", "unsupported")
    answered = records(t).where(F.col("label") != "not_attempted").select("arm", "question_id", "o_orderkey")
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag")
    return answered.join(lines, "o_orderkey").select("arm", "question_id", flag.otherwise("supported").alias("label"))


SQL_SUPPORT = f"""
per as (select r.arm, r.question_id as cluster,
    count(*) filter (g.label = 'supported') as supported, count(*) filter (g.label in ('supported', 'unsupported')) as kept,
    count(*) filter (g.label = 'unreadable') as unreadable
  from records r left join graded_claims g on g.arm = r.arm and g.question_id = r.question_id group by r.arm, r.question_id),
{sql_weights("per", "arm")},
reps as (select w.arm, w.replicate, sum(w.w * p.supported) / nullif(sum(w.w * p.kept), 0) as rate
  from weights w join per p on p.arm = w.arm and p.cluster = w.cluster group by w.arm, w.replicate),
bounds as (select arm, round(quantile_cont(rate, 0.025), 4) as rate_lo, round(quantile_cont(rate, 0.975), 4) as rate_hi from reps group by arm)"""


@query(
    "claim_support_rate",
    f"""with {RECORDS}, {SQL_CLAIMS},
{SQL_SUPPORT}
select arm, sum(kept)::bigint as kept_claims, sum(supported)::bigint as supported, sum(unreadable)::bigint as unreadable,
       count(*) as n_questions, count(*) filter (kept > 0) as n_questions_with_claims,
       round(sum(supported) / nullif(sum(kept), 0), 6) as rate, any_value(rate_lo) as rate_lo, any_value(rate_hi) as rate_hi
from per join bounds using (arm) group by arm""",
)
def claim_support_rate(spark, path):
    """Pooled claim support; questions without claims are resampled too."""
    t = Tables(spark, path)
    out = S.claim_support(records(t), _claims(t), ["arm"], resamples=RESAMPLES)
    return out.withColumn("rate", F.round("rate", 6))


@query(
    "acceptance_bars",
    f"""with {RECORDS}, {SQL_CLAIMS}, c as (select arm, {SQL_COUNTS} from records group by arm),
m as (select arm, correct, incorrect, n, (correct + incorrect) / n as coverage, incorrect / nullif(correct + incorrect, 0) as hall,
       (correct - incorrect) / n as truth from c),
sup as (select arm, count(*) filter (label = 'supported') / count(*) filter (label <> 'unreadable') as rate from graded_claims group by arm),
v as (
  select arm, 'coverage' as bar, 'at least' as rule, 0.50 as threshold, coverage as value from m
  union all select arm, 'hallucination rate when attempting', 'at most', 0.10, hall from m
  union all select arm, 'truthfulness gain over arm B', 'at least', 0.15,
       case when arm <> '1-URGENT' then truth - (select truth from m where arm = '1-URGENT') end from m
  union all select arm, 'citation support rate on kept claims', 'at least', 0.90, rate from m join sup using (arm))
select arm, bar, rule, threshold::double as threshold, round(value, 6) as value,
       coalesce(case when rule = 'at least' then value >= threshold else value <= threshold end, false)::int as passed from v""",
)
def acceptance_bars(spark, path):
    """Four bars per arm; the gain is against the first arm, which has none itself."""
    t = Tables(spark, path)
    scored = S.answer_scores(records(t), ["arm"]).select("arm", "coverage", "hallucination_rate", "truthfulness")
    base = scored.where(F.col("arm") == "1-URGENT").select(F.lit(1).alias("k"), F.col("truthfulness").alias("base"))
    gain = scored.withColumn("k", F.lit(1)).join(base, "k").withColumn(
        "truthfulness_gain", F.when(F.col("arm") != "1-URGENT", F.col("truthfulness") - F.col("base"))
    )
    support = _claims(t).groupBy("arm").agg(
        F.try_divide(F.count_if(F.col("label") == "supported"), F.count_if(F.col("label") != "unreadable")).alias("support_rate")
    )
    names = ["coverage", "hallucination_rate", "truthfulness_gain", "support_rate"]
    long = gain.join(support, "arm", "left").unpivot("arm", names, "metric", "value")
    out = S.acceptance(long, ["arm"])
    return out.select("arm", "bar", "rule", "threshold", F.round("value", 6).alias("value"), F.col("passed").cast("int").alias("passed"))


@query(
    "grade_metrics",
    f"""with {RECORDS}, g as (select * replace (case when o_orderkey % 11 = 0 then null else label end as label) from records),
c as (select arm, count(label) as n, count(*) filter (label = 'correct') as correct, count(*) filter (label = 'incorrect') as incorrect,
      count(*) - count(label) as ungraded, sum(fabricated_citations)::bigint as fabricated_citations_total from g group by arm),
{SQL_BOOT.replace("from records where", "from g where")}
select arm, n, ungraded, fabricated_citations_total, {SQL_RATES}, bounds.* exclude (arm) from c join bounds using (arm)""",
)
def grade_metrics(spark, path):
    """Grades attached to records; ungraded ones are counted and left out."""
    rows = records(Tables(spark, path))
    label = F.when(F.col("o_orderkey") % 11 != 0, F.col("label"))
    graded = S.attach_grades(rows.drop("label"), rows.select("arm", "question_id", label.alias("label")))
    out = S.grade_metrics(graded, ["arm"], resamples=RESAMPLES)
    bounds = [c for c in out.columns if c.endswith(("_lo", "_hi"))]
    return out.select("arm", "n", "ungraded", "fabricated_citations_total", *[F.round(c, 6).alias(c) for c in RATES], *bounds)


SQL_RUN_SUPPORT = SQL_SUPPORT.replace("weights", "claim_weights").replace("reps", "claim_reps").replace("bounds", "claim_bounds")


@query(
    "judged_run_metrics",
    f"""with {RECORDS}, {SQL_CLAIMS},
c as (select arm, {SQL_COUNTS}, sum(fabricated_citations)::bigint as fabricated_citations_total from records group by arm),
{SQL_BOOT}, {SQL_RUN_SUPPORT},
s as (select arm, sum(kept)::bigint as kept_claims, sum(supported)::bigint as supported, round(sum(supported) / nullif(sum(kept), 0), 6) as support_rate,
  any_value(rate_lo) as support_rate_lo, any_value(rate_hi) as support_rate_hi from per join claim_bounds using (arm) group by arm)
select arm, n, fabricated_citations_total, {SQL_RATES}, bounds.* exclude (arm), s.* exclude (arm) from c join bounds using (arm) join s using (arm)""",
)
def judged_run_metrics(spark, path):
    """All metrics of a judged run: scores, fabricated citations and claim support, with intervals."""
    t = Tables(spark, path)
    out = S.grade_metrics(records(t), ["arm"], RESAMPLES, _claims(t))
    bounds = [c for c in out.columns if c.endswith(("_lo", "_hi"))]
    rounded = [F.round(c, 6).alias(c) for c in (*RATES, "support_rate")]
    return out.select("arm", "n", "fabricated_citations_total", "kept_claims", "supported", *rounded, *bounds)


def _two_arms(t: Tables):
    rows = records(t)
    return (rows.where(F.col("arm") == a).select("question_id", "label", "abstain_reason") for a in ("5-LOW", "1-URGENT"))


SQL_PAIRS = """
pairs as (select question_id, a.label as first_label, a.abstain_reason as first_reason, b.label as second_label
  from (select * from records where arm = '5-LOW') a join (select * from records where arm = '1-URGENT') b using (question_id))"""


@query(
    "arm_contingency",
    f"""with {RECORDS}, {SQL_PAIRS}
select case when first_label = 'not_attempted' then coalesce(first_reason, 'declined') else 'attempted' end as first_outcome,
       count(*) filter (second_label = 'correct') as second_correct, count(*) filter (second_label = 'incorrect') as second_incorrect,
       count(*) filter (second_label = 'not_attempted') as second_not_attempted, count(*) as n
from pairs group by 1""",
)
def arm_contingency(spark, path):
    first, second = _two_arms(Tables(spark, path))
    return S.arm_contingency(S.pair_arms(first, second))


@query(
    "arm_difference",
    f"""with {RECORDS}, {SQL_PAIRS},
g as (select question_id as cluster, (case first_label when 'correct' then 1 when 'incorrect' then -1 else 0 end)
   - (case second_label when 'correct' then 1 when 'incorrect' then -1 else 0 end) as gain from pairs),
{sql_weights("g")},
reps as (select replicate, sum(w * gain) / sum(w) as difference from weights join g using (cluster) group by replicate)
select (select count(*) from g) as n, round((select avg(gain) from g), 6) as difference,
  round(quantile_cont(difference, 0.025), 6) as difference_lo, round(quantile_cont(difference, 0.975), 6) as difference_hi from reps""",
)
def arm_difference(spark, path):
    """Paired truthfulness difference of two arms with its interval."""
    first, second = _two_arms(Tables(spark, path))
    out = S.arm_difference(S.pair_arms(first, second), resamples=RESAMPLES)
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("difference", "difference_lo", "difference_hi")])


SQL_REQ = """
req as (select 'arm' || (user_id % 3) as arm, user_id as question_id, event_type as stage, event_id % 4 = 0 as cached,
  (value * 10)::bigint as input_tokens, event_id % 50 as output_tokens from events)"""


def _requests(t: Tables):
    return t.events.select(
        F.concat(F.lit("arm"), (F.col("user_id") % 3).cast("string")).alias("arm"), F.col("user_id").alias("question_id"),
        F.col("event_type").alias("stage"), (F.col("event_id") % 4 == 0).alias("cached"),
        F.rint(F.col("value") * 10).cast("bigint").alias("input_tokens"), (F.col("event_id") % 50).alias("output_tokens"),
    )


@query(
    "usage_rollup",
    f"""with {SQL_REQ} select arm, question_id, stage, count(*) as n_requests, count(*) filter (cached) as n_cached,
  sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens,
  round(sum(input_tokens)::bigint * 0.042::double / 1000000, 6) as cost_usd, grouping(arm, question_id, stage)::int as level
from req group by rollup (arm, question_id, stage)""",
)
def usage_rollup(spark, path):
    """Requests, tokens and cost per stage, question, arm and in total."""
    return S.usage_rollup(_requests(Tables(spark, path)), ["arm", "question_id", "stage"])


@query(
    "usage_per_query",
    f"""with {SQL_REQ}, q as (select arm, question_id, count(*) as n, sum(input_tokens)::bigint as t from req group by arm, question_id)
select arm, sum(n)::bigint as n_requests, round(sum(n) / count(*), 1) as per_query_requests,
       round(sum(t)::bigint * 0.042::double / 1000000, 6) as cost_usd from q group by arm""",
)
def usage_per_query(spark, path):
    return S.usage_per_query(_requests(Tables(spark, path)), ["arm"])


@query(
    "request_cost",
    """select p_partkey, round(p_size * 1000 * 0.042::double / 1000000, 6) as cost_usd from part""",
)
def request_cost(spark, path):
    return Tables(spark, path).part.select("p_partkey", judge_cost(F.col("p_size") * 1000).alias("cost_usd"))


@query(
    "reply_labels",
    """select p_partkey,
  case coalesce(nullif(regexp_extract(p_type || ' ' || p_brand, '(A|B|C)', 1), ''), 'C')
       when 'A' then 'correct' when 'B' then 'incorrect' else 'not_attempted' end as grade,
  case coalesce(nullif(regexp_extract(p_type || ' ' || p_brand, '\\b(A|B|C)\\b', 1), ''), 'C')
       when 'A' then 'correct' when 'B' then 'incorrect' else 'not_attempted' end as strict_grade,
  case p_size % 4 when 0 then 'unsupported' when 1 then 'supported' when 2 then 'unsupported' else 'unreadable' end as support
from part""",
)
def reply_labels(spark, path):
    """Grader replies to labels: first letter anywhere, and support verdicts."""
    text = F.concat_ws(" ", "p_type", "p_brand")
    size = F.col("p_size") % 4
    reply = (
        F.when(size == 0, F.lit("Verdict: Unsupported.")).when(size == 1, F.lit("supported")).when(size == 2, F.lit("NOT supported"))
        .otherwise(F.col("p_name"))
    )
    return Tables(spark, path).part.select(
        "p_partkey", parse_letter(text).alias("grade"), parse_letter(text, strict=True).alias("strict_grade"), parse_label(reply).alias("support")
    )


SQL_REL = f"""
h as (select judge, score, count(*) filter (label) as pos, count(*) filter (not label) as neg from judged_long group by judge, score),
rel as (select judge, least(floor(score * 10)::int, 9) as bin, sum(pos + neg)::bigint as n,
  sum(score * (pos + neg)) / sum(pos + neg) as mean_score, sum(pos) / sum(pos + neg) as observed from h group by 1, 2)"""


@query(
    "reliability_table",
    f"""with {JUDGED_DOCS}, {SQL_REL} select judge, bin, n, round(mean_score, 6) as mean_score, round(observed, 6) as observed,
round(abs(mean_score - observed), 6) as gap from rel""",
)
def reliability_table(spark, path):
    out = S.reliability(label_histogram(judged_long(Tables(spark, path)), ["judge"]), ["judge"])
    return out.select("judge", "bin", "n", *[F.round(c, 6).alias(c) for c in ("mean_score", "observed", "gap")])


@query(
    "calibration_error",
    f"""with {JUDGED_DOCS}, {SQL_REL} select judge, round(sum(abs(mean_score - observed) * n) / sum(n), 6) as ece from rel group by judge""",
)
def calibration_error(spark, path):
    table = S.reliability(label_histogram(judged_long(Tables(spark, path)), ["judge"]), ["judge"])
    return S.calibration_error(table, ["judge"]).withColumn("ece", F.round("ece", 6))


@query(
    "selective_risk",
    f"""with rows as (select event_type as arm, {sql_prob(17)} as confidence, event_id % 3 = 0 as wrong from events),
t as (select range / 20 as threshold from range(21)), a as (select distinct arm from rows)
select a.arm, t.threshold, round(count(*) filter (confidence >= threshold) / count(*), 6) as coverage,
  round(count(*) filter (confidence >= threshold and wrong) / nullif(count(*) filter (confidence >= threshold), 0), 6) as risk
from a cross join t join rows r on r.arm = a.arm group by a.arm, t.threshold""",
)
def selective_risk(spark, path):
    rows = Tables(spark, path).events.select(
        F.col("event_type").alias("arm"), prob(17).alias("confidence"),
        F.when(F.col("event_id") % 3 == 0, "incorrect").otherwise("correct").alias("label"),
    )
    out = gates.selective_risk(rows, ["arm"])
    return out.select("arm", "threshold", F.round("coverage", 6).alias("coverage"), F.round("risk", 6).alias("risk"))


@query(
    "latency_quantiles",
    f"""with {RECORDS} select arm, round(quantile_cont(latency_ms, 0.5), 6) as p50, round(quantile_cont(latency_ms, 0.95), 6) as p95,
count(*) as n from records group by arm""",
)
def latency_quantiles(spark, path):
    out = S.latency_quantiles(records(Tables(spark, path)), ["arm"], "latency_ms")
    return out.select("arm", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "n")


@query(
    "memory_pass_delta",
    f"""with {SQL_REQ}, p as (select cached, stage, count(*) as n_requests, sum(input_tokens) as input_tokens from req group by cached, stage)
select b.stage, round(b.n_requests / a.n_requests, 6) as n_requests_ratio, b.n_requests - a.n_requests as n_requests_delta,
  round(b.input_tokens / a.input_tokens, 6) as input_tokens_ratio, (b.input_tokens - a.input_tokens)::bigint as input_tokens_delta
from p a join p b using (stage) where not a.cached and b.cached""",
)
def memory_pass_delta(spark, path):
    """Second pass (served from the cache here) against the first, per stage."""
    rows = _requests(Tables(spark, path)).groupBy("cached", "stage").agg(
        F.count(F.lit(1)).alias("n_requests"), F.sum("input_tokens").alias("input_tokens")
    )
    out = S.pass_delta(rows.where(~F.col("cached")), rows.where("cached"), ["stage"], ["n_requests", "input_tokens"])
    return out.select(
        "stage", "n_requests_delta", "input_tokens_delta", *[F.round(c, 6).alias(c) for c in ("n_requests_ratio", "input_tokens_ratio")]
    )
