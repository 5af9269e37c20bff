"""Judge pairs, corpus statistics, informativeness and threshold replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from weighbridge.catalog.audit_queries import sql_auroc, sql_hist
from weighbridge.catalog.base import RECORDS, RESAMPLES, Tables, prob, query, records, sql_prob, sql_weights
from weighbridge.catalog.text_queries import normal
from weighbridge.functions.answers import ANSWER
from weighbridge.operators import gates as G
from weighbridge.operators import paired as P
from weighbridge.plans import corpus as K
from weighbridge.plans import informativeness as N
from weighbridge.plans.replay_gates import replay_gates

# Every event is a judge request with three answers. Model families by event
# number: three of five exact, one by prefix, one unknown and skipped.
SQL_TRIPLES = f"""
req as (select event_id as seq, case when event_id % 5 < 3 then 'm-1.0' when event_id % 5 = 3 then 'self:tiny' else 'zz' end as model,
  substr(sha256(user_id || '-' || event_type), 1, 16) as state_id, user_id, (value * 10)::bigint as input_tokens,
  {sql_prob(17)} as p1, {sql_prob(29)} as p2, {sql_prob(43)} as p3 from events),
fam as (select *, case when model = 'm-1.0' then 'first' else 'second' end as family from req where model <> 'zz'),
tri as (select family, state_id, seq, 'is_relevant' as question_id, 's1' as stage, 'noul' as primitive, p1 as value from fam
  union all select family, state_id, seq, 'evidence_sufficient', 's2', 'noul', p2 from fam
  union all select family, state_id, seq, 'support', 's4', 'choice', p3 from fam)"""


def _requests(t: Tables):
    e = F.col("event_id")
    model = F.when(e % 5 < 3, "m-1.0").when(e % 5 == 3, "self:tiny").otherwise("zz")
    blank = "null"

    def answer(kind, field, value):
        return F.expr(f"cast(named_struct('type', '{kind}', 'noul', {blank}, 'choice', {blank}, 'score', {blank}, 'confidence', {blank}, 'probabilities', {blank}, 'legend', {blank}) as {ANSWER})").withField(field, value)

    answers = F.create_map(
        F.lit("is_relevant"), answer("noul", "noul", prob(17)), F.lit("evidence_sufficient"), answer("noul", "noul", prob(29)),
        F.lit("support"), answer("choice", "confidence", prob(43)),
    )
    state = F.to_json(F.struct(F.concat(F.lit("q"), F.col("user_id").cast("string")).alias("query")))
    rows = t.events.select(
        e.alias("seq"), model.alias("model"), F.left(F.sha2(F.concat_ws("-", F.col("user_id").cast("string"), "event_type"), 256), F.lit(16)).alias("state_id"),
        state.alias("state"), F.get_json_object(state, "$.query").alias("query"), F.rint(F.col("value") * 10).cast("bigint").alias("input_tokens"),
        answers.alias("answers"), F.expr("cast(map() as map<string,struct<instructions:string,criteria:string>>)").alias("questions"),
    )
    return K.with_families(rows, {"m-1.0": "first"}, {"self:": "second"})


@query("judgment_triples", f"with {SQL_TRIPLES} select family, state_id, seq, question_id, stage, primitive, value from tri")
def judgment_triples(spark, path):
    """One row per answer of every request of a known model family."""
    out = P.judgment_triples(_requests(Tables(spark, path)))
    return out.select("family", "state_id", "seq", "question_id", "stage", "primitive", "value")


SQL_PAIRED = f"""{SQL_TRIPLES},
wide as (select state_id, question_id, arg_max(value, seq) filter (family = 'first') as first, arg_max(value, seq) filter (family = 'second') as second
  from tri where primitive = 'noul' group by state_id, question_id),
pairs as (select * from wide where first is not null and second is not null)"""


@query("paired_judgments", f"with {SQL_PAIRED} select * from pairs")
def paired_judgments(spark, path):
    return P.pair_judges(P.judgment_triples(_requests(Tables(spark, path))), ["first", "second"])


@query(
    "paired_statistics",
    f"""with {SQL_PAIRED} select count(*) as judgments, round(count(*) filter ((first >= 0.5) = (second >= 0.5)) / count(*), 4) as agreement,
(select count(distinct user_id) from fam where state_id in (select state_id from fam group by state_id having count(distinct family) > 1)) as distinct_questions from pairs""",
)
def paired_statistics(spark, path):
    requests = _requests(Tables(spark, path))
    stats = P.paired_statistics(P.pair_judges(P.judgment_triples(requests), ["first", "second"]), "first", "second")
    queries = K.distinct_queries(requests).withColumn("k", F.lit(1))
    return stats.withColumn("k", F.lit(1)).join(queries, "k").drop("k")


@query(
    "paired_histogram",
    f"""with {SQL_PAIRED}, l as (select 'first' as family, first as v from pairs union all select 'second', second from pairs)
select family, round(v * 100)::int as bin, count(*) as n from l group by 1, 2""",
)
def paired_histogram(spark, path):
    return K.corpus_tables(_requests(Tables(spark, path)), ["first", "second"])["paired_histogram"]


@query(
    "model_statistics",
    f"""with {SQL_TRIPLES}, n as (select family, round(value * 100)::int as bin, value from tri where primitive = 'noul'),
s as (
  select family, 'totals' as section, 'requests' as key, count(*)::double as value from fam group by family
  union all select family, 'totals', 'input_tokens', sum(input_tokens)::double from fam group by family
  union all select family, 'totals', 'triples', count(*) from tri group by family
  union all select family, 'primitive', primitive, count(*) from tri group by family, primitive
  union all select family, 'stage', case question_id when 'evidence_sufficient' then 'other' else stage end, count(*) from tri group by 1, 3
  union all select family, 'question', question_id, count(*) from tri group by 1, 3
  union all select family, 'noul', 'n', count(*) from n group by 1
  union all select family, 'noul', 'distinct_values_2dp', count(distinct bin) from n group by 1
  union all select family, 'noul', 'min', min(value) from n group by 1
  union all select family, 'noul', 'max', max(value) from n group by 1
  union all select family, 'histogram', format('{{:.2f}}', bin / 100), count(*) from n group by family, bin)
select * from s""",
)
def model_statistics(spark, path):
    """Corpus counts per family, under the historic stage lookup."""
    requests = _requests(Tables(spark, path))
    return P.model_statistics(P.judgment_triples(requests, compat_stages=True), requests)


# Informativeness: documents as passages of their source's question.
SQL_INFORM = f"""
j as (select d.doc_id, d.source as query, case when (substr(d.source, 4)::int) % 2 = 0 then 'of the' else 'de la' end as gold, {normal("d.text")} as t,
   least(100, d.n_chars // 20) / 100 as first, case when d.n_chars < 600 then 0 when d.n_chars < 2000 then 0.5 else 1 end::double as second from documents d),
lab as (select doc_id, query as cluster, contains(t, gold) as label, first, second from j),
long as (select 'first' as family, cluster, label, first as score from lab union all select 'second', cluster, label, second from lab)"""


def _labelled(t: Tables):
    n = F.col("n_chars")
    number = F.substring("source", 4, 10).cast("int")
    gold = t.documents.select(F.col("source").alias("query"), F.when(number % 2 == 0, "Of the").otherwise("de la!").alias("gold")).distinct()
    scores = F.array(
        F.struct(F.lit("first").alias("family"), (F.least(F.lit(100), F.floor(n / 20)) / 100).alias("value")),
        F.struct(F.lit("second").alias("family"), F.when(n < 600, 0.0).when(n < 2000, 0.5).otherwise(1.0).alias("value")),
    )
    rows = t.documents.select(
        F.col("doc_id").cast("string").alias("state_id"), F.lit("contains_answer_evidence").alias("question_id"), F.col("source").alias("query"),
        F.col("text").alias("passage_text"), F.lit(0).alias("seq"), F.explode(scores).alias("s"),
    ).select("*", "s.family", "s.value").drop("s")
    return N.labelled(rows, gold)


@query("gold_labels", f"with {SQL_INFORM} select family, cluster as query, count(*) as n, count(*) filter (label) as positives from long group by 1, 2")
def gold_labels(spark, path):
    """Judgments labelled by whether the passage states the gold answer."""
    return _labelled(Tables(spark, path)).groupBy("family", "query").agg(F.count(F.lit(1)).alias("n"), F.count_if("label").alias("positives"))


def _sql_boot(source: str, by: str, strata: str) -> str:
    """Replicates of AUROC over long rows; ``strata`` columns index the clusters."""
    tie = f"h.{strata} = w.{strata} and " if strata else ""
    return f"""{sql_hist(source, by + ", cluster", "chist")}, {sql_weights(source, strata)},
weighted as (select {", ".join("h." + c.strip() for c in by.split(","))}, w.replicate, h.score, sum(w.w * h.pos) as pos, sum(w.w * h.neg) as neg
  from weights w join chist h on {tie}h.cluster = w.cluster group by all),
{sql_auroc("weighted", by + ", replicate", "reps")}"""


@query(
    "judge_informativeness",
    f"""with {SQL_INFORM}, {sql_hist("long", "family", "g")}, {sql_auroc("g", "family", "pt")}, {_sql_boot("long", "family", "family")}
select family, round(any_value(pt.auroc), 6) as auroc, any_value(pt.positives) as positives, any_value(pt.negatives) as negatives,
 round(quantile_cont(reps.auroc, 0.025), 6) as ci_lo, round(quantile_cont(reps.auroc, 0.975), 6) as ci_hi,
 (select count(distinct cluster) from lab) as clusters from reps join pt using (family) group by family""",
)
def judge_informativeness(spark, path):
    out = N.single_judge(_labelled(Tables(spark, path)), resamples=RESAMPLES)
    return out.select("family", "positives", "negatives", "clusters", *[F.round(c, 6).alias(c) for c in ("auroc", "ci_lo", "ci_hi")])


@query(
    "paired_auroc_difference",
    f"""with {SQL_INFORM}, {sql_hist("long", "family", "g")}, {sql_auroc("g", "family", "pt")}, {_sql_boot("long", "family", "")},
dif as (select replicate, max(auroc) filter (family = 'first') - max(auroc) filter (family = 'second') as d from reps group by replicate)
select round((select auroc from pt where family = 'first'), 6) as auroc_first, round((select auroc from pt where family = 'second'), 6) as auroc_second,
 round((select auroc from pt where family = 'first') - (select auroc from pt where family = 'second'), 6) as difference,
 round(quantile_cont(d, 0.025), 6) as difference_lo, round(quantile_cont(d, 0.975), 6) as difference_hi from dif""",
)
def paired_auroc_difference(spark, path):
    """Two judges on the same passages under the same resamples."""
    out = N.paired_auroc(N.paired_judges(_labelled(Tables(spark, path))), resamples=RESAMPLES)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(
    "auroc_inside_buckets",
    f"""with {SQL_INFORM}, b as (select (second * 100)::int as bucket, cluster, label, first as score from lab),
sz as (select bucket, count(*) as n, count(*) filter (label) as positives, count(*) filter (not label) as negatives from b group by bucket),
ready as (select * from b where bucket in (select bucket from sz where least(positives, negatives) >= 20)),
{sql_hist("ready", "bucket", "g")}, {sql_auroc("g", "bucket", "pt")}, {_sql_boot("ready", "bucket", "bucket")},
bd as (select bucket, quantile_cont(auroc, 0.025) as lo, quantile_cont(auroc, 0.975) as hi from reps group by bucket)
select sz.bucket, sz.n, sz.positives, sz.negatives, round(sz.positives / sz.n, 6) as positive_share, (least(sz.positives, sz.negatives) < 20)::int as too_small,
 round(pt.auroc, 6) as auroc, round(bd.lo, 6) as ci_lo, round(bd.hi, 6) as ci_hi from sz left join pt using (bucket) left join bd using (bucket)""",
)
def auroc_inside_buckets(spark, path):
    out = N.inside_buckets(N.paired_judges(_labelled(Tables(spark, path))), resamples=RESAMPLES)
    return out.select(
        "bucket", "n", "positives", "negatives", F.col("too_small").cast("int").alias("too_small"),
        *[F.round(c, 6).alias(c) for c in ("positive_share", "auroc", "ci_lo", "ci_hi")],
    )


# Finished runs: every order is a judged record with up to four claims and three
# stripped sentences; the customer's other order is the baseline arm's grade.
SQL_RUNS = f"""{RECORDS},
runs as (select arm, question_id, o_orderkey, label from records),
claims as (select arm, question_id, i as pos, ((o_orderkey * (i + 3)) % 101) / 100 as confidence,
   case (o_orderkey + i) % 5 when 0 then 'unsupported' when 1 then 'unreadable' else 'supported' end as label
  from (select *, unnest(range(o_orderkey % 5)) as i from runs) where o_orderkey % 13 <> 0 or o_orderkey % 5 = 0),
stripped as (select arm, question_id, label = 'not_attempted' as abstained,
   list_extract(['supported_low_confidence', 'unsupported', 'uncited_claim'], ((o_orderkey + i) % 3 + 1)::int) as reason,
   case when (o_orderkey + i) % 3 < 2 then ((o_orderkey * (i + 7)) % 81) / 100 end as confidence
  from (select *, unnest(range(o_orderkey % 4)) as i from runs)),
base as (select arm, count(*) as n, count(*) filter (label = 'correct') as correct, count(*) filter (label = 'incorrect') as incorrect from runs group by arm),
other as (select question_id, label from runs where arm = '1-URGENT')"""


def _runs(t: Tables):
    key = F.col("o_orderkey")
    support = F.struct(
        F.lit("supported").alias("choice"), F.lit(0.0).alias("confidence"), F.expr("cast(null as map<string,double>)").alias("probabilities")
    )

    def upto(n):
        return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>"))

    claims = F.transform(
        upto(key % 5),
        lambda i: F.struct(F.lit("claim").alias("text"), F.array().cast("array<string>").alias("citations"), support.withField("confidence", ((key * (i + 3)) % 101) / 100).alias("support")),
    )

    def verdict(i):
        return F.when((key + i) % 5 == 0, "unsupported").when((key + i) % 5 == 1, "unreadable").otherwise("supported")

    short = F.when((key % 13 == 0) & (key % 5 > 0), key % 5 - 1).otherwise(key % 5)  # a label missing: misaligned
    labels = F.transform(upto(short), lambda i: F.struct(verdict(i).alias("label")))

    def reason(i):
        return F.get(F.array(F.lit("supported_low_confidence"), F.lit("unsupported"), F.lit("uncited_claim")), ((key + i) % 3).cast("int"))

    stripped = F.transform(
        upto(key % 4),
        lambda i: F.struct(
            F.lit("s").alias("sentence"), reason(i).alias("reason"),
            F.when((key + i) % 3 < 2, support.withField("confidence", ((key * (i + 7)) % 81) / 100)).alias("support"),
        ),
    )
    return records(t).select(
        "arm", "question_id", F.struct(F.col("label").alias("label")).alias("grade"), (F.col("label") == "not_attempted").alias("abstained"),
        "abstain_reason", claims.alias("claims"), labels.alias("claim_support"), stripped.alias("stripped"),
    )


def _replayed(spark, path):
    runs = _runs(Tables(spark, path))
    return replay_gates(runs, runs.where(F.col("arm") == "1-URGENT"))


@query("misaligned_records", f"with {RECORDS} select arm, count(*) filter (o_orderkey % 13 = 0 and o_orderkey % 5 > 0) as misaligned from records group by arm")
def misaligned_records(spark, path):
    return _replayed(spark, path)["misaligned"]


@query(
    "raise_gate_curve",
    f"""with {SQL_RUNS}, gr as (select * from claims where label <> 'unreadable'), th as (select (80 + 2 * range) / 100 as threshold from range(11))
select a.arm, th.threshold, count(*) filter (confidence >= threshold) as kept, count(*) filter (confidence >= threshold and label = 'unsupported') as unsupported,
  round(count(*) filter (confidence >= threshold) / count(*), 6) as coverage,
  round(count(*) filter (confidence >= threshold and label = 'unsupported') / nullif(count(*) filter (confidence >= threshold), 0), 6) as error_rate
from (select distinct arm from gr) a cross join th join gr on gr.arm = a.arm group by a.arm, th.threshold""",
)
def raise_gate_curve(spark, path):
    """What a stricter support threshold keeps, exactly."""
    out = _replayed(spark, path)["raise_gate_curve"]
    return out.select("arm", "threshold", "kept", "unsupported", F.round("coverage", 6).alias("coverage"), F.round("error_rate", 6).alias("error_rate"))


@query("stripped_reasons", f"with {SQL_RUNS} select arm, reason, count(*) as n from stripped group by arm, reason")
def stripped_reasons(spark, path):
    return _replayed(spark, path)["stripped_reasons"]


@query(
    "rescuable_claims",
    f"with {SQL_RUNS} select arm, question_id, confidence, abstained::int as abstained from stripped where reason = 'supported_low_confidence' and confidence is not null",
)
def rescuable_claims(spark, path):
    """Stripped claims a lower threshold alone would bring back."""
    return _replayed(spark, path)["rescuable"].select("arm", "question_id", "confidence", F.col("abstained").cast("int").alias("abstained"))


@query(
    "proxy_ceiling",
    f"""with {SQL_RUNS}, r as (select * from stripped where reason = 'supported_low_confidence' and confidence is not null),
th as (select (5 * range) / 100 as threshold from range(17)),
qs as (select a.arm, threshold, count(*) filter (confidence >= threshold) as claims, count(distinct r.question_id) filter (confidence >= threshold and abstained) as questions,
  count(distinct r.question_id) filter (confidence >= threshold and abstained and o.label = 'correct') as baseline_right,
  count(distinct r.question_id) filter (confidence >= threshold and abstained and o.label = 'incorrect') as baseline_wrong
  from (select distinct arm from r) a cross join th join r on r.arm = a.arm left join other o on o.question_id = r.question_id group by a.arm, threshold)
select qs.*, round(((correct + baseline_right) - (incorrect + baseline_wrong)) / n, 4) as ceiling from qs join base using (arm)""",
)
def proxy_ceiling(spark, path):
    """Upper bound on truthfulness under a lower threshold."""
    return _replayed(spark, path)["proxy_ceiling"]


@query(
    "threshold_sweep",
    f"""with r as (select event_type, {sql_prob(17)} as c, value from events), th as (select range / 100 as threshold from range(101))
select a.event_type, threshold, count(*) filter (c >= threshold) as n, count(*) filter (c >= threshold and value > 100) as big
from (select distinct event_type from r) a cross join th join r on r.event_type = a.event_type group by 1, 2""",
)
def threshold_sweep(spark, path):
    """All 101 thresholds from one pass and a reverse running sum."""
    rows = Tables(spark, path).events.select("event_type", prob(17).alias("c"), "value")
    measures = {"n": F.lit(1), "big": F.when(F.col("value") > 100, 1).otherwise(0)}
    return G.threshold_sweep(rows, ["event_type"], "c", [i / 100 for i in range(101)], measures)


