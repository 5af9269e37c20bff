"""Decision policy over event probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from weighbridge.catalog.base import PRIMES, Tables, prob, query, sql_prob
from weighbridge.functions import policy as P
from weighbridge.functions.ids import since_for
from weighbridge.operators import passages as G
from weighbridge.operators import store as D
from weighbridge.operators.grouped import union_all
from weighbridge.settings import EVIDENCE, GATE_QUESTIONS, VERIFIED
from weighbridge.sources import readers


@query(
    "intake_plan",
    f"""with e as (select *, {sql_prob(17)} as needs, {sql_prob(29)} as sc, {sql_prob(43)} as rc, {sql_prob(61)} as cc,
  list_extract(['web', 'palace', 'both'], (event_id % 3 + 1)::int) as source,
  list_extract(['any', 'year', 'month', 'week', 'day'], (event_id % 5 + 1)::int) as recency,
  list_extract(['general', 'news', 'science', 'it'], (event_id % 4 + 1)::int) as category, event_id % 2 = 0 as hits from events),
d as (select event_id, (event_id % 10 = 0 or needs >= 0.5)::int as retrieve, (needs >= 0.5)::int as retrieve_judged,
  case when sc < 0.5 or (source = 'palace' and not hits) then 'both' else source end as source_judged,
  case when rc >= 0.5 and recency <> 'any' then recency end as time_range,
  case when cc < 0.5 then 'general' else category end as category from e)
select event_id, retrieve, retrieve_judged, case when event_id % 7 = 0 then 'web' else source_judged end as source, source_judged,
  time_range, category, (date '2026-09-19' - case time_range when 'year' then 365 when 'month' then 30 when 'week' then 7 when 'day' then 1 end)::varchar as since
from d""",
)
def intake_plan(spark, path):
    """Retrieval plan per query, with forced search and forced web."""
    e = F.col("event_id")

    def pick(options, k):
        return F.get(F.array(*[F.lit(o) for o in options]), (e % k).cast("int"))

    plan = P.intake(
        prob(17), pick(("web", "palace", "both"), 3), prob(29), pick(("any", "year", "month", "week", "day"), 5), prob(43),
        pick(("general", "news", "science", "it"), 4), prob(61), e % 2 == 0, e % 10 == 0, e % 7 == 0,
    )
    rows = Tables(spark, path).events.select("event_id", plan.alias("p"))
    return rows.select(
        "event_id", F.col("p.retrieve").cast("int").alias("retrieve"), F.col("p.retrieve_judged").cast("int").alias("retrieve_judged"),
        "p.source", "p.source_judged", "p.time_range", "p.category", since_for(F.col("p.time_range"), F.lit("2026-09-19")).alias("since"),
    )


# injection, boilerplate, relevant, contradicts, evidence from the five primes
SQL_ROUTE = f"""
p as (select event_id, user_id, event_type, {", ".join(f"{sql_prob(k)} as {q}" for k, q in zip(PRIMES, GATE_QUESTIONS, strict=True))} from events),
routed as (select *, case when contains_prompt_injection > 0.70 then 'injection' when is_promotional_or_boilerplate > 0.70 then 'boilerplate'
    when is_relevant < 0.45 then 'off_topic' when contradicts_query_premise > 0.70 then 'contradicts_premise'
    when contains_answer_evidence > 0.55 then 'evidence' else 'nothing_usable' end as reason from p),
gated as (select *, case reason when 'contradicts_premise' then 'CONFLICT' when 'evidence' then 'EVIDENCE' else 'DROP' end as route from routed)"""


def _gated(t: Tables):
    """Long judgments of every event-passage, pivoted and routed by the gate."""
    asked = F.array(*[F.struct(F.lit(q).alias("qid"), prob(k).alias("value")) for k, q in zip(PRIMES, GATE_QUESTIONS, strict=True)])
    events = t.events.select(F.col("user_id").alias("question_id"), F.col("event_id").alias("id"), "event_type", "event_id")
    long = events.select("question_id", "id", F.explode(asked).alias("a")).select("question_id", "id", "a.qid", "a.value")
    return G.gate(events.drop("event_id"), long)


@query("passage_routes", f"with {SQL_ROUTE} select user_id as question_id, event_id as id, route, reason from gated")
def passage_routes(spark, path):
    return _gated(Tables(spark, path)).select("question_id", "id", "route", "reason")


@query(
    "gate_reason_counts",
    f"with {SQL_ROUTE} select event_type, route, reason, count(*) as n from gated group by all",
)
def gate_reason_counts(spark, path):
    return G.gate_counts(_gated(Tables(spark, path)), ["event_type"])


@query(
    "sufficiency_actions",
    f"""with e as (select event_id, case when event_id % 9 <> 0 then {sql_prob(17)} end as s, case when event_id % 9 <> 0 then {sql_prob(29)} end as c,
  event_id % 2 as round from events)
select event_id, case when s >= 0.55 then 'generate' when round < 1 then 'refine' else 'abstain' end as action,
  coalesce(s >= 0.55, false)::int as sufficient, coalesce(c >= 0.70, false)::int as conflicts, case when s is null then 'no_evidence' end as reason from e""",
)
def sufficiency_actions(spark, path):
    """Generate, refine or abstain; a ninth of the questions have no evidence."""
    there = F.col("event_id") % 9 != 0
    verdict = P.sufficiency(F.when(there, prob(17)), F.when(there, prob(29)), F.col("event_id") % 2)
    rows = Tables(spark, path).events.select("event_id", verdict.alias("v"))
    return rows.select("event_id", "v.action", F.col("v.sufficient").cast("int").alias("sufficient"), F.col("v.conflicts").cast("int").alias("conflicts"), "v.reason")


SQL_CHOICE = "list_extract(['supported', 'contradicted', 'unsupported'], (event_id % 3 + 1)::int)"


def _choice():
    return F.get(F.array(F.lit("supported"), F.lit("contradicted"), F.lit("unsupported")), (F.col("event_id") % 3).cast("int"))


@query(
    "claim_verdicts",
    f"""with e as (select event_id, {SQL_CHOICE} as choice, {sql_prob(43)} as confidence from events)
select event_id, case when confidence >= 0.8 and choice = 'supported' then 'keep' when confidence >= 0.8 and choice = 'contradicted' then 'conflict' else 'strip' end as verdict,
 case when confidence >= 0.8 and choice = 'supported' then null when confidence >= 0.8 and choice = 'contradicted' then 'contradicted'
  when choice = 'supported' then 'supported_low_confidence' when choice = 'contradicted' then 'contradicted_low_confidence' else 'unsupported' end as reason
from e""",
)
def claim_verdicts(spark, path):
    rows = Tables(spark, path).events.select("event_id", P.claim_verdict(_choice(), prob(43)).alias("v"))
    return rows.select("event_id", "v.verdict", "v.reason")


@query(
    "answer_outcomes",
    f"""with e as (select event_id, event_id % 3 as n_kept, case when event_id % 5 <> 0 then {sql_prob(61)} end as a, event_type from events)
select event_id, case when n_kept = 0 then 'no_claims_kept' when not coalesce(a >= 0.5, false) then 'answer_off_target' end as abstain_reason,
  case when n_kept > 0 and a >= 0.5 then event_type else '' end as answer from e""",
)
def answer_outcomes(spark, path):
    addresses = F.when(F.col("event_id") % 5 != 0, prob(61))
    out = P.answer_outcome(F.col("event_id") % 3, addresses, F.col("event_type"))
    return Tables(spark, path).events.select("event_id", out.alias("o")).select("event_id", "o.abstain_reason", "o.answer")


@query(
    "memory_admission",
    f"""with e as (select event_id, user_id, event_type, {sql_prob(83)} as confidence,
  case when event_id % 13 = 0 then ' [d1] ' else 'Claim on ' || event_type || ' number ' || event_id || ' [d1].' end as raw from events),
k as (select *, case when event_id % 13 = 0 then '' else 'Claim on ' || event_type || ' number ' || event_id || '.' end as text from e),
a as (select *, confidence >= 0.8 and text <> '' as ok from k)
select event_id, ok::int as admitted, case when not ok then 'below_memory_write_min' end as skip_reason,
  case when ok then 'vf_' || substr(sha1('u' || user_id || chr(10) || text), 1, 16) end as drawer_id, text,
  'number_' || event_type || '_' || event_id as room, 'd7,cite:d2' as evidence_drawer_ids from a""",
)
def memory_admission(spark, path):
    """Which kept claims are remembered, under which id and room."""
    e = F.col("event_id")
    said = F.format_string("Claim on %s number %d [d1].", "event_type", "event_id")
    claims = Tables(spark, path).events.select(
        e.alias("event_id"), F.format_string("u%d", "user_id").alias("question_id"),
        F.format_string("What is the number of %s in %d?", "event_type", "event_id").alias("query"), F.lit("judged").alias("arm"),
        F.lit("judge-1").alias("judge_model"), F.when(e % 13 == 0, " [d1] ").otherwise(said).alias("text"),
        F.array(F.lit("d1"), F.lit("d2")).alias("citations"), F.lit("supported").alias("choice"), prob(83).alias("confidence"),
        F.create_map(F.lit("d1"), F.lit("d7")).alias("cite_to_drawer"), F.lit("2026-09-19").alias("verified_at"),
    )
    keyed = D.admit_claims(claims.withColumn("arm", F.col("event_id").cast("string")))
    return keyed.select(
        F.col("arm").cast("bigint").alias("event_id"), F.col("admitted").cast("int").alias("admitted"), "skip_reason", "drawer_id", "text", "room", "evidence_drawer_ids"
    )


SQL_KIND = "list_extract(['chunk', 'snippet', 'drawer'], (event_id % 3 + 1)::int)"


def _kinds(t: Tables):
    kind = F.get(F.array(F.lit("chunk"), F.lit("snippet"), F.lit("drawer")), (F.col("id") % 3).cast("int"))
    return _gated(t).withColumn("kind", kind).select(
        "*", F.format_string("https://www.h%d.example.com/p", "question_id").alias("url"), (F.col("id") % 4).cast("int").alias("chunk_index"),
        F.col("event_type").alias("text"), F.format_string("dr%d", F.col("id") % 100).alias("drawer_id"),
    )


@query(
    "quarantined_chunks",
    f"""with {SQL_ROUTE} select 'qr_' || substr(sha1('https://www.h' || user_id || '.example.com/p' || chr(10) || event_id % 4), 1, 16) || '_c' || event_id % 4 as drawer_id,
  'h' || user_id || '.example.com' as room, event_type as text, contains_prompt_injection as injection_prob from gated
where reason = 'injection' and {SQL_KIND} = 'chunk'""",
)
def quarantined_chunks(spark, path):
    out = D.quarantine_drawers(_kinds(Tables(spark, path)))
    return out.select("drawer_id", "room", "text", F.col("meta")["injection_prob"].cast("double").alias("injection_prob"))


@query(
    "flagged_drawers",
    f"""with {SQL_ROUTE}, h as (select 'dr' || event_id % 100 as drawer_id, max(contains_prompt_injection) as p from gated
  where reason = 'injection' and {SQL_KIND} = 'drawer' group by 1)
select s.drawer_id, h.p as flagged_injection, 'u' as owner from (select distinct 'dr' || event_id % 200 as drawer_id from events) s left join h using (drawer_id)""",
)
def flagged_drawers(spark, path):
    """Stored drawers that tripped the gate on recall, marked in place."""
    t = Tables(spark, path)
    store = t.events.select(F.format_string("dr%d", F.col("event_id") % 200).alias("drawer_id")).distinct().withColumn(
        "meta", F.create_map(F.lit("owner"), F.lit("u"))
    )
    out = D.flag_drawers(store, _kinds(t), F.lit("2026-09-19T00:00:00Z"))
    return out.select("drawer_id", F.col("meta")["flagged_injection"].cast("double").alias("flagged_injection"), F.col("meta")["owner"].alias("owner"))


def _sheet(t: Tables):
    c = t.customer
    meta = F.create_map(
        F.lit("split"), F.when(F.col("c_custkey") % 2 == 0, "TEST").otherwise("DEV"), F.lit("fact_type"), F.col("c_mktsegment"),
        F.lit("false_premise"), F.when(F.col("c_acctbal") < 0, "true").otherwise("false"),
    )
    return c.select(F.col("c_custkey").alias("question_id"), meta.alias("metadata"))


@query(
    "question_slice",
    """select c_custkey as question_id from customer where c_custkey % 2 = 0 and c_mktsegment in ('BUILDING', 'MACHINERY') and c_acctbal >= 0""",
)
def question_slice(spark, path):
    return readers.select_questions(_sheet(Tables(spark, path)), "TEST", ("BUILDING", "MACHINERY"), False).select("question_id")


@query(
    "judge_states",
    """with d as (select doc_id, 'Question ' || source as q, md5(text) as t, source || '.org' as dom, doc_id % 2 = 0 as hits from documents)
select doc_id, 'intake' as kind, '{"query":"' || q || '","today":"2026-09-19","palace_has_verified_hits":' || hits || '}' as state from d
union all select doc_id, 'passage', '{"query":"' || q || '","passage":{"id":"m' || doc_id || '","title":"' || dom || '","domain":"palace","source_type":"'
  || case when hits then 'memory_verified' else 'memory_evidence' end || '","text":"' || t || '"}}' from d
union all select doc_id, 'claim', '{"query":"' || q || '","claim":"' || t || '","cited_evidence":[{"id":"m' || doc_id || '","text":"' || t || '"}]}' from d
union all select doc_id, 'answer', '{"query":"' || q || '","answer":"' || t || '"}' from d""",
)
def judge_states(spark, path):
    """What a judge is sent: intake, recalled passage, claim and answer, without provenance."""
    doc = F.col("doc_id")
    rows = Tables(spark, path).documents.select(
        "doc_id", F.concat(F.lit("Question "), "source").alias("query"), F.md5("text").alias("text"), F.concat("source", F.lit(".org")).alias("room"),
        (doc % 2 == 0).alias("hits"), F.format_string("m%d", doc).alias("cite_id"),
    )
    hits = rows.select(
        doc.alias("question_id"), "query", "cite_id", "text", "room", F.when(F.col("hits"), VERIFIED).otherwise(EVIDENCE).alias("wing"),
        F.col("cite_id").alias("drawer_id"), F.lit(0.5).alias("similarity"), F.lit(None).cast("string").alias("authored_at"),
    )
    passages = G.drawer_passages(hits).join(rows.select(doc.alias("question_id"), "doc_id", "query"), "question_id")
    cited = F.array(F.struct(F.col("cite_id").alias("id"), "text"))
    kinds = {
        "intake": (rows, G.intake_state(F.col("query"), F.lit("2026-09-19"), F.col("hits"))),
        "passage": (passages, G.gate_state(F.col("query"))),
        "claim": (rows, G.claim_state(F.col("query"), F.col("text"), cited)),
        "answer": (rows, G.answer_state(F.col("query"), F.col("text"))),
    }
    return union_all([df.select("doc_id", F.lit(kind).alias("kind"), F.to_json(state).alias("state")) for kind, (df, state) in kinds.items()])


@query(
    "seeded_sample",
    """select c_custkey as question_id from customer order by md5(c_custkey || '|20260919'), c_custkey limit 200""",
)
def seeded_sample(spark, path):
    """A reproducible uniform sample: the sampling operator itself."""
    return readers.seeded_sample(_sheet(Tables(spark, path)), 200, 20260919).select("question_id")


@query("questions_by_id", "select c_custkey as question_id from customer where c_custkey in (select o_custkey from orders where o_totalprice > 200000)")
def questions_by_id(spark, path):
    t = Tables(spark, path)
    wanted = t.orders.where(F.col("o_totalprice") > 200000).select(F.col("o_custkey").alias("question_id"))
    return readers.by_id(_sheet(t), wanted).select("question_id")
