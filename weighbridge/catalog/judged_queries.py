"""The judged plan end to end, with rules in place of the models: one pass, another judge,
two passes over a store in versions, and threshold replay of the plan's own records."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weighbridge.catalog.base import Tables, query
from weighbridge.catalog.inference_queries import SQL_PAGES, crawl_inputs, quoting_generator
from weighbridge.catalog.text_queries import cap, clean
from weighbridge.operators.grouped import first_rows, top_rows
from weighbridge.operators.scoring import pass_delta, usage_rollup
from weighbridge.operators.store import evidence_drawers
from weighbridge.operators.versions import VersionedStore
from weighbridge.plans import arms as R
from weighbridge.plans import memory as M
from weighbridge.plans.replay_gates import replay_gates
from weighbridge.settings import GATE_QUESTIONS
from weighbridge.stages import stage_dir

TODAY = "2026-09-19"
GATE_RULE = list(zip(GATE_QUESTIONS, (1, 3, 7, 11, 13), (60, 80, 130, 140, 135), strict=True))


def _number(text: Column) -> Column:
    return F.conv(F.left(F.md5(text), F.lit(4)), 16, 10).cast("int")


def rule_judge(salt: str) -> R.Judge:
    """A judge as a rule over the request's state, with no model behind it; another salt is another judge."""

    def judge(requests: DataFrame, stage: str) -> DataFrame:
        s = F.col("state")
        said = {
            "s0": lambda: [s["query"]],
            "s1": lambda: [s["query"], s["passage"]["id"], s["passage"]["text"]],
            "s2": lambda: [s["query"], F.array_join(F.transform(s["evidence"], lambda e: e["id"]), ",")],
            "s4_claim": lambda: [s["query"], s["claim"]],
            "s4_answer": lambda: [s["query"], s["answer"]],
        }[stage]()
        text = F.concat_ws("|", F.lit(salt), F.lit(stage), *said)
        rows = requests.select("question_id", "id", _number(text).alias("_h"), F.length(text).cast("bigint").alias("input_tokens"))
        h, none = F.col("_h"), F.lit(None)

        def answer(qid: str, value=none, choice=none, confidence=none) -> Column:
            return F.struct(F.lit(qid).alias("qid"), value.cast("double").alias("value"), choice.cast("string").alias("choice"), confidence.cast("double").alias("confidence"))

        source = F.get(F.array(F.lit("web"), F.lit("palace"), F.lit("both")), h % 3)
        support = F.when(h % 4 == 0, "unsupported").otherwise("supported")
        asked = {
            "s0": lambda: [
                answer("needs_search", h % 101 / 60.0), answer("source", choice=source, confidence=(h % 60 + 30) / 100.0),
                answer("recency", choice=F.lit("any"), confidence=F.lit(0.9)), answer("category", choice=F.lit("general"), confidence=F.lit(0.9)),
            ],
            "s1": lambda: [answer(q, (h * k) % 101 / float(d)) for q, k, d in GATE_RULE],
            "s2": lambda: [answer("evidence_sufficient", h % 101 / 60.0), answer("evidence_conflicts", h % 7 / 7.0)],
            "s4_claim": lambda: [answer("support", choice=support, confidence=(h % 30 + 75) / 100)],
            "s4_answer": lambda: [answer("answer_addresses_query", h % 101 / 70.0)],
        }[stage]()
        usage = [F.lit(False).alias("cached"), "input_tokens", F.lit(1).cast("bigint").alias("output_tokens")]
        return rows.select("question_id", "id", F.explode(F.array(*asked)).alias("a"), *usage).select("question_id", "id", "a.*", "cached", "input_tokens", "output_tokens")

    return judge


# --- the same plan in SQL -----------------------------------------------------

SQL_STATE = """
state as (select p.question_id, p.rank, p.ok and coalesce(c.n, 0) > 0 as good from pgs p
  left join (select question_id, rank, count(*) as n from chunks group by 1, 2) c on c.question_id = p.question_id and c.rank = p.rank),
qs as (select distinct question_id, 'What about ' || question_id || '?' as query from results)"""


def _h(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 4))::int"


def _gated_sql(name: str, source: str, salt: str, p: str) -> str:
    """Passages of ``source`` with the five probabilities, route and reason."""
    values = ", ".join(f"((h * {k}) % 101) / {d}::double as {q}" for q, k, d in GATE_RULE)
    number = _h(f"'{salt}|s1|' || s.query || '|' || x.id || '|' || x.text")
    return f"""
{p}{name} as (select *, case reason when 'contradicts_premise' then 'CONFLICT' when 'evidence' then 'EVIDENCE' else 'DROP' end as route from (
  select *, case when contains_prompt_injection > 0.70 then 'injection' when is_promotional_or_boilerplate > 0.70 then 'boilerplate'
    when is_relevant < 0.45 then 'off_topic' when contradicts_query_premise > 0.70 then 'contradicts_premise'
    when contains_answer_evidence > 0.55 then 'evidence' else 'nothing_usable' end as reason
  from (select *, {values} from (select x.*, {number} as h, length('{salt}|s1|' || s.query || '|' || x.id || '|' || x.text) as said
    from {source} x join {p}s0 s on s.question_id = x.question_id)))),"""


def _selected_sql(name: str, source: str, p: str) -> str:
    """Fusion and evidence budget over the evidence of ``source``."""
    return f"""
{p}{name} as (select * from (
  select *, sum(tok) over (partition by question_id order by position) as used from (
    select *, row_number() over (partition by question_id order by score desc, best, id) as position from (
      select *, coalesce(1.0::double / (60 + r1), 0) + coalesce(1.0::double / (60 + r2), 0) + coalesce(1.0::double / (60 + r3), 0) as score, least(r1, r2, r3) as best,
        coalesce(nullif(n_tokens, 0), len(regexp_extract_all(text, '\\S+'))) as tok
      from (select *, case when engine_rank is not null then rank() over (partition by question_id, engine_rank is null order by engine_rank, n_engines desc) end as r1,
        case when similarity is not null then rank() over (partition by question_id, similarity is null order by similarity desc) end as r2,
        rank() over (partition by question_id order by contains_answer_evidence desc) as r3 from {source} where route = 'EVIDENCE')))
  where position <= 6) where used <= 2500),"""


def _sufficient_sql(name: str, queries: str, selected: str, last: bool, salt: str, p: str) -> str:
    told = f"'{salt}|s2|' || query || '|' || ids"
    return f"""
{p}{name} as (select *, case when coalesce(s >= 0.55, false) then 'generate' else '{'abstain' if last else 'refine'}' end as action from (
  select *, ({_h(told)} % 101) / 60.0::double as s, length({told}) as said from (
    select q.question_id, q.query, e.ids from {queries} q left join (select question_id, string_agg(id, ',' order by position) as ids from {selected} group by 1) e
      on e.question_id = q.question_id))),"""


def _hits_sql(wing: str, order: int, drawers: str, p: str) -> str:
    def vector(x):
        return f"list_transform(range(8), lambda i: ('0x' || substr(md5({x}), (i + 1)::int, 1))::int::double)"

    return f"""select *, {order} as lane from (select s.question_id, d.drawer_id, d.wing, d.room, d.text,
      list_cosine_similarity({vector('s.query')}, {vector('d.drawer_id')}) as similarity,
      row_number() over (partition by s.question_id order by round(list_cosine_similarity({vector('s.query')}, {vector('d.drawer_id')}), 12) desc, d.drawer_id) as place
      from {p}lane s cross join {drawers} d where d.wing = '{wing}') where place <= 10 and 1 - similarity <= 0.6"""


def judged_sql(salt: str, arm: str, p: str, verified: str = "false", drawers: str | None = None) -> str:
    """CTEs of a judged pass; their names begin with ``p``. ``verified`` tells whether the store has
    verified hits for question q, ``drawers`` is the store as the pass sees it."""
    chunk = f"c.question_id, c.cite_id as id, {cap(clean('c.text'), 1800)} as text, c.rank as engine_rank, 1 as n_engines, c.drawer_id, c.n_tokens, c.url, c.chunk_index"
    columns = "question_id, id, text, engine_rank, n_engines, similarity, drawer_id, n_tokens, url, chunk_index, route, reason, contradicts_query_premise, contains_answer_evidence, contains_prompt_injection, said"
    memory = "" if drawers is None else f"""
{p}lane as (select question_id, query from {p}s0 where retrieve and source in ('palace', 'both')),
{p}found as (select *, 'm' || lpad((row_number() over (partition by question_id order by lane, round(similarity, 12) desc, drawer_id))::varchar, 2, '0') as cite_id from (
    {_hits_sql('verified', 0, drawers, p)} union all {_hits_sql('evidence', 1, drawers, p)})),
{p}recalled as (select question_id, cite_id as id, {cap(clean('text'), 1800)} as text, null::bigint as engine_rank, null::int as n_engines, similarity, drawer_id, null::bigint as n_tokens,
  null::varchar as url, null::bigint as chunk_index from {p}found),{_gated_sql('memg', f'{p}recalled', salt, p)}"""
    recalled = "" if drawers is None else f" union all select {columns} from {p}memg"
    claim = "'Page ' || id || ' states it in 2024 [' || id || '].'"
    return f"""
{p}s0 as (select question_id, query, hv, said, retrieve, sj as source from (select *, (h % 101) / 60.0::double >= 0.5 as retrieve,
  case when (h % 60 + 30) / 100.0::double < 0.5 then 'both' when h % 3 = 0 then 'web' when h % 3 = 2 then 'both' when not hv then 'both' else 'palace' end as sj
  from (select *, {verified} as hv, {_h(f"'{salt}|s0|' || query")} as h, length('{salt}|s0|' || query) as said from qs q))),
{p}snip as (select r.question_id, 'r' || lpad(r.rank::varchar, 2, '0') || 's' as id, {cap(clean('r.url'), 1800)} as text, r.rank as engine_rank, 1 as n_engines, r.url
  from results r join {p}s0 s on s.question_id = r.question_id where retrieve and source in ('web', 'both')),{_gated_sql('snipg', f'{p}snip', salt, p)}
{p}pick as (select s.*, coalesce(good, false) as readable from (select *, row_number() over (partition by question_id order by engine_rank, id) as pick from {p}snipg where route <> 'DROP') s
  left join state t on t.question_id = s.question_id and t.rank = s.engine_rank where pick <= 5),
{p}ch as (select {chunk}, null::double as similarity from chunks c join {p}pick k on k.question_id = c.question_id and k.engine_rank = c.rank where readable),{_gated_sql('chg', f'{p}ch', salt, p)}{memory}
{p}all as (select {columns} from {p}chg union all
  select {columns} from (select *, null::double as similarity, null::varchar as drawer_id, null::bigint as n_tokens, null::bigint as chunk_index from {p}pick where not readable){recalled}),
{p}usable as (select * from {p}all where route <> 'DROP'),{_selected_sql('sel0', f'{p}usable', p)}
{p}asked as (select question_id, query from {p}s0 where retrieve),{_sufficient_sql('r0', f'{p}asked', f'{p}sel0', False, salt, p)}
{p}again as (select question_id, query from {p}r0 where action = 'refine'),
{p}hits as (select * from (select c.*, 1 - c.rank / 100.0::double as sim, row_number() over (partition by c.question_id order by c.rank, c.chunk_index) as position
  from chunks c join {p}again a on a.question_id = c.question_id where c.rank > 5) where position <= 10),
{p}unread as (select {chunk}, c.sim as similarity from {p}hits c where not exists (select 1 from {p}all a where a.question_id = c.question_id and a.id = c.cite_id)),{_gated_sql('newg', f'{p}unread', salt, p)}
{p}rows as (select u.* replace (coalesce(h.sim, u.similarity) as similarity) from {p}usable u left join {p}hits h on h.question_id = u.question_id and h.cite_id = u.id
  union all select {columns} from {p}newg where route <> 'DROP'),
{p}second as (select r.* from {p}rows r join {p}again a on a.question_id = r.question_id),{_selected_sql('sel1', f'{p}second', p)}{_sufficient_sql('r1', f'{p}again', f'{p}sel1', True, salt, p)}
{p}verdict as (select question_id, query, action from {p}r0 where action <> 'refine' union all select question_id, query, action from {p}r1),
{p}shown as (select question_id, 0 as part, position, id, drawer_id from {p}sel0 where question_id in (select question_id from {p}r0 where action <> 'refine')
  union all select question_id, 0, position, id, drawer_id from {p}sel1
  union all select question_id, 1, position, id, drawer_id from (select *, row_number() over (partition by question_id order by coalesce(contradicts_query_premise, 0) desc, id) as position from {p}rows where route = 'CONFLICT') where position <= 6),
{p}claims as (select *, case when choice = 'supported' and confidence >= 0.8 then 'keep' else 'strip' end as verdict, case choice when 'supported' then 'supported_low_confidence' else 'unsupported' end as reason from (
  select *, case when h % 4 = 0 then 'unsupported' else 'supported' end as choice, (h % 30 + 75) / 100::double as confidence from (
    select v.question_id, v.query, row_number() over (partition by v.question_id order by part, position) as pos, id, drawer_id, {claim} as text,
      {_h(f"'{salt}|s4_claim|' || v.query || '|' || {claim}")} as h, length('{salt}|s4_claim|' || v.query || '|' || {claim}) as said
    from {p}verdict v join {p}shown s on s.question_id = v.question_id where v.action = 'generate'))),
{p}made as (select question_id, query, count(*) filter (verdict = 'keep') as n_kept, coalesce(string_agg(text, ' ' order by pos) filter (verdict = 'keep'), '') as rebuilt,
  coalesce(string_agg(text || '|' || choice || '|' || round(confidence * 100)::int, ';' order by pos) filter (verdict = 'keep'), '') as claims,
  'Perhaps [r99c9].|fabricated_citation|;It was seen in Paris.|uncited_claim|' || coalesce(string_agg(';' || text || '|' || reason || '|' || round(confidence * 100)::int, '' order by pos) filter (verdict = 'strip'), '') as stripped
  from {p}claims group by 1, 2),
{p}checked as (select *, ({_h(f"'{salt}|s4_answer|' || query || '|' || rebuilt")} % 101) / 70.0::double >= 0.5 as on_target, length('{salt}|s4_answer|' || query || '|' || rebuilt) as said from {p}made),
{p}ids as (select question_id, string_agg(id, ',' order by id) as evidence_ids from {p}shown group by 1),
{p}records as (select s.question_id, '{arm}' as arm,
  case when not retrieve then false when v.action = 'abstain' then true else n_kept = 0 or not on_target end as abstained,
  case when not retrieve then null when v.action = 'abstain' then 'insufficient_evidence' when n_kept = 0 then 'no_claims_kept' when not on_target then 'answer_off_target' end as abstain_reason,
  case when not retrieve then 'I think: ' || s.query when v.action = 'generate' and n_kept > 0 and on_target then rebuilt else '' end as answer,
  case when v.action = 'generate' then 1 else 0 end as fabricated_citations, case when retrieve then coalesce(i.evidence_ids, '') else '' end as evidence_ids,
  coalesce(c.claims, '') as claims, coalesce(c.stripped, '') as stripped
  from {p}s0 s left join {p}verdict v on v.question_id = s.question_id left join {p}checked c on c.question_id = s.question_id left join {p}ids i on i.question_id = s.question_id)"""


# --- runs ---------------------------------------------------------------------


def _run_inputs(spark, path: str) -> dict:
    questions, results, pages, chunks = crawl_inputs(Tables(spark, path))
    stages = R.Stages.open(questions)
    kept = {name: stages.keep(df, name) for name, df in (("questions", questions), ("results", results), ("pages", pages), ("chunks", chunks))}
    chunks = kept["chunks"]

    def recall(queries):
        """Second look: the question's later chunks, nearest rank first."""
        ranked = chunks.join(queries.select("question_id"), "question_id", "left_semi").where(F.col("rank") > 5)
        hits = top_rows(ranked, ["question_id"], [F.asc("rank"), F.asc("chunk_index")], 10)
        return hits.select("question_id", "drawer_id", (1 - F.col("rank") / 100).alias("similarity"), "position", "text", "url")

    return kept | {"generator": quoting_generator, "recall": recall}


def _support(item: Column) -> Column:
    return F.coalesce(F.round(item["support"]["confidence"] * 100).cast("int").cast("string"), F.lit(""))


def _told(records: DataFrame) -> DataFrame:
    """Whole records, their lists as text."""
    claims = F.transform("claims", lambda c: F.concat_ws("|", c["text"], c["support"]["choice"], _support(c)))
    stripped = F.transform("stripped", lambda s: F.concat_ws("|", s["sentence"], s["reason"], _support(s)))
    return records.select(
        "question_id", "arm", F.col("abstained").cast("int").alias("abstained"), "abstain_reason", "answer", "fabricated_citations",
        F.array_join("evidence_ids", ",").alias("evidence_ids"), F.array_join(claims, ";").alias("claims"), F.array_join(stripped, ";").alias("stripped"),
    )


RECORD_COLUMNS = "question_id, arm, abstained::int as abstained, abstain_reason, answer, fabricated_citations, evidence_ids, claims, stripped"


@query("judged_answers", f"with {SQL_PAGES}, {SQL_STATE}, {judged_sql('a', 'judged', 'j_')} select {RECORD_COLUMNS} from j_records")
def judged_answers(spark, path):
    """The full judged plan with rules in place of the models; whole records."""
    return _told(R.judged_arm(**_run_inputs(spark, path), judge=rule_judge("a"))["records"])


@query("self_judged_answers", f"with {SQL_PAGES}, {SQL_STATE}, {judged_sql('b', 'self', 'j_')} select {RECORD_COLUMNS} from j_records")
def self_judged_answers(spark, path):
    """The same plan under another judge."""
    return _told(R.judged_arm(**_run_inputs(spark, path), judge=rule_judge("b"), arm="self")["records"])


@query(
    "judged_usage",
    f"""with {SQL_PAGES}, {SQL_STATE}, {judged_sql('a', 'judged', 'j_')},
u as (select 's0' as stage, said from j_s0 union all select 's1', said from j_snipg union all select 's1', said from j_chg union all select 's1', said from j_newg
  union all select 's2', said from j_r0 where ids is not null union all select 's2', said from j_r1 where ids is not null
  union all select 's4', said from j_claims union all select 's4', said from j_checked where n_kept > 0)
select stage, count(*) as n_requests, sum(said)::bigint as input_tokens from u group by stage""",
)
def judged_usage(spark, path):
    """Requests and tokens of a judged run by stage, counted from its own judgments."""
    usage = R.judged_arm(**_run_inputs(spark, path), judge=rule_judge("a"))["usage"]
    rolled = usage_rollup(usage, ["stage"])
    return rolled.where("stage is not null").select("stage", "n_requests", "input_tokens")


# --- threshold replay of the run's own records --------------------------------

SQL_LABEL = "list_extract(['correct', 'incorrect', 'not_attempted'], (length(answer) % 3 + 1)::int)"


@query(
    "judged_gate_replay",
    f"""with {SQL_PAGES}, {SQL_STATE}, {judged_sql('a', 'judged', 'j_')},
r as (select question_id, abstained, case when abstained then 'not_attempted' else {SQL_LABEL} end as label from j_records),
low as (select c.question_id, c.confidence, r.abstained from j_claims c join r on r.question_id = c.question_id where verdict = 'strip' and reason = 'supported_low_confidence'),
kept as (select c.confidence, {_h("c.text")} % 3 = 0 as unsupported from j_claims c where verdict = 'keep'),
other as (select question_id, case when question_id < 'q2' then 'correct' else 'incorrect' end as label from r),
base as (select count(*) as n, count(*) filter (label = 'correct') as correct, count(*) filter (label = 'incorrect') as incorrect from r),
up as (select 'raise' as side, t.range / 100.0::double as threshold, count(*) filter (confidence >= t.range / 100.0::double) as claims,
    count(*) filter (confidence >= t.range / 100.0::double and unsupported) as part, null::double as ceiling from range(80, 101, 2) t cross join kept group by 2),
down as (select 'lower' as side, t.range / 100.0::double as threshold, count(*) filter (confidence >= t.range / 100.0::double) as claims,
    count(distinct l.question_id) filter (confidence >= t.range / 100.0::double and abstained) as part,
    round(((any_value(correct) + count(distinct l.question_id) filter (confidence >= t.range / 100.0::double and abstained and o.label = 'correct'))
      - (any_value(incorrect) + count(distinct l.question_id) filter (confidence >= t.range / 100.0::double and abstained and o.label = 'incorrect'))) / any_value(n), 4) as ceiling
  from range(0, 81, 5) t cross join low l join other o on o.question_id = l.question_id cross join base group by 2)
select * from up union all select * from down""",
)
def judged_gate_replay(spark, path):
    """What other support thresholds would have done to a judged run's own records."""
    records = R.judged_arm(**_run_inputs(spark, path), judge=rule_judge("a"))["records"]
    label = F.when(F.col("abstained"), "not_attempted").otherwise(F.get(F.array(F.lit("correct"), F.lit("incorrect"), F.lit("not_attempted")), F.length("answer") % 3))
    graded = records.withColumn("grade", F.struct(label.alias("label"))).withColumn(
        "claim_support", F.transform("claims", lambda c: F.struct(F.when(_number(c["text"]) % 3 == 0, "unsupported").otherwise("supported").alias("label")))
    )
    baseline = records.select("question_id", F.struct(F.when(F.col("question_id") < "q2", "correct").otherwise("incorrect").alias("label")).alias("grade"))
    out = replay_gates(graded, baseline)
    up = out["raise_gate_curve"].select(F.lit("raise").alias("side"), "threshold", F.col("kept").alias("claims"), F.col("unsupported").alias("part"), F.lit(None).cast("double").alias("ceiling"))
    down = out["proxy_ceiling"].select(F.lit("lower").alias("side"), "threshold", "claims", F.col("questions").alias("part"), "ceiling")
    return up.unionByName(down)


# --- two passes over a store in versions ----------------------------------------

SQL_STORE = """
v1 as (select drawer_id, 'evidence' as wing, host as room, text from (
  select *, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\\.', '') as host, row_number() over (partition by drawer_id order by question_id, rank) as rn from chunks) where rn = 1)"""
SQL_LEFT = """
vf as (select 'vf_' || substr(sha1(question_id || chr(10) || 'Page ' || id || ' states it in 2024.'), 1, 16) as drawer_id, 'verified' as wing, question_id as room,
  'Page ' || id || ' states it in 2024.' as text from a_claims where verdict = 'keep'),
qr as (select 'qr_' || substr(sha1(url || chr(10) || chunk_index), 1, 16) || '_c' || chunk_index as drawer_id, 'quarantine' as wing, min(text) as text from a_chg where reason = 'injection' group by 1, 2),
flagged as (select drawer_id, max(contains_prompt_injection) as p from a_memg where reason = 'injection' group by 1),
v2 as (select drawer_id, wing, room, text from v1 union all select * from vf)"""
SQL_VECTOR = "list_transform(range(8), lambda i: ('0x' || substr(md5({}), (i + 1)::int, 1))::int::double)"
SQL_VERIFIED = f"exists (select 1 from vf where 1 - list_cosine_similarity({SQL_VECTOR.format('q.query')}, {SQL_VECTOR.format('vf.drawer_id')}) <= 0.6)"


def _vector(text: Column) -> Column:
    """Eight numbers from a digest, in place of an embedding model."""
    digest = F.md5(text)
    return F.array(*[F.conv(F.substring(digest, i, 1), 16, 10).cast("double") for i in range(1, 9)])


def _first_pass(spark, path: str):
    """The store with the frozen chunks' version and the next one, which pass one has left; pass one, and how to run pass two."""
    inputs = _run_inputs(spark, path)
    store = VersionedStore(f"{stage_dir(spark)}/memory-{uuid.uuid4().hex}")
    chunks = inputs["chunks"].withColumn("fetched_at", F.lit(f"{TODAY}T18:00:00Z"))
    chunks = first_rows(chunks, ["drawer_id"], [F.asc("question_id"), F.asc("rank"), F.asc("text")])
    first = store.commit(evidence_drawers(chunks), [F.asc("drawer_id")], stamp="freeze")
    arm = {k: v for k, v in inputs.items() if k != "questions"} | {"judge": rule_judge("a"), "judge_model": "rules"}
    embed, asked = _vector(F.col("drawer_id")), _vector(F.col("query"))

    def run(at: int) -> dict[str, DataFrame]:
        return M.memory_pass(inputs["questions"], store, embed, asked, at=at, **arm)

    one = run(first)
    second = M.file_run(store, one, TODAY, stamp="pass-one")
    return store, one, lambda: run(second)


def _two_passes(spark, path: str):
    """Pass one reads the frozen chunks' version, leaves the next one, which pass two reads."""
    store, one, again = _first_pass(spark, path)
    return store, one, again()


@query(
    "memory_passes",
    f"""with {SQL_PAGES}, {SQL_STATE}, {SQL_STORE}, {judged_sql('a', 'judged', 'a_', drawers='v1')}, {SQL_LEFT}, {judged_sql('a', 'judged', 'b_', verified=SQL_VERIFIED, drawers='v2')}
select x.question_id, x.abstain_reason as reason_before, y.abstain_reason as reason_after, x.answer as answer_before, y.answer as answer_after, y.evidence_ids,
  (y.abstained::int - x.abstained::int) as abstained_delta, s.hv::int as has_verified_hits from a_records x join b_records y using (question_id) join b_s0 s using (question_id)""",
)
def memory_passes(spark, path):
    """A judged pass, filed into the store, and a second one that reads what the first has left."""
    _, one, two = _two_passes(spark, path)
    known = two["questions"].select("question_id", F.col("has_verified_hits").cast("int").alias("has_verified_hits"))
    before = one["records"].select("question_id", F.col("abstain_reason").alias("reason_before"), F.col("answer").alias("answer_before"))
    after = two["records"].select("question_id", F.col("abstain_reason").alias("reason_after"), F.col("answer").alias("answer_after"), F.array_join("evidence_ids", ",").alias("evidence_ids"))
    declined = [r["records"].select("question_id", F.col("abstained").cast("int").alias("abstained")) for r in (one, two)]
    delta = pass_delta(*declined, ["question_id"], ["abstained"]).select("question_id", "abstained_delta")
    return before.join(after, "question_id").join(delta, "question_id").join(known, "question_id")


@query(
    "store_versions",
    f"""with {SQL_PAGES}, {SQL_STATE}, {SQL_STORE}, {judged_sql('a', 'judged', 'a_', drawers='v1')}, {SQL_LEFT},
d as (select 1 as snapshot, drawer_id, wing, text from v1 union all select 2, drawer_id, wing, text from vf union all select 2, drawer_id, wing, text from qr)
select drawer_id, d.wing, snapshot, md5(d.text) as digest, f.p as flagged_injection from d left join flagged f using (drawer_id)""",
)
def store_versions(spark, path):
    """The store after a judged pass: which version filed a drawer, and which recalled ones are flagged."""
    store, *_ = _first_pass(spark, path)
    flag = F.col("meta")["flagged_injection"].cast("double")
    return store.read(spark).select("drawer_id", "wing", "snapshot", F.md5("text").alias("digest"), flag.alias("flagged_injection"))
