"""Batch scoring with a cache, answer shaping, graders and the answering arms."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from weighbridge.catalog.base import Tables, prob, query, sql_prob
from weighbridge.catalog.snapshot_queries import SQL_CRAWL, SQL_LINKS
from weighbridge.functions import answers as A
from weighbridge.functions import ids as I
from weighbridge.operators import inference as V
from weighbridge.operators.ranking import dedup_results
from weighbridge.plans import arms as R
from weighbridge.plans import freeze as Z
from weighbridge.sources.readers import question_bank


def length_rule(batch: pd.DataFrame) -> pd.DataFrame:
    """Deterministic stand-in for a judge: the probability follows the text length."""
    size = batch["state"].str.len()
    rows = pd.DataFrame({"cache_key": batch["cache_key"], "model": batch["model"]})
    rows["answers"] = [json.dumps({"is_relevant": {"type": "noul", "noul": (int(n) % 101) / 100}}) for n in size]
    rows["input_tokens"] = size.astype("int64")
    rows["output_tokens"] = 1
    rows["error"] = [None if int(n) % 37 else "timeout" for n in size]
    rows.loc[rows["error"].notna(), "answers"] = None
    return rows


def _requests(t: Tables):
    """A request per document; exact copies of a text share one key."""
    return t.documents.select(
        "doc_id", F.lit("rule-1").alias("model"), F.col("text").alias("state"), F.sha2(F.concat_ws("\n", F.lit("rule-1"), "text"), 256).alias("cache_key")
    )


@query(
    "scored_requests",
    """with r as (select doc_id, sha256('rule-1' || chr(10) || text) as k, length(text) as n from documents),
c as (select distinct k from r where substr(k, 1, 1) < '8')
select doc_id, case when c.k is not null then 0.25 when n % 37 = 0 then 0.5 else (n % 101) / 100 end as p, (c.k is not null)::int as cached,
 (c.k is null and n % 37 = 0)::int as fallback, case when c.k is not null then 7 when n % 37 = 0 then 0 else n end as input_tokens
from r left join c using (k)""",
)
def scored_requests(spark, path):
    """Half the keys come from a cache table, equal requests are scored once, and a
    failed call becomes the marked do-not-know answer."""
    rows = _requests(Tables(spark, path))
    stored = '{"is_relevant":{"type":"noul","noul":0.25}}'
    cache = rows.where(F.left("cache_key", F.lit(1)) < "8").select(
        "cache_key", "model", F.lit(stored).alias("answers"), F.lit(7).cast("bigint").alias("input_tokens"),
        F.lit(1).cast("bigint").alias("output_tokens"), F.lit(False).alias("fallback"),
    ).dropDuplicates(["cache_key"])
    unsure = '{"is_relevant":{"type":"noul","noul":0.5}}'
    out = V.score_table(rows, cache, V.column_scorer(length_rule), fallback=unsure)
    p = A.parse_answers(F.col("answers"))["is_relevant"]["noul"]
    return out.select("doc_id", p.alias("p"), F.col("cached").cast("int").alias("cached"), F.col("fallback").cast("int").alias("fallback"), "input_tokens")


@query(
    "request_keys",
    """select c_custkey, sha256('{"model":"m \\"1\\"","questions":{"a":{"type":"noul"},"b":null},"state":{"name":"' || c_name || '","segment":"' || c_mktsegment || '"}}') as cache_key,
  substr(sha256('{"name":"' || c_name || '","segment":"' || c_mktsegment || '"}'), 1, 16) as state_id,
  substr(sha256('{"name": "' || c_name || '", "segment": "' || c_mktsegment || '"}'), 1, 16) as text_state_id from customer""",
)
def request_keys(spark, path):
    """Keys do not depend on field order, in typed columns or in JSON text."""
    rows = Tables(spark, path).customer.select(
        "c_custkey", F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name")).alias("state"),
        F.concat(F.lit('{"segment":"'), "c_mktsegment", F.lit('", "name": "'), "c_name", F.lit('"}')).alias("raw"),
    )
    state = I.canonical_json(rows, "state")
    questions = I.canonical_text(F.lit('{"b": null, "a": {"type": "noul"}}'))
    return rows.select(
        "c_custkey", I.cache_key(F.lit('m "1"'), state, questions).alias("cache_key"), I.state_fingerprint(state).alias("state_id"),
        I.state_fingerprint(I.canonical_text(F.col("raw"), compact=False)).alias("text_state_id"),
    )


@query(
    "parsed_answers",
    f"""select event_id, {sql_prob(17)} as noul, case when event_id % 2 = 0 then {sql_prob(29)} else 0 end as confidence, 0.7::double as top,
  'choice' as primitive, {sql_prob(43)} as score from events""",
)
def parsed_answers(spark, path):
    """Raw answer JSON to typed answers and their scalar values."""
    confident = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(',"confidence":'), prob(29).cast("string"))).otherwise("")
    raw = F.concat(
        F.lit('{"a":{"type":"noul","noul":'), prob(17).cast("string"), F.lit('},"b":{"type":"choice","choice":"x","probabilities":{"x":0.7,"y":0.3}'), confident,
        F.lit('},"c":{"type":"score","score":'), prob(43).cast("string"), F.lit("}}"),
    )
    rows = Tables(spark, path).events.select("event_id", A.parse_answers(raw).alias("m"))
    b = A.answer_value(F.col("m")["b"])
    return rows.select(
        "event_id", F.col("m")["a"]["noul"].alias("noul"), b["value"].alias("confidence"), b["probabilities"]["x"].alias("top"), b["primitive"].alias("primitive"),
        A.answer_value(F.col("m")["c"])["value"].alias("score"),
    )


@query(
    "normalised_answers",
    f"""with e as (select event_id, event_id % 4 as shape, {sql_prob(17)} as p from events)
select event_id, case shape when 0 then p when 1 then p else 0.5 end as noul,
  case shape when 0 then 'news' when 1 then case when p >= 0.5 then 'general' else 'news' end else 'general' end as choice,
  case shape when 0 then p when 1 then greatest(p, 1 - p) else 0 end as confidence, case shape when 3 then 0.5 else 0.25 end::double as score from e""",
)
def normalised_answers(spark, path):
    """Loosely keyed answers of four shapes, the last one empty."""
    shape, p = F.col("event_id") % 4, prob(17).cast("string")
    rest = (1 - prob(17)).cast("string")
    raw = (
        F.when(shape == 0, F.concat(F.lit('{"noul":'), p, F.lit(',"choice":"news","confidence":'), p, F.lit(',"score":0.25}')))
        .when(shape == 1, F.concat(F.lit('{"p_true":'), p, F.lit(',"probs":{"general":'), p, F.lit(',"news":'), rest, F.lit('},"expected":0.25}')))
        .when(shape == 2, F.lit('{"value":null,"expected":0.25}')).otherwise(F.lit("{}"))
    )
    options = F.array(F.lit("general"), F.lit("news"))
    noul, choice, score = (A.normalise_answer(raw, F.lit(k), options) for k in ("noul", "choice", "score"))
    return Tables(spark, path).events.select(
        "event_id", noul["noul"].alias("noul"), choice["choice"].alias("choice"), choice["confidence"].alias("confidence"), score["score"].alias("score")
    )


@query(
    "fallback_answers",
    """with q as (select * from (values ('needs_search', 'noul', 2), ('source', 'choice', 3), ('recency', 'choice', 5), ('category', 'choice', 4)) v(qid, type, n))
select event_id, qid, case when type = 'noul' then 0.5 end::double as noul, case qid when 'source' then 'web' when 'recency' then 'any' when 'category' then 'general' end as choice,
  case when type = 'choice' then 1.0::double / n end as confidence from events cross join q where event_type = 'error'""",
)
def fallback_answers(spark, path):
    """Failed requests joined to the question bank's do-not-know answers."""
    bank = question_bank(spark).where(F.col("stage") == "s0").select("stage", "qid", A.fallback_answer(F.col("type"), F.col("options")).alias("a"))
    failed = Tables(spark, path).events.where(F.col("event_type") == "error").select("event_id", F.lit("s0").alias("stage"))
    rows = failed.join(F.broadcast(bank), "stage")  # the bank has a fixed handful of rows
    return rows.select("event_id", "qid", "a.noul", "a.choice", "a.confidence")


def letter_rule(batch: pd.DataFrame) -> pd.DataFrame:
    size = batch["prompt"].str.len()
    return pd.DataFrame(
        {
            "cache_key": batch["cache_key"], "model": batch["model"],
            "reply": [("A", "B", "C", "well: A")[int(n) % 4] for n in size], "error": [None if int(n) % 29 else "timeout" for n in size],
        }
    )


@query(
    "graded_answers",
    """with a as (select conv_id, turn, text, length(text) as n, role = 'system' as abstained, turn % 5 = 4 as blank from conversations)
select conv_id, turn, case when abstained or blank then 'not_attempted' when n % 29 = 0 then null
  else list_extract(['correct', 'incorrect', 'not_attempted', 'correct'], (n % 4 + 1)::int) end as label from a""",
)
def graded_answers(spark, path):
    """Three-way grades: declined answers are never sent, failures stay ungraded."""
    rows = Tables(spark, path).conversations.select(
        "conv_id", "turn", F.lit("grader").alias("model"), F.col("text").alias("prompt"), I.grade_key(F.lit("grader"), F.col("text")).alias("cache_key"),
        F.when(F.col("turn") % 5 == 4, "  ").otherwise(F.col("text")).alias("answer"), (F.col("role") == "system").alias("abstained"),
    )
    cache = spark.createDataFrame([], "cache_key string, model string, reply string")
    return V.grade_table(rows, cache, V.column_scorer(letter_rule)).select("conv_id", "turn", "label")


def support_rule(batch: pd.DataFrame) -> pd.DataFrame:
    size = batch["prompt"].str.len()
    replies = ("SUPPORTED", "unsupported", "no idea")
    return pd.DataFrame(
        {"cache_key": batch["cache_key"], "model": batch["model"], "reply": [replies[int(n) % 3] for n in size], "error": [None if int(n) % 31 else "timeout" for n in size]}
    )


@query(
    "graded_claims",
    """with a as (select conv_id, turn, sha256(text) as k, length(text) as n from conversations),
g as (select *, substr(k, 1, 1) < '4' as hit from a)
select conv_id, turn, case when hit then 'supported' when n % 31 = 0 then 'unreadable' else list_extract(['supported', 'unsupported', 'unreadable'], (n % 3 + 1)::int) end as label,
  hit::int as cached, (not hit and n % 31 <> 0 and n % 3 <> 2)::int as stored from g""",
)
def graded_claims(spark, path):
    """Claim verdicts with a cache; unreadable replies are reported, never stored."""
    rows = Tables(spark, path).conversations.select(
        "conv_id", "turn", F.lit("grader").alias("model"), F.col("text").alias("prompt"), F.sha2("text", 256).alias("cache_key")
    )
    cache = rows.where(F.left("cache_key", F.lit(1)) < "4").select("cache_key", "model", F.lit("Supported.").alias("reply")).dropDuplicates(["cache_key"])
    graded = V.grade_claims(rows, cache, V.column_scorer(support_rule))
    stored = V.cacheable(graded, "claim").select("cache_key", F.lit(1).alias("stored"))
    return graded.join(stored, "cache_key", "left").select(
        "conv_id", "turn", "label", F.col("cached").cast("int").alias("cached"), F.coalesce("stored", F.lit(0)).alias("stored")
    )


# --- answering arms over the crawled pages ----------------------------------


def crawl_inputs(t: Tables):
    """Pages as results and chunks, 25 to a question, through the freeze plan."""
    pages, page = t.pages, F.col("page_id")
    question = F.concat(F.lit("q"), F.floor(page / 25).cast("string"))
    raw = pages.select(
        question.alias("question_id"), page.alias("pos"), "url", F.format_string("Page %d", page).alias("title"),
        F.col("url").alias("snippet"), F.array(F.lit("e1")).alias("engines"),
    )
    crawl = pages.select(
        "url", F.when(page % 10 == 3, 404).otherwise(200).alias("status"), F.lit("text/html").alias("content_type"),
        F.col("html").alias("body"), F.lit("2026-09-19T18:00:00Z").alias("fetched_at"),
    )
    results = dedup_results(raw)
    read = Z.read_pages(results, crawl)
    chunks = Z.page_chunks(read)
    counts = chunks.groupBy("question_id", "rank").agg(F.count(F.lit(1)).alias("n_chunks"))
    state = read.select("question_id", "rank", F.col("ok").alias("fetched")).join(counts, ["question_id", "rank"], "left")
    questions = results.select("question_id").distinct().select(
        "question_id", F.concat(F.lit("What about "), "question_id", F.lit("?")).alias("query"), F.lit("2026-09-19").alias("today"),
        F.lit(False).alias("has_verified_hits"), F.lit(False).alias("force_search"), F.lit(False).alias("force_web"),
    )
    return questions, results, state, chunks


def quoting_generator(prompts, purpose):
    """Answers by quoting the ids it was shown, so the citation rules have work."""
    ids = F.regexp_extract_all("prompt", F.lit(r"(?m)^\[([rmp][0-9]+(?:[cs][0-9]*)?)\] "), F.lit(1))
    said = F.transform(ids, lambda i: F.concat(F.lit("Page "), i, F.lit(" states it in 2024 ["), i, F.lit("].")))
    reply = F.concat(F.array_join(said, " "), F.lit(" Perhaps [r99c9]. It was seen in Paris."))
    if purpose == "refine":
        reply = F.concat(F.lit('query: "'), F.col("prompt"), F.lit('"'))
    if purpose == "plain":
        reply = F.concat(F.lit("I think: "), F.col("prompt"))
    return prompts.select("question_id", reply.alias("reply"))


@query("plain_answers", "select 'q' || k as question_id, 'I think: What about q' || k || '?' as answer from (select distinct page_id // 25 as k from pages)")
def plain_answers(spark, path):
    """The generator alone."""
    questions, *_ = crawl_inputs(Tables(spark, path))
    return R.plain_arm(questions, quoting_generator).select("question_id", "answer")


OWN_LINKS = """
links as (select 'q' || page_id // 25 as question_id, page_id as pos, url from pages)"""
SQL_PAGES = SQL_CRAWL.replace(SQL_LINKS, OWN_LINKS)


@query(
    "baseline_answers",
    f"""with {SQL_PAGES},
cand as (
  select question_id, rank, chunk_index, cite_id, n_tokens from chunks where rank <= 8
  union all select question_id, rank, 0, 'r' || lpad(rank::varchar, 2, '0') || 's', len(regexp_extract_all(url, '\\S+')) from results
  where rank <= 8 and url <> '' and (question_id, rank) not in (select question_id, rank from chunks)),
used as (select * from (select *, sum(n_tokens) over (partition by question_id order by rank, chunk_index) as used from cand) where used <= 12000),
said as (select question_id, string_agg('Page ' || cite_id || ' states it in 2024 [' || cite_id || '].', ' ' order by rank, chunk_index) as told,
  count(*)::int as n, count(distinct rank) as n_pages, sum(n_tokens)::bigint as tokens from used group by 1)
select q.question_id, (s.n is null)::int as abstained, case when s.n is null then '' else told || ' It was seen in Paris.' end as answer,
  (s.n is not null)::int as fabricated_citations, coalesce(s.n, 0) as n_claims, coalesce(n_pages, 0) as n_evidence_pages,
  coalesce(s.n, 0) as n_evidence_chunks, coalesce(tokens, 0) as evidence_tokens
from (select distinct question_id from results) q left join said s using (question_id)""",
)
def baseline_answers(spark, path):
    """First pages stuffed to the budget, answered and post-processed."""
    questions, results, _, chunks = crawl_inputs(Tables(spark, path))
    out = R.baseline_arm(questions, results, chunks, quoting_generator)
    return out.select(
        "question_id", F.col("abstained").cast("int").alias("abstained"), "answer", "fabricated_citations", F.size("claims").alias("n_claims"), "n_evidence_pages", "n_evidence_chunks", "evidence_tokens"
    )
