"""Rank lists, fusion, budgets and page picks over order lines as passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from weighbridge.catalog.base import CANDIDATES, Tables, candidates, query
from weighbridge.operators import ranking as R
from weighbridge.operators.grouped import competition_ranks, top_rows

SQL_RANKS = """
ranks as (
  select *, case when engine_rank is not null then rank() over (partition by question_id, engine_rank is null order by engine_rank, n_engines desc) end as retriever_rank,
    case when similarity is not null then rank() over (partition by question_id, similarity is null order by similarity desc) end as memory_rank,
    case when evidence is not null then rank() over (partition by question_id, evidence is null order by evidence desc) end as evidence_rank
  from candidates
)"""
SQL_FUSED = f"""{SQL_RANKS},
fused as (
  select *, coalesce(1.0::double / (60 + retriever_rank), 0) + coalesce(1.0::double / (60 + memory_rank), 0)
         + coalesce(1.0::double / (60 + evidence_rank), 0) as rrf_score,
         least(retriever_rank, memory_rank, evidence_rank) as best_rank
  from ranks
)"""


@query("rank_lists", f"with {CANDIDATES}, {SQL_RANKS} select question_id, id, retriever_rank, memory_rank, evidence_rank from ranks")
def rank_lists(spark, path):
    ranked = competition_ranks(candidates(Tables(spark, path)), ["question_id"], R.rank_lists())
    return ranked.select("question_id", "id", "retriever_rank", "memory_rank", "evidence_rank")


@query(
    "rank_lists_hot_groups",
    f"""with {CANDIDATES}, g as (select line as grp, question_id, id, evidence, similarity from candidates)
select grp, question_id, id, rank() over (partition by grp order by evidence desc) as evidence_rank,
  case when similarity is not null then rank() over (partition by grp, similarity is null order by similarity desc) end as memory_rank from g""",
)
def rank_lists_hot_groups(spark, path):
    """Seven groups that each hold a seventh of all rows: ranked from key counts."""
    rows = candidates(Tables(spark, path)).select(F.col("line").alias("grp"), "question_id", "id", "evidence", "similarity")
    ranked = competition_ranks(rows, ["grp"], R.rank_lists()[1:])
    return ranked.select("grp", "question_id", "id", "evidence_rank", "memory_rank")


@query(
    "rank_fusion",
    f"with {CANDIDATES}, {SQL_FUSED} select question_id, id, round(rrf_score, 9) as rrf_score, best_rank from fused where best_rank is not null",
)
def rank_fusion(spark, path):
    fused = R.fuse(candidates(Tables(spark, path)))
    return fused.select("question_id", "id", F.round("rrf_score", 9).alias("rrf_score"), "best_rank")


@query(
    "evidence_budget",
    f"""with {CANDIDATES}, {SQL_FUSED},
o as (select *, row_number() over (partition by question_id order by rrf_score desc, best_rank, id) as position from fused),
s as (select *, sum(n_tokens) over (partition by question_id order by position) as used_tokens from o where position <= 6)
select question_id, id, position, n_tokens, used_tokens::bigint as used_tokens from s where used_tokens <= 2500""",
)
def evidence_budget(spark, path):
    """Top passages within the token budget, stopping at the first overflow."""
    chosen = R.rank_and_select(candidates(Tables(spark, path)))
    return chosen.select("question_id", "id", "position", "n_tokens", "used_tokens")


def _pages(t: Tables):
    c = candidates(t).select("question_id", F.col("line").alias("rank"), "engine_rank", "n_tokens")
    snippet = F.when(F.col("rank") % 2 == 0, F.format_string("snippet of page %d", "rank"))
    results = c.select("question_id", "rank", snippet.alias("snippet"))
    chunked = c.where(F.col("engine_rank").isNotNull())
    chunks = chunked.select(
        "question_id", "rank", F.explode(F.sequence(F.lit(0), F.col("rank") % 3)).alias("chunk_index"), "n_tokens"
    ).select(
        "*", F.format_string("r%02dc%d", "rank", "chunk_index").alias("cite_id"),
        F.format_string("ev_%d_%d", "rank", "chunk_index").alias("drawer_id"), F.lit("chunk text").alias("text"),
    )
    return results, chunks


SQL_PAGES = """
results as (select question_id, line as rank, case when line % 2 = 0 then 'snippet of page ' || line end as snippet from candidates),
chunks as (select question_id, line as rank, k.range as chunk_index, n_tokens
  from candidates, range(3) k where engine_rank is not null and k.range <= line % 3)"""


@query(
    "baseline_evidence",
    f"""with {CANDIDATES}, {SQL_PAGES},
cand as (
  select question_id, rank, chunk_index, 'r' || lpad(rank::varchar, 2, '0') || 'c' || chunk_index as cite_id, n_tokens
  from chunks where rank <= 5
  union all
  select question_id, rank, 0, 'r' || lpad(rank::varchar, 2, '0') || 's', 4 from results r
  where rank <= 5 and snippet is not null and not exists (select 1 from chunks c where c.question_id = r.question_id and c.rank = r.rank)
), s as (select *, sum(n_tokens) over (partition by question_id order by rank, chunk_index) as used_tokens from cand)
select question_id, cite_id, n_tokens, used_tokens::bigint as used_tokens from s where used_tokens <= 3000""",
)
def baseline_evidence(spark, path):
    """Chunks of the first pages up to a budget; a snippet for a page without chunks."""
    results, chunks = _pages(Tables(spark, path))
    out = R.baseline_evidence(results, chunks, pages=5, max_tokens=3000)
    return out.select("question_id", "cite_id", "n_tokens", "used_tokens")


SQL_CANONICAL = "regexp_replace(regexp_replace(trim(url), '#.*$', ''), '/+$', '')"


@query(
    "deduplicated_results",
    f"""with r as (select 'q' || page_id // 25 as question_id, page_id // 2 as pos2, page_id as pos,
       case when page_id % 2 = 0 then url else regexp_replace(url, '/en/.*', '/en/1') end as url from pages),
k as (select *, {SQL_CANONICAL} as key from r where url <> ''),
f as (select * from (select *, row_number() over (partition by question_id, key order by pos) as rn from k) where rn = 1),
o as (select question_id, pos, url, row_number() over (partition by question_id order by pos) as rank from f)
select question_id, rank, pos, url, 'engine' || (pos % 3) as engines from o where rank <= 30""",
)
def deduplicated_results(spark, path):
    """First result per canonical URL, re-ranked."""
    pages = Tables(spark, path).pages
    question = F.concat(F.lit("q"), F.floor(F.col("page_id") / 25).cast("string"))
    url = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.regexp_replace("url", "/en/.*", "/en/1"))
    raw = pages.select(
        question.alias("question_id"), F.col("page_id").alias("pos"), url.alias("url"),
        F.array().cast("array<string>").alias("engines"), F.concat(F.lit("engine"), (F.col("page_id") % 3).cast("string")).alias("engine"),
    )
    out = R.dedup_results(raw)
    return out.select("question_id", "rank", "pos", "url", F.array_join("engines", ",").alias("engines"))


@query(
    "page_picks",
    f"""with {CANDIDATES},
sv as (select question_id, id, engine_rank from candidates where engine_rank is not null and evidence > 0.01),
p as (select *, row_number() over (partition by question_id order by engine_rank, id) as pick from sv),
pg as (select question_id, line as rank, n_tokens % 3 <> 0 as fetched, n_tokens % 4 as n_chunks from candidates)
select p.question_id, p.id, p.pick, case when coalesce(pg.fetched and pg.n_chunks > 0, false) then 'chunks' else 'snippet' end as stands_in
from p left join pg on pg.question_id = p.question_id and pg.rank = p.engine_rank where pick <= 3""",
)
def page_picks(spark, path):
    """Which surviving pages are read, and where the snippet has to stand in."""
    c = candidates(Tables(spark, path))
    survivors = c.where(F.col("engine_rank").isNotNull() & (F.col("evidence") > 0.01)).select("question_id", "id", "engine_rank")
    pages = c.select("question_id", F.col("line").alias("rank"), (F.col("n_tokens") % 3 != 0).alias("fetched"), (F.col("n_tokens") % 4).alias("n_chunks"))
    return R.pick_pages(survivors, pages, 3).select("question_id", "id", "pick", "stands_in")


@query(
    "conflict_block",
    f"""with {CANDIDATES}, o as (select question_id, id, similarity,
  row_number() over (partition by question_id order by coalesce(similarity, 0) desc, id) as position from candidates)
select question_id, id, position from o where position <= 2""",
)
def conflict_block(spark, path):
    rows = candidates(Tables(spark, path)).withColumn("contradicts", F.col("similarity"))
    return R.conflict_block(rows, 2).select("question_id", "id", "position")


@query(
    "top_evidence",
    f"""with {CANDIDATES}, o as (select *, row_number() over (partition by line order by evidence desc, question_id) as position from candidates)
select line, question_id, evidence, position from o where position <= 20""",
)
def top_evidence(spark, path):
    """Best 20 of groups that hold a seventh of the rows each."""
    rows = candidates(Tables(spark, path))
    return top_rows(rows, ["line"], [F.desc("evidence"), F.asc("question_id")], 20).select("line", "question_id", "evidence", "position")
