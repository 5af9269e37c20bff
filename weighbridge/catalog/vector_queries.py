"""Exact cosine search: wings by label, every vector also a query."""

from __future__ import annotations

from pyspark.sql import functions as F

from weighbridge.catalog.base import Tables, query
from weighbridge.operators import vector as V
from weighbridge.operators.grouped import first_rows

SQL_VECTORS = """
v as (select vec_id, label, case when label < 5 then 'verified' else 'evidence' end as wing, list_transform(embedding, lambda x: x::double) as e,
  '2026-01-' || lpad((vec_id % 28 + 1)::varchar, 2, '0') as day from embeddings)"""


def _vectors(t: Tables):
    return t.embeddings.select(
        F.col("vec_id").cast("string").alias("drawer_id"), F.col("label").alias("question_id"),
        F.when(F.col("label") < 5, "verified").otherwise("evidence").alias("wing"), "embedding",
        F.format_string("2026-01-%02d", F.col("vec_id") % 28 + 1).alias("authored_at"),
    )


def _queries(t: Tables):
    return t.embeddings.select(F.col("vec_id").cast("string").alias("question_id"), "embedding")


def _search_sql(wing: str, n: int, extra: str = "") -> str:
    return f"""select q.vec_id::varchar as question_id, d.vec_id::varchar as drawer_id, list_cosine_similarity(q.e, d.e) as sim,
  row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.e, d.e), 12) desc, d.vec_id::varchar) as position
  from v q cross join v d where d.wing = '{wing}' {extra} qualify position <= {n}"""


@query(
    "wing_search",
    f"with {SQL_VECTORS}, s as ({_search_sql('evidence', 10)}) select question_id, drawer_id, position, round(sim, 5) as similarity from s where 1 - sim <= 0.6",
)
def wing_search(spark, path):
    """Ten nearest drawers of one wing within the distance cap, for every query."""
    t = Tables(spark, path)
    found = V.search(_queries(t), _vectors(t).where(F.col("wing") == "evidence"), 10, 0.6)
    return found.select("question_id", "drawer_id", "position", F.round("similarity", 5).alias("similarity"))


@query(
    "wing_search_since",
    f"""with {SQL_VECTORS}, s as ({_search_sql('verified', 5, "and d.day >= '2026-01-' || lpad((q.vec_id % 3 * 9 + 1)::varchar, 2, '0')")})
select question_id, drawer_id, position, round(sim, 5) as similarity from s""",
)
def wing_search_since(spark, path):
    """The same with a date floor per query."""
    t = Tables(spark, path)
    asked = _queries(t).withColumn("since", F.format_string("2026-01-%02d", F.col("question_id").cast("bigint") % 3 * 9 + 1))
    found = V.search(asked, _vectors(t).where(F.col("wing") == "verified"), 5, None, since=True)
    return found.select("question_id", "drawer_id", "position", F.round("similarity", 5).alias("similarity"))


@query(
    "question_search",
    f"""with {SQL_VECTORS}, q as (select label, arg_min(e, vec_id) as e from v group by label),
s as (select v.label as question_id, vec_id::varchar as drawer_id, list_cosine_similarity(q.e, v.e) as sim,
  row_number() over (partition by v.label order by round(list_cosine_similarity(q.e, v.e), 12) desc, vec_id::varchar) as position from v join q using (label))
select question_id, drawer_id, position, round(sim, 5) as similarity from s where position <= 10 and 1 - sim <= 0.9""",
)
def question_search(spark, path):
    """Each question's one query against its own drawers; a tenth of the rows each."""
    vectors = _vectors(Tables(spark, path))
    asked = first_rows(vectors, ["question_id"], [F.asc(F.col("drawer_id").cast("bigint"))]).select("question_id", "embedding")
    found = V.search_within(asked, vectors, 10, 0.9)
    return found.select("question_id", "drawer_id", "position", F.round("similarity", 5).alias("similarity"))


@query(
    "memory_lane",
    f"""with {SQL_VECTORS}, a as ({_search_sql('verified', 3)}), b as ({_search_sql('evidence', 3)}),
u as (select *, 0 as lane, 'verified' as wing from a union all select *, 1, 'evidence' from b),
k as (select *, row_number() over (partition by question_id order by lane, round(sim, 12) desc, drawer_id) as place from u where 1 - sim <= 0.7)
select question_id, drawer_id, wing, 'm' || lpad(place::varchar, 2, '0') as cite_id from k""",
)
def memory_lane(spark, path):
    """Verified hits before evidence hits, numbered per question."""
    t = Tables(spark, path)
    return V.memory_lane(_queries(t), _vectors(t), 3, 0.7).select("question_id", "drawer_id", "wing", "cite_id")


@query(
    "verified_precheck",
    f"with {SQL_VECTORS}, s as ({_search_sql('verified', 3)}) select vec_id::varchar as question_id, (vec_id::varchar in (select question_id from s where 1 - sim <= 0.6))::int as has_verified_hits from v",
)
def verified_precheck(spark, path):
    t = Tables(spark, path)
    return V.precheck(_queries(t), _vectors(t)).select("question_id", F.col("has_verified_hits").cast("int").alias("has_verified_hits"))


@query(
    "recalled_passages",
    f"""with {SQL_VECTORS}, s as ({_search_sql('evidence', 5)}),
k as (select s.*, case when drawer_id::bigint % 3 <> 2 then 'r' || lpad((drawer_id::bigint % 30)::varchar, 2, '0') || 'c' || drawer_id end as cite from s)
select question_id, drawer_id, coalesce(cite, 'p' || lpad(position::varchar, 2, '0')) as id, case when cite is not null then (drawer_id::bigint % 30)::int end as engine_rank,
  case when drawer_id::bigint % 3 = 0 then 'both' else 'palace' end as lane,
  case drawer_id::bigint % 3 when 0 then 'keep_verdict' when 1 then 'judge_chunk' else 'judge_drawer' end as action from k""",
)
def recalled_passages(spark, path):
    """Refinement hits folded into the passages a question already has."""
    t = Tables(spark, path)
    hits = V.search(_queries(t), _vectors(t).where(F.col("wing") == "evidence"), 5, None)
    vec = F.col("drawer_id").cast("bigint")
    known = hits.where(vec % 3 != 2).select(
        "question_id", F.format_string("r%02dc%s", vec % 30, "drawer_id").alias("cite_id"), "drawer_id", (vec % 30).cast("int").alias("rank")
    )
    judged = known.where(vec % 3 == 0).select("question_id", F.col("cite_id").alias("id"))
    out = V.merge_recalled(judged, hits, known)
    return out.select("question_id", "drawer_id", "id", "engine_rank", "lane", "action")
