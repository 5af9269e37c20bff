"""Registry and shared input derivations.

The benchmark tables hold no judge scores, so the queries derive them with
arithmetic both engines evaluate alike. Each derivation comes as a Spark frame
and as a SQL fragment of the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RESAMPLES = 1000  # replicates of the registered bootstrap queries, as in the operators


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its SQL counterpart."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


class Tables:
    """The benchmark tables of one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


# --- judged documents: two judges over labelled documents ------------------

JUDGED_DOCS = """
judged_docs as (
  select d.doc_id, d.source as cluster, l.quality = 1 as label,
         least(100, d.n_chars // 20) as fine,
         case when d.n_chars < 600 then 0 when d.n_chars < 2000 then 50 else 100 end as coarse
  from documents d join labels l using (doc_id)
),
judged_long as (
  select 'fine' as judge, doc_id, cluster, label, fine / 100 as score, fine as bin from judged_docs
  union all
  select 'coarse', doc_id, cluster, label, coarse / 100, coarse from judged_docs
)"""


def judged_docs(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    docs = t.documents.select("doc_id", "source", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id")
    return docs.select(
        "doc_id",
        F.col("source").alias("cluster"),
        (F.col("quality") == 1).alias("label"),
        F.least(F.lit(100), F.floor(n / 20)).cast("int").alias("fine"),
        F.when(n < 600, 0).when(n < 2000, 50).otherwise(100).alias("coarse"),
    )


def judged_long(t: Tables) -> DataFrame:
    judges = F.array(
        F.struct(F.lit("fine").alias("judge"), (F.col("fine") / 100).alias("score")),
        F.struct(F.lit("coarse").alias("judge"), (F.col("coarse") / 100).alias("score")),
    )
    rows = judged_docs(t).select("doc_id", "cluster", "label", F.explode(judges).alias("j"))
    return rows.select("j.judge", "doc_id", "cluster", "label", "j.score")


# --- weights of clusters in SQL ---------------------------------------------


def sql_weights(source: str, by: str = "") -> str:
    """Poisson weights of each cluster in every replicate, as ``poisson_weights`` has them."""
    cols = f"{by}, " if by else ""
    steps = (24109, 48218, 60273, 64291, 65296, 65497, 65530, 65535)
    return f"""
weights as (
  select {cols}cluster, replicate, {" + ".join(f"(u >= {t})::int" for t in steps)} as w
  from (select {cols}cluster, 8 * b + s as replicate, ('0x' || substr(digest, (1 + 4 * s)::int, 4))::int as u
        from (select {cols}cluster, b.range as b, md5(b.range || '|' || coalesce(cluster::varchar, '')) as digest
              from (select distinct {cols}cluster from {source}) cross join range({-(-RESAMPLES // 8)}) b)
        cross join (select range as s from range(8)))
  where replicate < {RESAMPLES}
)"""


# --- result records: arms and graded questions -----------------------------

RECORDS = """
records as (
  select o_orderpriority as arm, o_custkey as question_id, o_orderkey,
         case o_orderstatus when 'F' then 'correct' when 'O' then 'incorrect' else 'not_attempted' end as label,
         case when o_orderstatus = 'P' then case when o_orderkey % 3 = 0 then 'insufficient_evidence'
              when o_orderkey % 3 = 1 then 'no_claims_kept' else 'answer_off_target' end end as abstain_reason,
         o_orderkey % 4 as fabricated_citations,
         (o_orderkey * 37) % 5000 as latency_ms
  from (select *, row_number() over (partition by o_orderpriority, o_custkey order by o_orderkey desc) as rn from orders)
  where rn = 1
)"""


def records(t: Tables) -> DataFrame:
    """Latest order per priority (arm) and customer (question)."""
    from weighbridge.operators.grouped import first_rows

    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    last = first_rows(orders, ["o_orderpriority", "o_custkey"], [F.desc("o_orderkey")])
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    reason = (
        F.when(key % 3 == 0, "insufficient_evidence").when(key % 3 == 1, "no_claims_kept").otherwise("answer_off_target")
    )
    return last.select(
        F.col("o_orderpriority").alias("arm"),
        F.col("o_custkey").alias("question_id"),
        "o_orderkey",
        F.when(status == "F", "correct").when(status == "O", "incorrect").otherwise("not_attempted").alias("label"),
        F.when(status == "P", reason).alias("abstain_reason"),
        (key % 4).alias("fabricated_citations"),
        ((key * 37) % 5000).alias("latency_ms"),
    )


# --- ranking candidates: order lines as passages of a question -------------

CANDIDATES = """
candidates as (
  select l_orderkey as question_id, 'r' || lpad(l_linenumber::varchar, 2, '0') || 'c0' as id, l_linenumber as line,
         case when min(l_partkey) % 5 <> 0 then l_linenumber end as engine_rank,
         (min(l_quantity)::bigint % 4)::int as n_engines,
         case when min(l_partkey) % 3 = 0 then max(l_discount) end as similarity,
         max(l_tax) as evidence,
         (min(l_quantity)::int) * 20 as n_tokens
  from lineitem group by l_orderkey, l_linenumber
)"""


def candidates(t: Tables) -> DataFrame:
    grouped = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("part"), F.min("l_quantity").alias("qty"),
        F.max("l_discount").alias("discount"), F.max("l_tax").alias("tax"),
    )
    return grouped.select(
        F.col("l_orderkey").alias("question_id"),
        F.format_string("r%02dc0", "l_linenumber").alias("id"),
        F.col("l_linenumber").alias("line"),
        F.when(F.col("part") % 5 != 0, F.col("l_linenumber")).alias("engine_rank"),
        (F.col("qty").cast("bigint") % 4).cast("int").alias("n_engines"),
        F.when(F.col("part") % 3 == 0, F.col("discount")).alias("similarity"),
        F.col("tax").alias("evidence"),
        (F.col("qty").cast("int") * 20).alias("n_tokens"),
    )


# --- event probabilities ----------------------------------------------------


def prob(k: int):
    """Pseudo probability on the 0.01 grid."""
    return ((F.col("event_id") * k) % 101) / 100


def sql_prob(k: int) -> str:
    return f"((event_id * {k}) % 101) / 100"


PRIMES = (17, 29, 43, 61, 83)
