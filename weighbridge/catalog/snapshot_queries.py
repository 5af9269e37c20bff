"""Frozen evidence: freeze, replay, recall, reports and incremental filing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weighbridge.catalog.base import Tables, query
from weighbridge.catalog.text_queries import cap, clean, normal
from weighbridge.functions.ids import evidence_drawer_id, sha256_text
from weighbridge.functions.text import chunk_text, normalize_answer, word_tokens
from weighbridge.functions.urls import domain_of
from weighbridge.operators import snapshot as S
from weighbridge.operators import store as D
from weighbridge.operators.versions import EntryTable
from weighbridge.plans import freeze as Z
from weighbridge.stages import stage_dir
from weighbridge.streaming.ingest import ingest_stream, stored_drawers

# Pages as crawled search results, 25 to a question; every sixth page also belongs to
# the next question, so that chunks are filed twice.
SQL_LINKS = """
links as (select 'q' || page_id // 25 as question_id, page_id as pos, url from pages
  union all select 'q' || (page_id // 25 + 1), page_id, url from pages where page_id % 6 = 0)"""
SQL_CRAWL = f"""{SQL_LINKS},
keyed as (select *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '/+$', '') as key from links),
firsts as (select * from (select *, row_number() over (partition by question_id, key order by pos) as rn from keyed) where rn = 1),
results as (select * from (select question_id, pos, url, row_number() over (partition by question_id order by pos) as rank from firsts) where rank <= 30),
crawl as (select url, case when page_id % 10 = 3 then 404 else 200 end as status, {clean("html")} as text, page_id from pages),
pgs as (select r.*, c.text, c.status < 400 and c.text <> '' as ok from results r join crawl c using (url)),
tok as (select question_id, rank, url, regexp_extract_all(text, '\\S+') as tok from pgs where ok),
st as (select *, len(tok) as n, unnest(range(0, len(tok), 255)) as s from tok),
win as (select question_id, rank, url, s // 255 as chunk_index, least(300, n - s) as n_tokens, array_to_string(tok[s + 1:s + 300], ' ') as t
  from st where (s = 0 or s - 255 + 300 < n) and (s = 0 or n - s >= 20) and s // 255 < 8),
chunks as (select question_id, rank, url, chunk_index, n_tokens, {cap("t", 1800)} as text,
  'r' || lpad(rank::varchar, 2, '0') || 'c' || chunk_index as cite_id,
  'ev_' || substr(sha1(url || chr(10) || chunk_index), 1, 16) || '_c' || chunk_index as drawer_id from win),
store as (select distinct 'ev_' || substr(sha1(url || chr(10) || 0), 1, 16) || '_c0' as drawer_id, page_id from crawl where page_id % 4 = 0)"""


def _frozen(t: Tables):
    pages, page = t.pages, F.col("page_id")
    number = F.floor(page / 25)
    link = pages.select(F.concat(F.lit("q"), number.cast("string")).alias("question_id"), page.alias("pos"), "url")
    extra = pages.where(page % 6 == 0).select(F.concat(F.lit("q"), (number + 1).cast("string")).alias("question_id"), page.alias("pos"), "url")
    raw = link.unionByName(extra).withColumn("title", F.format_string("Page %d", "pos"))
    crawl = pages.select(
        "url", F.when(page % 10 == 3, 404).otherwise(200).alias("status"), F.lit("text/html").alias("content_type"),
        F.col("html").alias("body"), F.lit("2026-09-19T18:00:00Z").alias("fetched_at"),
    )
    store = pages.where(page % 4 == 0).select(evidence_drawer_id(F.col("url"), F.lit(0)).alias("drawer_id")).distinct()
    return raw, crawl, store


@query(
    "frozen_chunks",
    f"with {SQL_CRAWL} select question_id, rank, chunk_index, cite_id, drawer_id, n_tokens, length(text) as n_chars, sha256(text) as sha256 from chunks",
)
def frozen_chunks(spark, path):
    """Results to pages to chunks, with citation ids, drawer ids and hashes."""
    chunks = Z.freeze(*_frozen(Tables(spark, path)))["chunks"]
    return chunks.select("question_id", "rank", "chunk_index", "cite_id", "drawer_id", "n_tokens", "n_chars", "sha256")


SQL_MANIFEST = """
win2 as (select * from (select question_id, drawer_id, row_number() over (partition by drawer_id order by question_id, rank) as rn from chunks) where rn = 1),
new as (select question_id, count(*) as n_new from win2 where drawer_id not in (select drawer_id from store) group by question_id),
man as (select r.question_id, r.n as n_results, coalesce(p.n, 0) as n_pages, coalesce(c.n, 0) as n_chunks, coalesce(n_new, 0) as n_new
  from (select question_id, count(*) as n from results group by 1) r left join (select question_id, count(*) as n from pgs where ok group by 1) p using (question_id)
  left join (select question_id, count(*) as n from chunks group by 1) c using (question_id) left join new using (question_id))"""


@query("frozen_manifest", f"with {SQL_CRAWL}, {SQL_MANIFEST} select *, n_chunks - n_new as n_dedup from man")
def frozen_manifest(spark, path):
    return Z.freeze(*_frozen(Tables(spark, path)))["manifest"]


@query(
    "filed_drawers",
    f"""with {SQL_CRAWL}, f as (select * from (select *, row_number() over (partition by drawer_id order by question_id, rank) as rn from chunks) where rn = 1)
select drawer_id, question_id, url as source_file, md5(text) as digest from f where drawer_id not in (select drawer_id from store)""",
)
def filed_drawers(spark, path):
    """Drawers to append: absent from the store, first question wins."""
    new = Z.freeze(*_frozen(Tables(spark, path)))["drawers"]
    return new.select("drawer_id", F.col("meta")["query_id"].alias("question_id"), "source_file", F.md5("text").alias("digest"))


@query(
    "freeze_summary",
    f"""with {SQL_CRAWL}, {SQL_MANIFEST}
select case when grouping(question_id) = 1 then 'total' else question_id end as question_id, sum(n_results)::bigint as n_results, sum(n_pages)::bigint as n_pages,
  sum(n_chunks)::bigint as n_chunks, sum(n_new)::bigint as n_new, grouping(question_id)::int as is_total from man group by rollup (question_id)""",
)
def freeze_summary(spark, path):
    """Counts per question and one total row."""
    return S.freeze_summary(frozen_manifest(spark, path)).withColumn("is_total", F.col("is_total").cast("int"))


# Documents as stored chunks: one question per source; some copies are stale or missing.
SQL_STORED = """
ch as (select source as question_id, (doc_id % 30)::int + 1 as rank, doc_id as chunk_index, 'd' || doc_id as drawer_id, sha256(text) as sha256 from documents),
dr as (select 'd' || doc_id as drawer_id, case when doc_id % 17 = 0 then text || ' edited' else text end as text from documents where doc_id % 23 <> 0),
rep as (select ch.*, case when dr.drawer_id is null then 'missing' when sha256(dr.text) <> ch.sha256 then 'stale' else 'ok' end as outcome
  from ch left join dr using (drawer_id))"""


def _stored(t: Tables):
    doc = F.col("doc_id")
    chunks = t.documents.select(
        F.col("source").alias("question_id"), ((doc % 30) + 1).cast("int").alias("rank"), doc.alias("chunk_index"),
        F.format_string("d%d", doc).alias("drawer_id"), sha256_text(F.col("text")).alias("sha256"),
    )
    edited = F.when(doc % 17 == 0, F.concat(F.col("text"), F.lit(" edited"))).otherwise(F.col("text"))
    drawers = t.documents.where(doc % 23 != 0).select(F.format_string("d%d", doc).alias("drawer_id"), edited.alias("text"))
    return chunks, drawers


@query("replay_outcomes", f"with {SQL_STORED} select question_id, drawer_id, outcome from rep")
def replay_outcomes(spark, path):
    """Every frozen chunk against the store: ok, stale or missing."""
    return S.replay(*_stored(Tables(spark, path)), strict=False).select("question_id", "drawer_id", "outcome")


@query(
    "replay_check",
    f"""with {SQL_STORED} select question_id, count(distinct rank) as n_results, count(*) filter (outcome = 'ok') as n_ok,
  count(*) filter (outcome = 'stale') as n_stale, count(*) filter (outcome = 'missing') as n_missing, (count(*) filter (outcome = 'missing') = 0)::int as replays
from rep group by question_id""",
)
def replay_check(spark, path):
    chunks, drawers = _stored(Tables(spark, path))
    results = chunks.select("question_id", "rank").distinct()
    out = S.replay_check(chunks.select("question_id").distinct(), results, chunks, drawers)
    return out.withColumn("replays", F.col("replays").cast("int"))


# Gold recall: one question per source, with all its documents as evidence; the
# benchmark items dealt to it are its golds.
SQL_RECALL = f"""
gi as (select 'src' || item_id % 20 as source, {normal("text")} as gold, item_id from benchmark),
qs as (select source, gold, item_id from gi union all select source, split_part(gold, ' ', 1) || ' ' || split_part(gold, ' ', 2), item_id from gi where item_id % 3 = 0),
ev as (select source, doc_id, doc_id % 12 as rank, {normal("text")} as t, {normal("lang || ' ' || case when doc_id % 12 > 8 then text else '' end")} as snip from documents),
al as (select source, string_agg(t, ' ' order by rank, doc_id) filter (t <> '') as chunks,
    string_agg(t, ' ' order by rank, doc_id) filter (rank <= 8 and t <> '') as top, string_agg(snip, ' ' order by rank, doc_id) filter (snip <> '') as snips, count(*) as n
  from ev where source in (select source from qs) group by source),
rec as (select q.source, coalesce(any_value(a.n), 0) as n, (select length(gold) <= 4 from gi where gi.source = q.source order by item_id limit 1) as short,
   coalesce(bool_or(contains(chunks, gold) and gold <> ''), false) as in_chunks, coalesce(bool_or(contains(top, gold) and gold <> ''), false) as in_top,
   coalesce(bool_or(contains(snips, gold) and gold <> ''), false) as in_snips from qs q left join al a on a.source = q.source group by q.source)"""


def _recall(t: Tables):
    item = F.col("item_id")
    gold = normalize_answer(F.col("text"))
    pair = F.concat_ws(" ", F.split_part(gold, F.lit(" "), F.lit(1)), F.split_part(gold, F.lit(" "), F.lit(2)))
    own = F.when(item % 3 == 0, F.array("text", pair)).otherwise(F.array("text"))
    dealt = t.benchmark.select(F.concat(F.lit("src"), (item % 20).cast("string")).alias("question_id"), item, "text", own.alias("own"))
    questions = dealt.groupBy("question_id").agg(F.min_by("text", "item_id").alias("gold"), F.flatten(F.collect_list("own")).alias("golds"))
    doc = F.col("doc_id")
    docs = t.documents.withColumnRenamed("source", "question_id").join(questions.select("question_id"), "question_id", "left_semi")
    chunks = docs.select("question_id", (doc % 12).alias("rank"), doc.alias("chunk_index"), "text")
    results = docs.select("question_id", (doc % 12 * 1000000 + doc).alias("rank"), F.col("lang").alias("title"), F.when(doc % 12 > 8, F.col("text")).otherwise("").alias("snippet"))
    return questions, results, chunks


@query(
    "gold_recall",
    f"""with {SQL_RECALL} select source as question_id, n as n_results, n as n_chunks, (in_chunks or in_snips)::int as in_any_evidence, in_chunks::int as in_chunks,
  (in_snips and not in_chunks)::int as in_snippets_only, in_top::int as in_top_pages, short::int as short_answer from rec""",
)
def gold_recall(spark, path):
    """Where the gold answer occurs, without joining whole evidence texts."""
    out = S.recall(*_recall(Tables(spark, path)))
    flags = ("in_any_evidence", "in_chunks", "in_snippets_only", "in_top_pages", "short_answer")
    return out.select("question_id", "n_results", "n_chunks", *[F.col(c).cast("int").alias(c) for c in flags])


@query(
    "recall_report",
    f"""with {SQL_RECALL} select count(*) as n, round(avg((in_chunks or in_snips)::int), 6) as recall, round(avg(in_chunks::int), 6) as recall_in_chunks,
 round(avg(in_top::int), 6) as recall_top_pages, round(avg((in_chunks or in_snips)::int) filter (not short), 6) as recall_long_answers_only,
 count(*) filter (short) as n_short_answers, count(*) filter (n = 0) as n_zero_chunk_questions, round(avg(n), 6) as mean_results from rec""",
)
def recall_report(spark, path):
    rows = S.recall(*_recall(Tables(spark, path))).withColumn("snapshot", F.lit("s"))
    out = S.recall_report(rows, ["snapshot"])
    shares = ("recall", "recall_in_chunks", "recall_top_pages", "recall_long_answers_only", "mean_results")
    return out.select("n", "n_short_answers", "n_zero_chunk_questions", *[F.round(c, 6).alias(c) for c in shares])


@query(
    "result_buckets",
    """with q as (select o_orderkey, count(l_orderkey) * 5 as n from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey)
select case when n = 0 then '0' when n < 10 then '1-9' when n < 30 then '10-29' else '30' end as bucket, count(*) as questions from q group by 1""",
)
def result_buckets(spark, path):
    t = Tables(spark, path)
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.count(F.lit(1)) * 5).alias("n"))
    per = t.orders.select("o_orderkey").join(lines, "o_orderkey", "left").select(F.coalesce("n", F.lit(0)).alias("n_results"))
    return S.result_buckets(per)


@query(
    "engine_counts",
    """select engine, count(*) as n from (select unnest(case when l_linenumber % 2 = 0 then [l_shipmode, 'shared'] else [l_shipmode] end) as engine
from (select l_linenumber, l_returnflag as l_shipmode from lineitem)) group by engine""",
)
def engine_counts(spark, path):
    flag = F.col("l_returnflag")
    engines = F.when(F.col("l_linenumber") % 2 == 0, F.array(flag, F.lit("shared"))).otherwise(F.array(flag))
    return S.engine_counts(Tables(spark, path).lineitem.select(engines.alias("engines")))


@query(
    "suspended_engines",
    """select event_type as engine, count(*) as questions from events where value > 400 group by event_type""",
)
def suspended_engines(spark, path):
    down = F.when(F.col("value") > 400, F.array("event_type"))
    return S.suspended_engines(Tables(spark, path).events.select(down.alias("unresponsive")))


@query(
    "filing_counts",
    """with a as (select page_id % 2 as batch, page_id % 3 as store_part, 'd' || (page_id // 2) as drawer_id, page_id from pages),
w as (select * from (select *, row_number() over (partition by drawer_id order by page_id) as rn from a) where rn = 1),
s as (select distinct 'd' || (page_id // 2) as drawer_id from pages where page_id % 5 = 0)
select a.batch, count(*) as n_arrived, coalesce(any_value(n.n), 0) as n_new, count(*) - coalesce(any_value(n.n), 0) as n_dedup
from a left join (select batch, count(*) as n from w where drawer_id not in (select drawer_id from s) group by batch) n using (batch) group by a.batch""",
)
def filing_counts(spark, path):
    """Arrivals against new rows when ids repeat within and across batches."""
    page = F.col("page_id")
    rows = Tables(spark, path).pages.select(
        (page % 2).alias("batch"), F.format_string("d%d", F.floor(page / 2)).alias("drawer_id"), page, F.col("html").alias("text")
    )
    store = rows.where(page % 5 == 0).select("drawer_id")
    return D.filing_counts(rows, store, ["batch"], [F.asc("page_id")])


@query(
    "redone_entries",
    """select o_orderkey as question_id, case when n < 3 and o_orderkey % 2 = 0 then 30 else n end as n_results from (
  select o_orderkey, count(l_orderkey) as n from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey)""",
)
def redone_entries(spark, path):
    """Questions with few results replaced in the written table by their redone version, where there is one."""
    t = Tables(spark, path)
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("question_id")).agg(F.count(F.lit(1)).alias("n"))
    entries = t.orders.select(F.col("o_orderkey").alias("question_id")).join(lines, "question_id", "left").select(
        "question_id", F.coalesce("n", F.lit(0)).alias("n_results")
    )
    redone = entries.where(F.col("question_id") % 2 == 0).withColumn("n_results", F.lit(30).cast("bigint"))
    written = EntryTable(f"{stage_dir(spark)}/entries-{uuid.uuid4().hex}", buckets=8)
    written.write(entries)
    written.redo_below(redone, 3)
    return written.read(spark)


@query(
    "pending_questions",
    """select c_custkey as question_id from customer where c_custkey not in (select o_custkey from orders where o_orderstatus is null or o_orderstatus = 'F' or o_orderkey % 9 = 0)""",
)
def pending_questions(spark, path):
    """Questions left to answer; prior rows of another evidence stamp do not count."""
    t = Tables(spark, path)
    stamp = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderstatus"))
    done = t.orders.select(F.col("o_custkey").alias("question_id"), stamp.alias("manifest_stamp"))
    return D.pending(t.customer.select(F.col("c_custkey").alias("question_id")), done, F.lit("F"))


@query(
    "streamed_drawers",
    """select drawer_id, min_by(md5(html), [page_id]) as digest, 'evidence' as wing from (
  select page_id, html, 'd' || (page_id // 2) as drawer_id from pages) group by drawer_id""",
)
def streamed_drawers(spark, path):
    """Pages arriving as a stream, filed once per id."""
    base = f"{stage_dir(spark)}/ingest-{uuid.uuid4().hex}"
    schema = Tables(spark, path).pages.schema
    # as a pattern the path may name one file or a folder of part files
    arriving = spark.readStream.schema(schema).parquet(f"{path}/pages.parque[t]")
    drawers = arriving.select(
        F.format_string("d%d", F.floor(F.col("page_id") / 2)).alias("drawer_id"), F.lit("evidence").alias("wing"), domain_of(F.col("url")).alias("room"),
        F.col("html").alias("text"), F.col("url").alias("source_file"), F.lit(0).alias("chunk_index"),
        F.format_string("%012d", "page_id").alias("authored_at"), F.lit("2026-09-19").alias("filed_at"),
    )
    ingest_stream(drawers, f"{base}/store", f"{base}/checkpoint").awaitTermination()
    return stored_drawers(spark, f"{base}/store").select("drawer_id", F.md5("text").alias("digest"), "wing")


@query(
    "windows_per_source",
    """select source, count(*) as n_docs, sum(n)::bigint as n_windows from (
  select source, doc_id, len(list_filter(range(0, n, 255), lambda s: (s = 0 or s - 255 + 300 < n) and (s = 0 or n - s >= 20))) as n
  from (select source, doc_id, len(regexp_extract_all(text, '\\S+')) as n from documents)) group by source""",
)
def windows_per_source(spark, path):
    """Chunk windows per source."""
    windows = Tables(spark, path).documents.select("source", F.size(chunk_text(word_tokens(F.col("text")))).alias("n"))
    return windows.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_windows"))
