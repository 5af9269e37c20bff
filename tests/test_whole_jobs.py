"""Queries on inputs laid out, or repeated, in ways the sample tables are not."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from weighbridge.catalog import judged_queries as J
from weighbridge.catalog import snapshot_queries as Q
from weighbridge.catalog import source_queries as C
from weighbridge.operators import vector as X
from weighbridge.plans import arms as R
from weighbridge.settings import GATE_QUESTIONS, LIMITS

DATA = "/root/testdata/sf0.001"


def test_a_stream_reads_a_table_of_part_files(spark, tmp_path):
    spark.read.parquet(f"{DATA}/pages.parquet").limit(30).repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    n = spark.read.parquet(str(tmp_path / "pages.parquet")).selectExpr("count(distinct page_id div 2)").first()[0]
    assert n > 0 and Q.streamed_drawers(spark, str(tmp_path)).count() == n


def test_every_gold_meets_all_documents_of_its_source(spark, tmp_path):
    items = [(i, f"golden phrase number {i}") for i in range(60)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = [(d, f"told: {items[25][1]} here" if d == 3 else f"nothing {d}", "en", "src5") for d in range(6)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.question_id: r for r in Q.gold_recall(spark, str(tmp_path)).collect()}
    assert len(rows) == 20 and (rows["src5"].n_chunks, rows["src5"].in_chunks) == (6, 1)


def test_questions_beyond_four_digits_are_shown_like_the_sql(spark, tmp_path):
    rows = spark.range(10_050).select(F.col("id").alias("conv_id"), (F.col("id") % 6).alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("Q"), "id").alias("text"))
    rows.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = C.questions_from_csv(spark, str(tmp_path)).first()
    assert (got.n, got.n_queries, got.first_id, got.last_id) == (10_050, 10_050, "simpleqa-0000", "simpleqa-9999")


def test_copies_of_a_passage_are_judged_one_by_one(spark):
    columns = "question_id string, id string, title string, domain string, source_type string, text string"
    passages = spark.createDataFrame([("q", "r01c0", "", "d", "web", x) for x in ("short", "a longer text")], columns)
    asked = []

    def judge(requests, stage):
        asked.append(requests.count())
        value = F.when(F.length(F.col("state")["passage"]["text"]) > 8, 0.9).otherwise(0.1)
        return requests.select("question_id", "id", F.explode(F.array(*[F.lit(q) for q in GATE_QUESTIONS])).alias("qid"), value.alias("value"))

    out = R._judged(passages, spark.createDataFrame([("q", "what")], "question_id string, query string"), judge, LIMITS).collect()
    assert asked == [2] and {(r.id, r.text, r.is_relevant) for r in out} == {("r01c0", "short", 0.1), ("r01c0", "a longer text", 0.9)}


def test_texts_of_one_id_stand_under_it(spark):
    items = F.expr("array(named_struct('id', 'a', 'text', 'x'), named_struct('id', 'b', 'text', 'y'), named_struct('id', 'a', 'text', 'z'))")
    assert spark.range(1).select(R._texts_by_id(items).alias("m")).first().m == {"a": "x\nz", "b": "y"}


def test_of_a_url_crawled_twice_the_store_files_one_text_in_every_run(spark, monkeypatch):
    """However the copies of a chunk lie, the text that sorts first is the drawer's."""
    columns = "question_id string, rank int, url string, chunk_index int, drawer_id string, text string"
    rows = [("q", 1, "http://a.org/x", 0, "d", t) for t in ("words of b", "words of a", "words of c")]
    filed = []

    class Filed(Exception):
        pass

    def commit(store, arrivals, *rest, **named):
        filed.append([r.text for r in arrivals.collect()])
        raise Filed

    monkeypatch.setattr(J.VersionedStore, "commit", commit)
    for shift in range(3):
        chunks = spark.createDataFrame(rows[shift:] + rows[:shift], columns).coalesce(1)
        monkeypatch.setattr(J, "_run_inputs", lambda *given: {"chunks": chunks, "questions": chunks})
        with pytest.raises(Filed):
            J._two_passes(spark, DATA)
    assert filed == [["words of a"]] * 3


def test_of_a_url_crawled_twice_one_text_is_filed_however_the_pages_lie(spark, tmp_path):
    pages = [(i, "http://a.org/x", f"<p>words of {w}</p>") for i, w in ((1, "b"), (2, "a"), (5, "c"))]
    filed = []
    for shift in range(3):
        table = spark.createDataFrame(pages[shift:] + pages[:shift], "page_id bigint, url string, html string")
        table.coalesce(1).write.parquet(str(tmp_path / f"{shift}" / "pages.parquet"))
        filed.append([(r.question_id, r.digest) for r in Q.filed_drawers(spark, str(tmp_path / f"{shift}")).collect()])
    assert filed == [[("q0", hashlib.md5(b"words of a").hexdigest())]] * 3


def test_the_versions_of_a_store_need_one_pass(spark, monkeypatch):
    passes = []
    chunks = spark.createDataFrame([("q", 1, "http://a.org/x", 0, "d", "words")], "question_id string, rank int, url string, chunk_index int, drawer_id string, text string")
    monkeypatch.setattr(J, "_run_inputs", lambda *given: {"chunks": chunks, "questions": chunks})
    monkeypatch.setattr(J.M, "memory_pass", lambda *given, at, **named: passes.append(at))
    monkeypatch.setattr(J.M, "file_run", lambda *given, **named: 2)
    out = J.store_versions(spark, DATA).collect()
    assert passes == [1] and [(r.wing, r.snapshot) for r in out] == [("evidence", 1)]


def test_a_query_is_copied_once_a_unit_of_cells(spark, monkeypatch):
    import numpy as np

    points = np.random.default_rng(1).normal(size=(300, 8))
    drawers = spark.createDataFrame([(f"d{i:03d}", [float(x) for x in p]) for i, p in enumerate(points)], "drawer_id string, embedding array<double>")
    met = []
    real = X._met_elsewhere
    monkeypatch.setattr(X, "_met_elsewhere", lambda asked, *rest: met.append(asked.groupBy("question_id").count().agg(F.max("count")).first()[0]) or real(asked, *rest))
    out = X.search(drawers.withColumnRenamed("drawer_id", "question_id"), drawers, 5, None, cells=20).collect()
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 12)
    want = {(f"d{q:03d}", k + 1, f"d{v:03d}") for q in range(300) for k, v in enumerate(np.lexsort((np.arange(300), -scores[q]))[:5])}
    assert met == [1] and {(r.question_id, r.position, r.drawer_id) for r in out} == want


def test_gold_search_holds_few_texts_at_once(spark):
    """A worker turns a slice of a batch into Python strings, not the whole batch."""
    import pyarrow as pa

    from weighbridge.operators import snapshot as S

    def sizes(found, batch):
        return pa.RecordBatch.from_arrays([pa.array([batch.num_rows] * batch.num_rows, pa.int64())], names=["n"])

    rows = spark.range(1000).coalesce(1).select(F.lit("q").alias("question_id"), "id")
    golds = spark.createDataFrame([("q", "gold")], "question_id string, gold string")
    seen = [r.n for r in S._matched(rows, golds, sizes, "n bigint").collect()]
    assert len(seen) == 1000 and max(seen) <= S.TEXTS_AT_ONCE
