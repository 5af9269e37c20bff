"""Freeze crawled pages: results to pages to chunks to drawers, with a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weighbridge.functions.ids import chunk_cite_id, evidence_drawer_id, sha256_text
from weighbridge.functions.text import chunk_text, page_text, word_tokens
from weighbridge.functions.urls import fetch_outcome
from weighbridge.operators.grouped import first_rows
from weighbridge.operators.ranking import dedup_results
from weighbridge.operators.store import evidence_drawers, insert_if_absent
from weighbridge.settings import LIMITS, Limits
from weighbridge.stages import materialize


def read_pages(results: DataFrame, crawl: DataFrame, extractor=None) -> DataFrame:
    """Results with the crawl outcome and text of their page.

    ``crawl(url, status, content_type, body, fetched_at)`` is unique per URL.
    """
    text = F.when(
        (F.col("status") < 400), page_text(F.coalesce("body", F.lit("")), F.col("content_type"), extractor)
    )
    fetched = crawl.withColumn("text", text)
    joined = results.join(fetched, "url", "left")
    outcome = fetch_outcome(F.col("status"), F.col("content_type"), F.col("text"))
    return joined.withColumn("_o", outcome).select("*", "_o.error", "_o.ok").drop("_o", "body")


def page_chunks(pages: DataFrame, limits: Limits = LIMITS, tokenizer=word_tokens, glue: str = " ") -> DataFrame:
    """Chunk rows of the readable pages, with citation and drawer ids and a hash."""
    windows = chunk_text(
        tokenizer(F.col("text")), limits.chunk_tokens, limits.chunk_overlap, limits.max_chunks_per_page,
        limits.passage_max_chars, limits.min_chunk_tokens, glue,
    )
    rows = pages.where("ok").select("question_id", "rank", "url", "fetched_at", F.explode(windows).alias("c"))
    return rows.select(
        "question_id",
        "rank",
        "url",
        "fetched_at",
        chunk_cite_id(F.col("rank"), F.col("c.chunk_index")).alias("cite_id"),
        evidence_drawer_id(F.col("url"), F.col("c.chunk_index")).alias("drawer_id"),
        "c.chunk_index",
        "c.n_tokens",
        F.length("c.text").alias("n_chars"),
        sha256_text(F.col("c.text")).alias("sha256"),
        "c.text",
    )


def freeze(raw_results: DataFrame, crawl: DataFrame, store: DataFrame, limits: Limits = LIMITS) -> dict[str, DataFrame]:
    """Results, pages, chunks, the drawers to append and the manifest counts. Pages and
    chunks are written once; everything else is derived from them. Of a URL crawled more
    than once, the earliest fetch and then the text that sorts first is filed."""
    results = dedup_results(raw_results, limits.max_snippets)
    pages = materialize(read_pages(results, crawl), "frozen-pages")
    chunks = materialize(page_chunks(pages, limits), "frozen-chunks")
    filed = evidence_drawers(
        chunks.withColumn("query_id", F.col("question_id")).withColumn("engine_rank", F.col("rank"))
    )
    meta = F.col("meta")
    order = [F.asc(meta["query_id"]), F.asc(meta["engine_rank"].cast("int")), F.asc("filed_at"), F.asc("text")]
    new = insert_if_absent(filed, store, order)
    return {
        "results": results, "pages": pages, "chunks": chunks, "drawers": new,
        "manifest": manifest_counts(results, pages, chunks, store),
    }


def manifest_counts(results: DataFrame, pages: DataFrame, chunks: DataFrame, store: DataFrame) -> DataFrame:
    """Per question: results, readable pages, chunks, and how many chunks are new."""
    n = F.count(F.lit(1))
    winner = first_rows(chunks, ["drawer_id"], [F.asc("question_id"), F.asc("rank")])
    created = winner.join(store.select("drawer_id"), "drawer_id", "left_anti").groupBy("question_id").agg(n.alias("n_new"))
    out = results.groupBy("question_id").agg(n.alias("n_results"))
    for side in (
        pages.where("ok").groupBy("question_id").agg(n.alias("n_pages")),
        chunks.groupBy("question_id").agg(n.alias("n_chunks")),
        created,
    ):
        out = out.join(side, "question_id", "left")
    filled: list[Column] = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_results", "n_pages", "n_chunks", "n_new")]
    return out.select("question_id", *filled, (F.coalesce("n_chunks", F.lit(0)) - F.coalesce("n_new", F.lit(0))).alias("n_dedup"))
