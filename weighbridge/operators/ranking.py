"""Candidate ranking: rank lists, reciprocal rank fusion, budgets, page picks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weighbridge.functions.text import count_tokens
from weighbridge.functions.urls import canonical_url
from weighbridge.operators.grouped import (
    RankList,
    competition_ranks,
    first_rows,
    running_sum,
    sum_before,
    top_rows,
)
from weighbridge.settings import LIMITS, Limits


def rank_lists() -> list[RankList]:
    """Retriever position (more engines first on a tie), memory similarity, and
    the judge's evidence probability."""
    return [
        RankList(
            "retriever_rank",
            (("engine_rank", False), ("n_engines", True)),
        ),
        RankList("memory_rank", (("similarity", True),)),
        RankList("evidence_rank", (("evidence", True),)),
    ]


def fuse(candidates: DataFrame, k: int = LIMITS.rrf_k) -> DataFrame:
    """Fused score of every candidate over the three rank lists.

    Needs ``question_id, id, engine_rank, n_engines, similarity, evidence``. A
    list a candidate is absent from adds nothing; one absent from all is not
    ranked at all and drops out.
    """
    ranked = competition_ranks(candidates, ["question_id"], rank_lists())
    names = [r.out for r in rank_lists()]
    share = [F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(n)), F.lit(0.0)) for n in names]
    return (
        ranked.withColumn("rrf_score", share[0] + share[1] + share[2])
        .withColumn("best_rank", F.least(*[F.col(n) for n in names]))
        .where(F.col("best_rank").isNotNull())
    )


def fused_order():
    return [F.desc("rrf_score"), F.asc("best_rank"), F.asc("id")]


def select_within_budget(
    fused: DataFrame, top_k: int = LIMITS.top_evidence_k, max_tokens: int = LIMITS.max_evidence_tokens,
    tokenizer=None,
) -> DataFrame:
    """Prefix of the fused order: at most ``top_k`` passages, stopping at the first
    one that would overflow the token budget."""
    if "text" in fused.columns:
        counted = count_tokens(F.col("text"), tokenizer) if tokenizer else count_tokens(F.col("text"))
        fused = fused.withColumn("n_tokens", F.coalesce(F.nullif(F.col("n_tokens"), F.lit(0)), counted))
    head = top_rows(fused, ["question_id"], fused_order(), top_k)
    # at most top_k rows per question are left, already partitioned by question
    upto = W.partitionBy("question_id").orderBy("position").rowsBetween(W.unboundedPreceding, 0)
    return head.withColumn("used_tokens", F.sum("n_tokens").over(upto)).where(F.col("used_tokens") <= max_tokens)


def baseline_evidence(
    results: DataFrame, chunks: DataFrame, pages: int = LIMITS.baseline_pages,
    max_tokens: int = LIMITS.baseline_tokens,
) -> DataFrame:
    """Ungated evidence: chunks of the first pages in rank order up to a token
    budget; a page without chunks is represented by its snippet.

    ``results(question_id, rank, snippet)``, ``chunks(question_id, rank,
    chunk_index, cite_id, drawer_id, n_tokens, text)``.
    """
    head = results.where(F.col("rank") <= pages)
    from_chunks = chunks.join(head.select("question_id", "rank"), ["question_id", "rank"], "left_semi")
    bare = head.where(F.coalesce("snippet", F.lit("")) != "").join(
        chunks.select("question_id", "rank"), ["question_id", "rank"], "left_anti"
    )
    snippets = bare.select(
        "question_id",
        "rank",
        F.lit(0).alias("chunk_index"),
        F.format_string("r%02ds", "rank").alias("cite_id"),
        F.lit(None).cast("string").alias("drawer_id"),
        count_tokens(F.col("snippet")).alias("n_tokens"),
        F.col("snippet").alias("text"),
    )
    columns = snippets.columns
    candidates = from_chunks.select(*columns).unionByName(snippets)
    blocked = candidates.withColumn("_part", F.floor(F.col("chunk_index") / 64))
    return running_sum(
        blocked, ["question_id"], ["rank", "_part"], [F.asc("chunk_index")],
        "n_tokens", "used_tokens", max_tokens,
    ).drop("_part")


def dedup_results(results: DataFrame, max_results: int = LIMITS.max_snippets) -> DataFrame:
    """First result per canonical URL and question, re-ranked and cut.

    ``results(question_id, pos, url, ...)``; a row without URL is skipped and a
    missing engine list falls back to the single ``engine``.
    """
    usable = results.where(F.coalesce("url", F.lit("")) != "").withColumn("_url", canonical_url(F.col("url")))
    if "engines" in usable.columns and "engine" in usable.columns:
        single = F.when(F.coalesce("engine", F.lit("")) != "", F.array("engine"))
        listed = F.when(F.size("engines") > 0, F.col("engines"))
        usable = usable.withColumn(
            "engines", F.coalesce(listed, single, F.array().cast("array<string>"))
        )
    unique = first_rows(usable, ["question_id", "_url"], [F.asc("pos")])
    return top_rows(unique, ["question_id"], [F.asc("pos")], max_results, "rank").drop("_url")


def pick_pages(survivors: DataFrame, pages: DataFrame, max_pages: int = LIMITS.max_pages) -> DataFrame:
    """Survivor snippets whose page is read, with what stands for the page.

    ``survivors(question_id, id, engine_rank, ...)``, ``pages(question_id, rank,
    fetched, n_chunks)``. ``stands_in`` is ``chunks`` or, after a failed fetch,
    ``snippet``. Survivors beyond ``max_pages`` are not returned.
    """
    head = top_rows(survivors, ["question_id"], [F.asc("engine_rank"), F.asc("id")], max_pages, "pick")
    page = pages.select("question_id", F.col("rank").alias("engine_rank"), "fetched", "n_chunks")
    good = F.coalesce(F.col("fetched") & (F.col("n_chunks") > 0), F.lit(False))
    return head.join(page, ["question_id", "engine_rank"], "left").withColumn(
        "stands_in", F.when(good, "chunks").otherwise("snippet")
    )


def conflict_block(conflicts: DataFrame, top_k: int = LIMITS.top_evidence_k) -> DataFrame:
    """The passages that contradict the premise most, best first."""
    order = [F.desc(F.coalesce("contradicts", F.lit(0.0))), F.asc("id")]
    return top_rows(conflicts, ["question_id"], order, top_k)


def mid_ranks(scores: DataFrame, group: list[str], score: str = "score") -> DataFrame:
    """Average rank of every distinct score in ascending order."""
    keyed = (
        scores.where(F.col(score).isNotNull())
        .groupBy(*group, score)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    lower = sum_before(keyed, group, [F.asc(score)], "n", "_lower")
    return lower.select(*group, score, "n", (F.col("_lower") + (F.col("n") + 1) / 2).alias("mid_rank"))


def worklist_order(rows: DataFrame) -> DataFrame:
    """Most confident first, with a total order."""
    return rows.orderBy(F.desc("confidence"), F.asc("question_id"))


def rank_and_select(evidence: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Fusion followed by the evidence budget."""
    return select_within_budget(fuse(evidence, limits.rrf_k), limits.top_evidence_k, limits.max_evidence_tokens)
