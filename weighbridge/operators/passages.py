"""Passages under judgment: builders, judge states, gate, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weighbridge.functions.ids import snippet_cite_id
from weighbridge.functions.policy import known, route
from weighbridge.functions.text import prepare_text, strip
from weighbridge.functions.urls import domain_of, source_type
from weighbridge.operators.grouped import strict_join, union_all
from weighbridge.settings import GATE_QUESTIONS, LIMITS, MEMORY_DOMAIN, Limits


def _passage(id: Column, text: Column, kind: str, lane: str, title: Column, domain: Column, wing: Column) -> list[Column]:
    named = F.lower(F.coalesce(F.nullif(domain, F.lit("")), F.lit("unknown")))
    return [
        id.alias("id"),
        prepare_text(text).alias("text"),
        strip(F.coalesce(title, F.lit(""))).alias("title"),
        named.alias("domain"),
        source_type(domain, wing).alias("source_type"),
        F.lit(kind).alias("kind"),
        F.lit(lane).alias("lane"),
    ]


def snippet_passages(results: DataFrame) -> DataFrame:
    """Search snippets with text, one passage per result row."""
    no_wing = F.lit(None).cast("string")
    usable = results.where(strip(F.coalesce("snippet", F.lit(""))) != "")
    return usable.select(
        "question_id",
        *_passage(
            snippet_cite_id(F.col("rank")), F.col("snippet"), "snippet", "web",
            F.col("title"), domain_of(F.col("url")), no_wing,
        ),
        F.col("rank").alias("engine_rank"),
        F.size(F.coalesce("engines", F.array().cast("array<string>"))).alias("n_engines"),
        "url",
    )


def chunk_passages(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """Page chunks with the title, URL and rank of their result."""
    page = results.select("question_id", "rank", "title", "url", "engines")
    no_wing = F.lit(None).cast("string")
    return chunks.drop("url", "title", "engines").join(page, ["question_id", "rank"]).select(
        "question_id",
        *_passage(
            F.col("cite_id"), F.col("text"), "chunk", "web", F.col("title"), domain_of(F.col("url")), no_wing
        ),
        F.col("rank").alias("engine_rank"),
        F.size(F.coalesce("engines", F.array().cast("array<string>"))).alias("n_engines"),
        "url",
        "drawer_id",
        "chunk_index",
        "n_tokens",
    )


def drawer_passages(hits: DataFrame) -> DataFrame:
    """Recalled drawers: titled by their room and typed by their wing."""
    return hits.select(
        "question_id",
        *_passage(
            F.col("cite_id"), F.col("text"), "drawer", "palace",
            F.col("room"), F.lit(MEMORY_DOMAIN), F.col("wing"),
        ),
        "drawer_id",
        "similarity",
        "authored_at",
    )


def all_passages(*frames: DataFrame) -> DataFrame:
    """One table of passages from all lanes."""
    return union_all(list(frames))


def intake_state(query: Column, today: Column, has_verified_hits: Column) -> Column:
    return F.struct(
        query.alias("query"),
        today.alias("today"),
        F.coalesce(has_verified_hits, F.lit(False)).alias("palace_has_verified_hits"),
    )


def gate_state(query: Column) -> Column:
    """The query and five passage fields; provenance never reaches the judge."""
    return F.struct(
        query.alias("query"),
        F.struct("id", "title", "domain", "source_type", "text").alias("passage"),
    )


def claim_state(query: Column, claim: Column, cited: Column) -> Column:
    return F.struct(query.alias("query"), claim.alias("claim"), cited.alias("cited_evidence"))


def answer_state(query: Column, answer: Column) -> Column:
    return F.struct(query.alias("query"), answer.alias("answer"))


def sufficiency_states(selected: DataFrame) -> DataFrame:
    """Per question the selected evidence in order. ``selected`` holds at most
    ``top_evidence_k`` rows per question, so the list is short."""
    item = F.struct("position", "id", "text")
    return selected.groupBy("question_id").agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda e: F.struct(e["id"].alias("id"), e["text"].alias("text"))).alias("evidence")
    )


def wide_answers(judgments: DataFrame, keys: list[str], question_ids: tuple[str, ...] = GATE_QUESTIONS) -> DataFrame:
    """One row per judged item with one probability column per question."""
    return judgments.where(F.col("qid").isin(*question_ids)).groupBy(*keys).agg(
        *[F.max(F.when(F.col("qid") == q, known(F.col("value")))).alias(q) for q in question_ids]
    )


def gate(passages: DataFrame, judgments: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Passages with their five probabilities, route and reason.

    ``judgments(question_id, id, qid, value)`` in long form. A passage without any
    judgment is an error.
    """
    wide = wide_answers(judgments, ["question_id", "id"])
    return strict_join(passages, wide, ["question_id", "id"], "passage without judgment").withColumn(
        "gate",
        route(
            F.col("contains_prompt_injection"),
            F.col("is_promotional_or_boilerplate"),
            F.col("is_relevant"),
            F.col("contradicts_query_premise"),
            F.col("contains_answer_evidence"),
            limits,
        ),
    ).select("*", "gate.route", "gate.reason").drop("gate")


def gate_counts(gated: DataFrame, by: list[str]) -> DataFrame:
    """Passages per route and reason."""
    return gated.groupBy(*by, "route", "reason").agg(F.count(F.lit(1)).alias("n"))


def evidence_lines(items: Column) -> Column:
    """``[id] text`` lines of an ordered ``array<struct<id,text>>``."""
    return F.transform(items, lambda e: F.concat(F.lit("["), e["id"], F.lit("] "), e["text"]))


def user_message(query: Column, evidence: Column, conflicts: Column, note: Column | None = None) -> Column:
    """Prompt body: evidence, conflicts where there are any, then the question."""
    note = F.lit(None).cast("string") if note is None else note
    empty = F.array().cast("array<string>")
    listed = F.coalesce(evidence_lines(conflicts), empty)
    shown = (F.size(listed) > 0) | note.isNotNull()
    parts = F.concat(
        F.array(F.lit("EVIDENCE:")),
        F.coalesce(evidence_lines(evidence), empty),
        F.when(shown, F.concat(F.array(F.lit("CONFLICTS:")), listed)).otherwise(empty),
        F.when(note.isNotNull(), F.array(note)).otherwise(empty),
        F.array(F.lit(""), F.concat(F.lit("QUESTION: "), query)),
    )
    return F.array_join(parts, "\n")


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """A ``{name}`` template with columns filled in; ``{{`` and ``}}`` are braces."""
    import string

    parts: list[Column] = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(F.coalesce(values[name], F.lit("")))
    return F.concat(*parts)


def cited_passages(citations: Column, texts: Column) -> Column:
    """Texts of the cited ids in citation order, from a per-record ``map<id,text>``;
    unknown ids are left out."""
    known_ids = F.filter(citations, lambda c: F.array_contains(F.map_keys(texts), c))
    return F.transform(known_ids, lambda c: F.struct(c.alias("id"), F.try_element_at(texts, c).alias("text")))


def claim_prompt(template: str, question: Column, plain_claim: Column, cited: Column) -> Column:
    """Grader prompt of one claim; ``(none)`` stands for an empty evidence list."""
    listed = F.array_join(evidence_lines(cited), "\n")
    evidence = F.coalesce(F.nullif(listed, F.lit("")), F.lit("(none)"))
    return fill_template(template, {"question": question, "claim": plain_claim, "evidence": evidence})


def grade_prompt(template: str, question: Column, target: Column, answer: Column) -> Column:
    return fill_template(template, {"question": question, "target": target, "predicted_answer": answer})
