"""Decision policy: first-match-wins rules over judge probabilities.

NaN compares above every number in Spark but fails every comparison in the
policy, so probabilities pass through ``known`` first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weighbridge.functions.citations import plain_sentence
from weighbridge.settings import LIMITS, Limits


def known(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def intake(
    needs: Column,
    source: Column,
    source_confidence: Column,
    recency: Column,
    recency_confidence: Column,
    category: Column,
    category_confidence: Column,
    has_verified_hits: Column,
    force_search: bool | Column = False,
    force_web: bool | Column = False,
    limits: Limits = LIMITS,
) -> Column:
    """Retrieval plan of a query. Uncertainty widens the search, never narrows it."""
    floor = limits.choice_floor
    force_search = F.lit(force_search) if isinstance(force_search, bool) else force_search
    force_web = F.lit(force_web) if isinstance(force_web, bool) else force_web
    judged = F.coalesce(needs >= limits.needs_search_min, F.lit(False))
    source_judged = (
        F.when(source_confidence < floor, "both")
        .when((source == "palace") & ~has_verified_hits, "both")
        .otherwise(source)
    )
    window = F.when(
        (recency_confidence >= floor) & recency.isin("year", "month", "week", "day"), recency
    )
    return F.struct(
        (force_search | judged).alias("retrieve"),
        judged.alias("retrieve_judged"),
        F.when(force_web, "web").otherwise(source_judged).alias("source"),
        source_judged.alias("source_judged"),
        window.alias("time_range"),
        F.when(category_confidence < floor, "general").otherwise(category).alias("category"),
        force_search.alias("forced_search"),
        force_web.alias("forced_web"),
    )


def route(
    injection: Column,
    boilerplate: Column,
    relevant: Column,
    contradicts: Column,
    evidence: Column,
    limits: Limits = LIMITS,
) -> Column:
    """``struct<route,reason>`` of a judged passage; every bound is strict."""

    def outcome(name: str, reason: str) -> Column:
        return F.struct(F.lit(name).alias("route"), F.lit(reason).alias("reason"))

    return (
        F.when(known(injection) > limits.injection_max, outcome("DROP", "injection"))
        .when(known(boilerplate) > limits.boilerplate_max, outcome("DROP", "boilerplate"))
        .when(known(relevant) < limits.relevant_min, outcome("DROP", "off_topic"))
        .when(known(contradicts) > limits.contradicts_min, outcome("CONFLICT", "contradicts_premise"))
        .when(known(evidence) > limits.evidence_min, outcome("EVIDENCE", "evidence"))
        .otherwise(outcome("DROP", "nothing_usable"))
    )


def sufficiency(
    sufficient: Column, conflicts: Column, round_index: Column, limits: Limits = LIMITS
) -> Column:
    """generate, refine or abstain. A NULL probability means nothing was judged."""
    enough = F.coalesce(known(sufficient) >= limits.sufficient_min, F.lit(False))
    return F.struct(
        F.when(enough, "generate")
        .when(round_index < limits.max_refine_rounds, "refine")
        .otherwise("abstain")
        .alias("action"),
        enough.alias("sufficient"),
        F.coalesce(known(conflicts) >= limits.conflicts_min, F.lit(False)).alias("conflicts"),
        F.when(sufficient.isNull(), "no_evidence").alias("reason"),
    )


def claim_verdict(choice: Column, confidence: Column, limits: Limits = LIMITS) -> Column:
    """``struct<verdict,reason>`` of a verified claim; a kept claim has no reason."""
    sure = F.coalesce(known(confidence) >= limits.support_accept, F.lit(False))
    verdict = (
        F.when(sure & (choice == "supported"), "keep")
        .when(sure & (choice == "contradicted"), "conflict")
        .otherwise("strip")
    )
    reason = (
        F.when(verdict == "conflict", "contradicted")
        .when(choice == "supported", "supported_low_confidence")
        .when(choice == "contradicted", "contradicted_low_confidence")
        .otherwise("unsupported")
    )
    return F.struct(verdict.alias("verdict"), F.when(verdict != "keep", reason).alias("reason"))


def rebuilt_answer(kept_sentences: Column, removed_texts: Column) -> Column:
    """Answer without the removed sentences. Removal is by text, so a kept twin goes too."""
    left = F.filter(kept_sentences, lambda s: ~F.array_contains(removed_texts, s))
    return F.trim(F.array_join(left, " "))


def answer_outcome(n_kept: Column, addresses: Column, answer: Column, limits: Limits = LIMITS) -> Column:
    """``struct<abstained,abstain_reason,answer>`` after verification."""
    reason = F.when(n_kept == 0, "no_claims_kept").when(
        ~F.coalesce(known(addresses) >= limits.addresses_min, F.lit(False)), "answer_off_target"
    )
    return F.struct(
        reason.isNotNull().alias("abstained"),
        reason.alias("abstain_reason"),
        F.when(reason.isNull(), answer).otherwise("").alias("answer"),
    )


def memory_admission(claim_text: Column, confidence: Column, limits: Limits = LIMITS) -> Column:
    """``struct<admitted,text,reason>``: which kept claims may be remembered."""
    text = plain_sentence(claim_text)
    admitted = F.coalesce(confidence >= limits.memory_write_min, F.lit(False)) & (text != "")
    return F.struct(
        admitted.alias("admitted"),
        text.alias("text"),
        F.when(~admitted, "below_memory_write_min").alias("reason"),
    )
