"""The passage store: insert-if-absent, quarantine, flags, memory write-back.

A store is a table ``drawers(drawer_id, wing, room, text, source_file,
chunk_index, authored_at, filed_at, meta)`` partitioned by ``wing``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weighbridge.functions.ids import evidence_drawer_id, quarantine_drawer_id, subject_slug, verified_drawer_id
from weighbridge.functions.policy import memory_admission
from weighbridge.functions.text import strip
from weighbridge.functions.urls import domain_of
from weighbridge.operators.grouped import first_rows
from weighbridge.settings import EVIDENCE, LIMITS, QUARANTINE, VERIFIED, Limits


def mark_new(arrivals: DataFrame, store: DataFrame, order: list[Column]) -> DataFrame:
    """One row per arriving drawer id, with ``created`` false where the store has it.

    Empty text is an error. The first arrival of an id wins.
    """
    new = insert_if_absent(arrivals, store, order).select("drawer_id", F.lit(True).alias("created"))
    every = first_rows(filed_text(arrivals), ["drawer_id"], order)
    return every.join(new, "drawer_id", "left").withColumn("created", F.coalesce("created", F.lit(False)))


def filed_text(arrivals: DataFrame) -> DataFrame:
    """Arrivals with stripped text; an empty one is an error."""
    text = strip(F.coalesce("text", F.lit("")))
    return arrivals.withColumn(
        "text", F.when(text == "", F.raise_error(F.lit("refusing to file an empty drawer"))).otherwise(text)
    )


def insert_if_absent(arrivals: DataFrame, store: DataFrame, order: list[Column]) -> DataFrame:
    """Rows to append: arrivals whose id the store does not hold yet. Only ids of the
    store are read, and they are neither sorted nor made distinct."""
    unique = first_rows(filed_text(arrivals), ["drawer_id"], order)
    return unique.join(store.select("drawer_id"), "drawer_id", "left_anti")


def filing_counts(arrivals: DataFrame, store: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Arrivals, newly created and de-duplicated rows per group."""
    winner = first_rows(arrivals, ["drawer_id"], order).select("drawer_id", *by)
    created = winner.join(store.select("drawer_id"), "drawer_id", "left_anti")
    new = created.groupBy(*by).agg(F.count(F.lit(1)).alias("n_new"))
    total = arrivals.groupBy(*by).agg(F.count(F.lit(1)).alias("n_arrived"))
    n_new = F.coalesce("n_new", F.lit(0))
    return total.join(new, by, "left").select(
        *by, "n_arrived", n_new.alias("n_new"), (F.col("n_arrived") - n_new).alias("n_dedup")
    )


def evidence_drawers(chunks: DataFrame) -> DataFrame:
    """Chunk rows as evidence drawers; needs ``url, chunk_index, text, fetched_at``
    and optionally ``published_date, query_id, title``."""
    published = F.col("published_date") if "published_date" in chunks.columns else F.lit(None)
    extras = [c for c in ("query_id", "dataset", "engine_rank", "title") if c in chunks.columns]
    pairs = [p for c in extras for p in (F.lit(c), F.col(c).cast("string"))]
    meta = F.map_filter(F.create_map(*pairs, F.lit("url"), F.col("url")), lambda k, v: v.isNotNull())
    return chunks.select(
        evidence_drawer_id(F.col("url"), F.col("chunk_index")).alias("drawer_id"),
        F.lit(EVIDENCE).alias("wing"),
        domain_of(F.col("url")).alias("room"),
        "text",
        F.col("url").alias("source_file"),
        "chunk_index",
        F.coalesce(published.cast("string"), F.col("fetched_at")).alias("authored_at"),
        F.col("fetched_at").alias("filed_at"),
        meta.alias("meta"),
    )


def quarantine_drawers(gated: DataFrame) -> DataFrame:
    """Fetched chunks dropped for prompt injection, as quarantine drawers. Snippets
    are only dropped."""
    bad = gated.where((F.col("reason") == "injection") & (F.col("kind") == "chunk") & F.col("url").isNotNull())
    index = F.coalesce("chunk_index", F.lit(0))
    return bad.select(
        quarantine_drawer_id(F.col("url"), index).alias("drawer_id"),
        F.lit(QUARANTINE).alias("wing"),
        domain_of(F.col("url")).alias("room"),
        "text",
        F.col("url").alias("source_file"),
        index.alias("chunk_index"),
        F.create_map(
            F.lit("injection_prob"), F.col("contains_prompt_injection").cast("string"), F.lit("url"), F.col("url")
        ).alias("meta"),
    )


def flag_drawers(store: DataFrame, gated: DataFrame, flagged_at: Column) -> DataFrame:
    """The store with recalled drawers that tripped the injection gate marked in place."""
    old = F.map_filter("meta", lambda k, v: ~k.isin("flagged_injection", "flagged_at"))
    return (
        store.join(injection_marks(gated, flagged_at), "drawer_id", "left")
        .withColumn("meta", F.when(F.col("mark").isNotNull(), F.map_concat(old, "mark")).otherwise(F.col("meta")))
        .drop("mark")
    )


def injection_marks(gated: DataFrame, flagged_at: Column) -> DataFrame:
    """``drawer_id, mark``: recalled drawers that tripped the injection gate, with the metadata that says so."""
    hits = (
        gated.where((F.col("reason") == "injection") & (F.col("kind") == "drawer"))
        .groupBy("drawer_id")
        .agg(F.max("contains_prompt_injection").alias("_prob"))
    )
    mark = F.create_map(
        F.lit("flagged_injection"), F.col("_prob").cast("string"), F.lit("flagged_at"), flagged_at.cast("string")
    )
    return hits.select("drawer_id", mark.alias("mark"))


def admit_claims(kept: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Kept claims with their admission and, where admitted, the drawer to write.

    ``kept(question_id, query, arm, judge_model, text, citations, choice,
    confidence, cite_to_drawer map<string,string>, verified_at)``. A citation
    without drawer is recorded as ``cite:<id>``.
    """
    judged = kept.withColumn("_m2", memory_admission(F.col("text"), F.col("confidence"), limits))
    ids = F.transform(
        "citations",
        lambda c: F.coalesce(F.try_element_at(F.col("cite_to_drawer"), c), F.concat(F.lit("cite:"), c)),
    )
    return judged.select(
        "question_id",
        "arm",
        F.col("_m2.admitted").alias("admitted"),
        F.col("_m2.reason").alias("skip_reason"),
        F.when(F.col("_m2.admitted"), verified_drawer_id(F.col("question_id"), F.col("_m2.text"))).alias("drawer_id"),
        F.lit(VERIFIED).alias("wing"),
        subject_slug(F.col("query")).alias("room"),
        F.col("_m2.text").alias("text"),
        F.concat(F.lit("claim:"), F.col("question_id")).alias("source_file"),
        F.col("verified_at").alias("authored_at"),
        F.col("confidence").alias("support_prob"),
        F.col("choice").alias("support_choice"),
        "judge_model",
        F.array_join(ids, ",").alias("evidence_drawer_ids"),
    )


def replace_below(entries: DataFrame, redone: DataFrame, at_least: int, key: str = "question_id") -> DataFrame:
    """Entries with fewer than ``at_least`` results give way to their redone version."""
    weak = entries.where(F.col("n_results") < at_least).select(key)
    fresh = redone.join(weak, key, "left_semi")
    stay = entries.join(fresh.select(key), key, "left_anti")
    return stay.unionByName(fresh, allowMissingColumns=True)


def pending(wanted: DataFrame, done: DataFrame, stamp: Column | None = None, key: str = "question_id") -> DataFrame:
    """Questions still to answer. Prior rows count only while their evidence stamp
    equals ``stamp``; rows without a stamp are accepted."""
    if stamp is not None:
        done = done.where(F.col("manifest_stamp").isNull() | (F.col("manifest_stamp") == stamp))
    return wanted.join(done.select(key), key, "left_anti")
