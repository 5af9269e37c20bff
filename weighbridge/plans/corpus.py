"""Judge cache to corpus: private triples and public aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.operators.paired import (
    family_of,
    judgment_triples,
    model_statistics,
    pair_judges,
    paired_histogram,
    paired_states,
    paired_statistics,
)
from weighbridge.sources.writers import write_aggregates, write_paired_states, write_triples
from weighbridge.stages import materialize


def with_families(cache: DataFrame, exact: dict[str, str], prefixes: dict[str, str]) -> DataFrame:
    """Cache entries of the known model families; the rest are skipped (and countable)."""
    return cache.withColumn("family", family_of(F.col("model"), exact, prefixes)).where(F.col("family").isNotNull())


def corpus_tables(requests: DataFrame, families: list[str], compat_stages: bool = False) -> dict[str, DataFrame]:
    """Every table of the export from ``requests`` (see ``judgment_triples``)."""
    triples = materialize(judgment_triples(requests, compat_stages), "triples")
    shared = triples.join(paired_states(requests), "state_id", "left_semi")
    pairs = pair_judges(shared, families)
    tables = {
        "triples": triples,
        "paired_states": paired_states(requests),
        "statistics": model_statistics(triples, requests),
        "paired_histogram": paired_histogram(pairs, families),
    }
    if len(families) == 2:
        tables["paired_statistics"] = paired_statistics(pairs, *families)
    return tables


def distinct_queries(requests: DataFrame) -> DataFrame:
    """Distinct queries among the paired states."""
    rows = requests.join(paired_states(requests), "state_id", "left_semi").where(F.col("query").isNotNull())
    return rows.select("query").distinct().agg(F.count(F.lit(1)).alias("distinct_questions"))


def export_corpus(requests: DataFrame, families: list[str], path: str, compat_stages: bool = False) -> None:
    """Write the private split under ``raw`` and the aggregate split under ``public``."""
    tables = corpus_tables(requests, families, compat_stages)
    write_triples(tables["triples"], f"{path}/raw/triples")
    write_paired_states(tables["paired_states"], f"{path}/raw/paired_states")
    write_aggregates(tables["statistics"], tables["paired_histogram"], f"{path}/public")
