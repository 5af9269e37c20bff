"""Writers: triples, public aggregates, worklists, result records, stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.operators.ranking import worklist_order

# Column names that carry per-row model input or output and must
# never reach the public split.
PRIVATE_COLUMNS = frozenset({"state", "state_id", "instructions", "criteria", "probabilities", "text", "passage_text"})


def write_triples(triples: DataFrame, path: str) -> None:
    """JSON lines, one folder per model family."""
    triples.write.mode("overwrite").partitionBy("family").json(path)


def write_paired_states(states: DataFrame, path: str) -> None:
    states.select("state_id").write.mode("overwrite").json(path)


def write_aggregates(statistics: DataFrame, histogram: DataFrame, path: str) -> None:
    """Public split: statistics as JSON, the paired histogram as CSV. Refuses any
    column that carries per-row states or outputs."""
    for frame in (statistics, histogram):
        leaked = PRIVATE_COLUMNS.intersection(frame.columns)
        if leaked:
            raise ValueError(f"private columns in the public split: {sorted(leaked)}")
    statistics.write.mode("overwrite").json(f"{path}/statistics")
    rows = histogram.select(
        F.col("family").alias("model"), F.format_string("%.2f", F.col("bin") / 100).alias("probability"), F.col("n").alias("count")
    )
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/histogram")


def write_worklist(rescuable: DataFrame, path: str) -> None:
    """JSON lines, most confident first across the part files."""
    worklist_order(rescuable).write.mode("overwrite").json(path)


def write_results(records: DataFrame, header: DataFrame, path: str) -> None:
    """Records partitioned by run, and one header row per run. Only the partitions
    present in the data are replaced."""
    for name, frame in (("records", records), ("header", header)):
        (
            frame.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("arm", "dataset", "snapshot")
            .parquet(f"{path}/{name}")
        )


def results_header(records: DataFrame, usage: DataFrame, seed: int, today: str, spec_version: str = "v1") -> DataFrame:
    """One row per run: identity, size, completeness and judge totals.

    ``records(arm, dataset, snapshot, manifest_stamp, question_id, done)``,
    ``usage(arm, n_requests, n_cached, input_tokens, output_tokens, cost_usd)``.
    """
    run = ["arm", "dataset", "snapshot"]
    sized = records.groupBy(*run, "manifest_stamp").agg(
        F.count(F.lit(1)).alias("n"), F.every("done").alias("complete")
    )
    return sized.join(usage, "arm", "left").select(
        "*", F.lit(seed).alias("seed"), F.lit(today).alias("today"), F.lit(spec_version).alias("spec_version"),
        F.round(F.try_divide("n_requests", "n"), 1).alias("per_query_requests"),
    )


def append_drawers(drawers: DataFrame, path: str) -> None:
    drawers.write.mode("append").partitionBy("wing").parquet(path)
