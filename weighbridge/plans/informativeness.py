"""Does a judge's score find the passages that state the gold answer?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.functions.answers import grid_bin
from weighbridge.operators.auroc import label_histogram
from weighbridge.operators.gates import within_buckets
from weighbridge.operators.paired import label_by_gold
from weighbridge.operators.resample import auroc_with_interval, paired_difference
from weighbridge.settings import RESAMPLES


def labelled(judgments: DataFrame, gold: DataFrame, qid: str = "contains_answer_evidence") -> DataFrame:
    """``family, state_id, query, score, label`` of all usable judgments of every family."""
    return label_by_gold(judgments, gold, qid, [F.desc("seq")], by=("family",))


def single_judge(rows: DataFrame, resamples: int = RESAMPLES) -> DataFrame:
    """AUROC with interval per judge over all its passages."""
    hist = label_histogram(rows.withColumnRenamed("query", "cluster"), ["family", "cluster"])
    return auroc_with_interval(hist, ["family"], resamples=resamples)


def paired_judges(rows: DataFrame, first: str = "first", second: str = "second") -> DataFrame:
    """Passages both named judges scored: ``state_id, cluster, label, first, second``."""
    wide = rows.where(F.col("family").isin(first, second)).groupBy("state_id").agg(
        F.max(F.when(F.col("family") == first, F.col("score"))).alias("first"),
        F.max(F.when(F.col("family") == second, F.col("score"))).alias("second"),
        F.max_by("label", F.col("family") == first).alias("label"),
        F.max_by("query", F.col("family") == first).alias("cluster"),
    )
    return wide.where(F.col("first").isNotNull() & F.col("second").isNotNull())


def paired_auroc(pairs: DataFrame, resamples: int = RESAMPLES) -> DataFrame:
    """Both AUROCs on the same passages, their difference and its interval."""
    long = pairs.select(
        F.lit(1).alias("all"), "cluster", "label",
        F.explode(F.array(*[F.struct(F.lit(j).alias("judge"), F.col(j).alias("score")) for j in ("first", "second")])).alias("s"),
    ).select("all", "cluster", "label", "s.judge", "s.score")
    hist = label_histogram(long, ["all", "judge", "cluster"])
    return paired_difference(hist, ["all"], "judge", "first", "second", resamples=resamples).drop("all")


def inside_buckets(pairs: DataFrame, resamples: int = RESAMPLES) -> DataFrame:
    """AUROC of the first judge inside the grid buckets 1.00, 0.50 and 0.00 of the
    second; no AUROC where a class is too small."""
    placed = pairs.withColumn("bucket", grid_bin(F.col("second"))).withColumn("score", F.col("first"))
    sizes = within_buckets(placed.withColumn("all", F.lit(1)), ["all"], "bucket").drop("all")
    ready = placed.join(sizes.where(~F.col("too_small")).select("bucket"), "bucket", "left_semi")
    inside = auroc_with_interval(label_histogram(ready, ["bucket", "cluster"]), ["bucket"], resamples=resamples)
    return sizes.join(inside.select("bucket", "auroc", "ci_lo", "ci_hi", "clusters"), "bucket", "left")
