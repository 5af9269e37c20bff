"""Score spread: can a threshold on this judge's score move at all?

One pass reduces scores to a 101-bin histogram per judge; everything else reads
that histogram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weighbridge.functions.answers import grid_bin

GRID = 100


def score_histogram(scores: DataFrame, by: list[str], score: Column | None = None) -> DataFrame:
    score = F.col("score") if score is None else score
    return scores.select(*by, grid_bin(score).alias("bin")).groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n")
    )


def spread(histogram: DataFrame, by: list[str], top: int = 3, low: int = 10, high: int = 90) -> DataFrame:
    """n, distinct grid values, mass on the ``top`` commonest values, interior mass
    and gate mobility. Bin 100 does not count towards mobility."""
    counts = F.slice(F.sort_array(F.collect_list("n"), asc=False), 1, top)  # at most 101 bins
    total = F.sum("n")
    return (
        histogram.where(F.col("bin").isNotNull())
        .groupBy(*by)
        .agg(
            total.alias("n"),
            F.count("bin").alias("distinct_values"),
            F.try_divide(F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x), total).alias(f"top{top}_mass"),
            F.try_divide(F.sum(F.when(F.col("bin").between(low, high), F.col("n")).otherwise(0)), total).alias("interior_mass"),
            (F.count(F.when(F.col("bin") < GRID, 1)) / GRID).alias("gate_mobility"),
        )
    )


def accept_curve(histogram: DataFrame, by: list[str]) -> DataFrame:
    """Share of scores at or above each of the 101 grid thresholds."""
    grid = histogram.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(GRID))))
    down = W.partitionBy(*by).orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*by)
    filled = grid.join(histogram, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.select(
        *by, "bin", (F.sum("n").over(down) / F.sum("n").over(whole)).alias("accepted")
    )


def curve_mobility(curve: DataFrame, by: list[str]) -> DataFrame:
    """Share of adjacent threshold steps that change what is accepted."""
    step = W.partitionBy(*by).orderBy("bin")
    moved = curve.withColumn("_moved", F.abs(F.col("accepted") - F.lag("accepted").over(step)) > 1e-9)
    return moved.groupBy(*by).agg((F.count_if("_moved") / (F.count(F.lit(1)) - 1)).alias("mobility"))


def top_values(histogram: DataFrame, by: list[str], k: int = 3) -> DataFrame:
    """The k commonest grid values with their share of all scores."""
    whole = W.partitionBy(*by)
    ranked = W.partitionBy(*by).orderBy(F.desc("n"), F.asc("bin"))
    return (
        histogram.withColumn("share", F.col("n") / F.sum("n").over(whole))
        .withColumn("position", F.row_number().over(ranked))
        .where(F.col("position") <= k)
    )
