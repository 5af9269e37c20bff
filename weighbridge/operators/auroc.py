"""AUROC from label histograms, ties counted half."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weighbridge.functions.answers import grid_bin
from weighbridge.operators.grouped import sum_before


def label_histogram(rows: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """Positives and negatives per distinct score; the only pass over raw rows."""
    usable = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    return usable.groupBy(*by, score).agg(
        F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg")
    )


def _below(hist: DataFrame, by: list[str], score: str, on_grid: bool, value: str, out: str) -> DataFrame:
    """Total of ``value`` over strictly lower scores. Free scores are summed by
    stretches of their order, so no task sees all distinct scores of a judge."""
    if on_grid:
        below = W.partitionBy(*by).orderBy(score).rowsBetween(W.unboundedPreceding, -1)
        return hist.withColumn(out, F.coalesce(F.sum(value).over(below), F.lit(0)))
    return sum_before(hist, by, [F.asc(score)], value, out)


def auroc(hist: DataFrame, by: list[str], score: str = "score", on_grid: bool = False) -> DataFrame:
    """``by, auroc, positives, negatives``; NULL when a class is empty."""
    wins = F.sum(F.col("pos") * (F.col("_neg_below") + F.col("neg") / 2))
    return (
        _below(hist, by, score, on_grid, "neg", "_neg_below")
        .groupBy(*by)
        .agg(
            F.try_divide(wins, F.sum("pos") * F.sum("neg")).alias("auroc"),
            F.sum("pos").alias("positives"),
            F.sum("neg").alias("negatives"),
        )
    )


def auroc_within(pairs: DataFrame, by: list[str], bucket_score: Column, bucket: int, score: str, label: str) -> DataFrame:
    """AUROC of one judge's score among items another judge put in one grid bucket."""
    inside = pairs.where(grid_bin(bucket_score) == bucket)
    return auroc(label_histogram(inside, by, score, label), by, score)


def within_clusters(hist: DataFrame, by: list[str], cluster: str, score: str = "score", on_grid: bool = False) -> DataFrame:
    """Pair-weighted mean of the AUROC inside each cluster, and how many clusters count."""
    per = auroc(hist, [*by, cluster], score, on_grid).where(F.col("auroc").isNotNull())
    pairs = F.col("positives") * F.col("negatives")
    return per.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("auroc") * pairs), F.sum(pairs)).alias("auroc_within"),
        F.count(F.lit(1)).alias("clusters"),
    )


def leave_one_out(hist: DataFrame, by: list[str], cluster: str, score: str = "score", on_grid: bool = False) -> DataFrame:
    """AUROC without each cluster in turn, from totals instead of rescans.

    Winning pairs that involve a cluster are its positives over all negatives,
    plus all positives over its negatives, less the pairs inside it.
    """
    overall = hist.groupBy(*by, score).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    ranked = _below(overall, by, score, on_grid, "neg", "_neg_below")
    ranked = _below(ranked, by, score, on_grid, "pos", "_pos_below")
    totals = ranked.groupBy(*by).agg(
        F.sum(F.col("pos") * (F.col("_neg_below") + F.col("neg") / 2)).alias("_wins"),
        F.sum("pos").alias("_pos"),
        F.sum("neg").alias("_neg"),
    )
    at = ranked.select(
        *by, score,
        (F.col("_neg_below") + F.col("neg") / 2).alias("_beats"),
        (F.col("_pos_below") + F.col("pos") / 2).alias("_pos_lower"),
    )
    outer = (
        hist.join(at, [*by, score])
        .groupBy(*by, cluster)
        .agg(
            F.sum(F.col("pos") * F.col("_beats")).alias("_own_pos"),
            F.sum(F.col("neg") * F.col("_pos_lower")).alias("_lost"),
            F.sum("pos").alias("_cpos"),
            F.sum("neg").alias("_cneg"),
        )
    )
    inner = auroc(hist, [*by, cluster], score, on_grid).select(
        *by, cluster, F.coalesce(F.col("auroc") * F.col("positives") * F.col("negatives"), F.lit(0.0)).alias("_inner")
    )
    joined = outer.join(inner, [*by, cluster]).join(totals, by)
    # all positives over this cluster's negatives = neg * positives above, ties half
    against = F.col("_cneg") * F.col("_pos") - F.col("_lost")
    wins = F.col("_wins") - F.col("_own_pos") - against + F.col("_inner")
    rest = (F.col("_pos") - F.col("_cpos")) * (F.col("_neg") - F.col("_cneg"))
    return joined.select(*by, cluster, F.try_divide(wins, rest).alias("auroc_without"))


def jackknife(hist: DataFrame, by: list[str], cluster: str, score: str = "score", on_grid: bool = False) -> DataFrame:
    """Point AUROC, leave-one-cluster-out range and a normal jackknife interval."""
    left_out = leave_one_out(hist, by, cluster, score, on_grid).where(F.col("auroc_without").isNotNull())
    k = F.count(F.lit(1))
    spread = left_out.groupBy(*by).agg(
        F.min("auroc_without").alias("loo_min"),
        F.max("auroc_without").alias("loo_max"),
        k.alias("clusters"),
        F.sqrt((k - 1) * F.var_pop("auroc_without")).alias("jackknife_se"),
    )
    overall = hist.groupBy(*by, score).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    both = auroc(overall, by, score, on_grid).join(spread, by)
    return both.withColumn("ci_lo", F.col("auroc") - 1.96 * F.col("jackknife_se")).withColumn(
        "ci_hi", F.col("auroc") + 1.96 * F.col("jackknife_se")
    )
