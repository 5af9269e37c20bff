"""Judge audit: spread and, with labels, AUROC with a cluster interval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.functions.answers import grid_bin
from weighbridge.operators.resample import auroc_with_interval
from weighbridge.operators.spread import spread
from weighbridge.settings import RESAMPLES
from weighbridge.stages import materialize


def audit(scores: DataFrame, resamples: int = RESAMPLES, on_grid: bool = False) -> DataFrame:
    """One row per judge from ``scores(judge, cluster, score, label)``.

    One aggregation by judge, cluster and score feeds both the spread and the
    resampling. Rows without label count towards the spread only. ``on_grid``
    measures AUROC on 0.01 bins, which bounds every later step by 101 values.
    """
    score = (grid_bin(F.col("score")) / 100) if on_grid else F.col("score")
    rows = scores.select("judge", "cluster", score.alias("score"), "label").where(F.col("score").isNotNull())
    counted = rows.groupBy("judge", "cluster", "score").agg(
        F.count_if(F.col("label")).alias("pos"), F.count_if(~F.col("label")).alias("neg"), F.count(F.lit(1)).alias("n")
    )
    hist = materialize(counted, "audit")
    grid = hist.groupBy("judge", grid_bin(F.col("score")).alias("bin")).agg(F.sum("n").alias("n"))
    labelled = hist.where(F.col("pos") + F.col("neg") > 0).drop("n")
    return spread(grid, ["judge"]).join(
        auroc_with_interval(labelled, ["judge"], on_grid=on_grid, resamples=resamples, stored=True), "judge", "left"
    )
