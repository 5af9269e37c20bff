"""Threshold replay over verified claims, without one pass per threshold.

A row is placed by how many thresholds it passes; a reverse running sum over the
handful of places gives every threshold's total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


RAISE_STEPS = [step / 100 for step in range(80, 101, 2)]
LOWER_STEPS = [step / 100 for step in range(0, 81, 5)]


def _passed(confidence: Column, thresholds: list[float]) -> Column:
    """How many of the ascending thresholds a value reaches."""
    return F.size(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: confidence >= t))


def threshold_sweep(rows: DataFrame, by: list[str], confidence: str, thresholds: list[float], measures: dict[str, Column]) -> DataFrame:
    """``by, threshold, measures``: each measure summed over rows at or above every
    threshold. Thresholds must ascend; those no row reaches give zeros."""
    placed = rows.groupBy(*by, _passed(F.col(confidence), thresholds).alias("_place")).agg(
        *[F.sum(c).alias(n) for n, c in measures.items()]
    )
    grid = F.array(*[F.struct(F.lit(i + 1).alias("_place"), F.lit(t).alias("threshold")) for i, t in enumerate(thresholds)])
    steps = placed.select(*by).distinct().select(*by, F.explode(grid).alias("_g")).select(*by, "_g._place", "_g.threshold")
    down = W.partitionBy(*by).orderBy(F.desc("_place")).rowsBetween(W.unboundedPreceding, 0)
    return steps.join(placed, [*by, "_place"], "left").select(
        *by, "threshold", *[F.coalesce(F.sum(n).over(down), F.lit(0)).alias(n) for n in measures]
    )


def zip_claims(records: DataFrame, keys: list[str]) -> DataFrame:
    """Graded claims by position. Records whose lists differ in length are skipped.

    ``records(keys, claims array<struct<text,confidence>>, labels array<string>)``.
    """
    aligned = records.where(F.size("claims") == F.size("labels"))
    pairs = aligned.select(*keys, F.posexplode(F.arrays_zip("claims", "labels")).alias("pos", "z"))
    return pairs.select(
        *keys, "pos", F.col("z.claims.confidence").alias("confidence"), F.col("z.labels").alias("label")
    ).where(F.col("label").isin("supported", "unsupported") & F.col("confidence").isNotNull())


def misaligned(records: DataFrame, by: list[str]) -> DataFrame:
    return records.groupBy(*by).agg(F.count_if(F.size("claims") != F.size("labels")).alias("misaligned"))


def raise_gate_curve(graded: DataFrame, by: list[str], thresholds: list[float] = RAISE_STEPS) -> DataFrame:
    """Kept and unsupported claims, coverage and error rate per raised threshold."""
    swept = threshold_sweep(
        graded, by, "confidence", thresholds,
        {"kept": F.lit(1), "unsupported": F.when(F.col("label") == "unsupported", 1).otherwise(0)},
    )
    total = graded.groupBy(*by).agg(F.count(F.lit(1)).alias("_total"))
    return swept.join(total, by).select(
        *by, "threshold", "kept", "unsupported",
        (F.col("kept") / F.col("_total")).alias("coverage"),
        F.try_divide("unsupported", "kept").alias("error_rate"),
    )


def rescue_set(stripped: DataFrame, reason: str = "supported_low_confidence") -> DataFrame:
    """Stripped claims a lower threshold alone would bring back."""
    return stripped.where((F.col("reason") == reason) & F.col("confidence").isNotNull())


def stripped_reasons(stripped: DataFrame, by: list[str]) -> DataFrame:
    return stripped.groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n"))


def proxy_ceiling(rescuable: DataFrame, baseline: DataFrame, base: DataFrame, by: list[str],
                  thresholds: list[float] = LOWER_STEPS) -> DataFrame:
    """Upper bound on truthfulness if the support threshold were lowered.

    ``rescuable(by, question_id, confidence, abstained)``, ``baseline(question_id,
    label)`` grades of the comparison arm, ``base(by, n, correct, incorrect)``
    the arm's own totals. A question comes back at its most confident claim, so
    distinct questions need no distinct count per threshold.
    """
    claims = threshold_sweep(rescuable, by, "confidence", thresholds, {"claims": F.lit(1)})
    best = (
        rescuable.where("abstained")
        .groupBy(*by, "question_id")
        .agg(F.max("confidence").alias("confidence"))
        .join(baseline.select("question_id", "label"), "question_id", "left")
    )
    flags = {
        "questions": F.lit(1),
        "baseline_right": F.when(F.col("label") == "correct", 1).otherwise(0),
        "baseline_wrong": F.when(F.col("label") == "incorrect", 1).otherwise(0),
    }
    questions = threshold_sweep(best, by, "confidence", thresholds, flags)
    zero = [F.coalesce(n, F.lit(0)).alias(n) for n in flags]
    joined = claims.join(questions, [*by, "threshold"], "left").join(base, by)
    right, wrong = F.coalesce("baseline_right", F.lit(0)), F.coalesce("baseline_wrong", F.lit(0))
    score = F.try_divide((F.col("correct") + right) - (F.col("incorrect") + wrong), F.col("n"))
    return joined.select(*by, "threshold", "claims", *zero, F.round(score, 4).alias("ceiling"))


def selective_risk(graded: DataFrame, by: list[str], steps: int = 20) -> DataFrame:
    """Share answered and error among the answered, per confidence threshold."""
    thresholds = [i / steps for i in range(steps + 1)]
    swept = threshold_sweep(graded, by, "confidence", thresholds, {"answered": F.lit(1), "wrong": F.when(F.col("label") == "incorrect", 1).otherwise(0)})
    total = graded.groupBy(*by).agg(F.count(F.lit(1)).alias("_total"))
    return swept.join(total, by).select(
        *by, "threshold", (F.col("answered") / F.col("_total")).alias("coverage"), F.try_divide("wrong", "answered").alias("risk")
    )


def within_buckets(pairs: DataFrame, by: list[str], bucket: str, buckets: tuple[int, ...] = (100, 50, 0),
                   min_per_class: int = 20) -> DataFrame:
    """Size, positive share and readiness of each bucket of a coarse judge."""
    counted = pairs.where(F.col(bucket).isin(*buckets)).groupBy(*by, bucket).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("label").alias("positives"), F.count_if(~F.col("label")).alias("negatives")
    )
    return counted.select(
        "*", F.try_divide("positives", "n").alias("positive_share"),
        (F.least("positives", "negatives") < min_per_class).alias("too_small"),
    )
