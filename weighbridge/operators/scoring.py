"""Evaluation metrics of result records: grades, support, recall, bars, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weighbridge.functions.answers import judge_cost
from weighbridge.operators.grouped import sum_before
from weighbridge.operators.resample import bootstrap_sums, interval
from weighbridge.settings import ACCEPTANCE_BARS, RESAMPLES
from weighbridge.stages import materialize

LABELS = ("correct", "incorrect", "not_attempted")


def checked_label(label: Column) -> Column:
    """The label itself; anything but the three grades or NULL is an error."""
    return F.when(label.isNull() | label.isin(*LABELS), label).otherwise(
        F.raise_error(F.concat(F.lit("unknown label "), label))
    )


def _counted(records: DataFrame, by: list[str], label: str) -> DataFrame:
    grade = checked_label(F.col(label))
    return records.groupBy(*by).agg(
        F.count(grade).alias("n"),
        F.count_if(grade == "correct").alias("correct"),
        F.count_if(grade == "incorrect").alias("incorrect"),
        F.count_if(grade == "not_attempted").alias("not_attempted"),
        F.count_if(F.col(label).isNull()).alias("ungraded"),
    )


def rates() -> dict[str, Column]:
    """The three rates as functions of the summed counts."""
    attempted = F.col("correct") + F.col("incorrect")
    return {
        "truthfulness": F.try_divide(F.col("correct") - F.col("incorrect"), F.col("n")),
        "hallucination_rate": F.try_divide(F.col("incorrect"), attempted),
        "coverage": F.try_divide(attempted, F.col("n")),
    }


def _with_rates(counted: DataFrame) -> DataFrame:
    return counted.select(
        "*", (F.col("correct") + F.col("incorrect")).alias("attempted"), *[c.alias(n) for n, c in rates().items()]
    )


def answer_scores(records: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """Counts and rates per group; NULL labels are ungraded and only counted."""
    return _with_rates(_counted(records, by, label))


def answer_score_intervals(records: DataFrame, by: list[str], label: str = "label", cluster: str = "question_id",
                           resamples: int = RESAMPLES, digits: int | None = 4, drawn: DataFrame | None = None, position: str | None = None) -> DataFrame:
    """``answer_scores`` with bootstrap intervals over questions. Ungraded records
    are counted but not resampled. With published draws, a question's place is that
    of its first record by ``position``."""
    rows = records.withColumn("cluster", F.col(cluster))
    per = _counted(rows, [*by, "cluster"], label)
    if position is not None:
        first = rows.groupBy(*by, "cluster").agg(F.min(position).alias("_position"))
        per = per.join(first, [*by, "cluster"])
    per = materialize(per, "graded")
    totals = [F.sum(c).alias(c) for c in ("n", "correct", "incorrect", "not_attempted", "ungraded")]
    graded = per.where(F.col("n") > 0)
    reps = bootstrap_sums(graded, by, ["n", "correct", "incorrect"], rates(), resamples, drawn, position and "_position")
    return _with_rates(per.groupBy(*by).agg(*totals)).join(interval(reps, by, list(rates()), digits), by)


def claim_support(records: DataFrame, claims: DataFrame, by: list[str], resamples: int = RESAMPLES,
                  digits: int | None = 4) -> DataFrame:
    """Pooled share of supported claims, with an interval over all records.

    ``records(by, question_id)`` includes those without claims; ``claims(by,
    question_id, label)`` has one row per graded claim. Unreadable verdicts are
    counted and left out of the rate.
    """
    graded = claims.groupBy(*by, "question_id").agg(
        F.count_if(F.col("label") == "supported").alias("supported"),
        F.count_if(F.col("label") != "unreadable").alias("kept_claims"),
        F.count_if(F.col("label") == "unreadable").alias("unreadable"),
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("supported", "kept_claims", "unreadable")]
    joined = records.select(*by, "question_id").join(graded, [*by, "question_id"], "left")
    per = materialize(joined.select(*by, F.col("question_id").alias("cluster"), *zero), "support")
    rate = F.try_divide(F.col("supported"), F.col("kept_claims"))
    point = per.groupBy(*by).agg(
        F.sum("kept_claims").alias("kept_claims"),
        F.sum("supported").alias("supported"),
        F.sum("unreadable").alias("unreadable"),
        F.count(F.lit(1)).alias("n_questions"),
        F.count_if(F.col("kept_claims") > 0).alias("n_questions_with_claims"),
    )
    reps = bootstrap_sums(per, by, ["supported", "kept_claims"], {"rate": rate}, resamples=resamples)
    return point.withColumn("rate", rate).join(interval(reps, by, ["rate"], digits), by)


def attach_grades(records: DataFrame, grades: DataFrame, keys: tuple[str, ...] = ("arm", "question_id")) -> DataFrame:
    """Records with their grade. A record without grade, or a grade without record, is an error."""
    joined = records.withColumn("_r", F.lit(1)).join(grades.withColumn("_g", F.lit(1)), list(keys), "full_outer")
    bad = F.col("_r").isNull() | F.col("_g").isNull()
    return joined.where(
        F.when(bad, F.raise_error(F.lit("records and grades do not match"))).otherwise(F.lit(True))
    ).drop("_r", "_g")


def grade_metrics(records: DataFrame, by: list[str], resamples: int = RESAMPLES, claims: DataFrame | None = None) -> DataFrame:
    """Scores with intervals plus the fabricated-citation total; ungraded rows are
    counted and left out of the rates. With graded ``claims`` of a judged run also
    ``kept_claims, supported, support_rate`` and its interval."""
    fabricated = records.groupBy(*by).agg(
        F.sum(F.coalesce("fabricated_citations", F.lit(0))).alias("fabricated_citations_total")
    )
    scored = answer_score_intervals(records, by, resamples=resamples).join(fabricated, by)
    if claims is None:
        return scored
    support = claim_support(records, claims, by, resamples)
    rates_of = [F.col(c).alias(f"support_{c}") for c in ("rate", "rate_lo", "rate_hi")]
    return scored.join(support.select(*by, "kept_claims", "supported", *rates_of), by)


def acceptance(metrics: DataFrame, by: list[str], bars=ACCEPTANCE_BARS) -> DataFrame:
    """One row per bar: its value and whether it clears. ``metrics(by, metric,
    value)`` is long; an absent, NULL or NaN value never passes."""
    spark = metrics.sparkSession
    table = F.broadcast(spark.createDataFrame(list(bars), "bar string, metric string, rule string, threshold double"))
    groups = metrics.select(*by).distinct()
    rows = F.array(*[F.lit(metric) for _, metric, _, _ in bars])
    wanted = groups.withColumn("metric", F.explode(rows))
    value = F.when(~F.isnan("value"), F.col("value"))
    passed = F.when(F.col("rule") == "at least", value >= F.col("threshold")).otherwise(value <= F.col("threshold"))
    return (
        wanted.join(metrics.select(*by, "metric", "value"), [*by, "metric"], "left")
        .join(table, "metric")
        .select(*by, "bar", "rule", "threshold", value.alias("value"), F.coalesce(passed, F.lit(False)).alias("passed"))
    )


def pair_arms(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two arms on the same questions. ``(question_id, label, abstain_reason)`` each."""
    a = first.select("question_id", F.col("label").alias("first_label"), F.col("abstain_reason").alias("first_reason"))
    b = second.select("question_id", F.col("label").alias("second_label"))
    return a.join(b, "question_id")


def arm_contingency(pairs: DataFrame) -> DataFrame:
    """How one arm's outcome (or reason for declining) meets the other arm's grade."""
    state = F.when(F.col("first_label") == "not_attempted", F.coalesce("first_reason", F.lit("declined"))).otherwise("attempted")
    return pairs.groupBy(state.alias("first_outcome")).agg(
        *[F.count_if(F.col("second_label") == label).alias(f"second_{label}") for label in LABELS],
        F.count(F.lit(1)).alias("n"),
    )


def arm_difference(pairs: DataFrame, resamples: int = RESAMPLES) -> DataFrame:
    """Paired difference in truthfulness with a question-bootstrap interval."""

    def points(name: str) -> Column:
        return F.when(F.col(name) == "correct", 1).when(F.col(name) == "incorrect", -1).otherwise(0)

    per = pairs.select(
        F.lit(1).alias("_all"), F.col("question_id").alias("cluster"), F.lit(1).alias("n"),
        (points("first_label") - points("second_label")).alias("gain"),
    )
    stat = {"difference": F.try_divide(F.col("gain"), F.col("n"))}
    point = per.groupBy("_all").agg(F.sum("gain").alias("gain"), F.sum("n").alias("n")).select("_all", "n", stat["difference"].alias("difference"))
    reps = bootstrap_sums(per, ["_all"], ["gain", "n"], stat, resamples=resamples)
    return point.join(interval(reps, ["_all"], ["difference"]), "_all").drop("_all")


def usage_rollup(requests: DataFrame, by: list[str]) -> DataFrame:
    """Requests, cache hits, tokens and cost per stage and for every coarser level."""
    summed = requests.rollup(*by).agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.count_if("cached").alias("n_cached"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.grouping_id().cast("int").alias("level"),
    )
    return summed.withColumn("cost_usd", judge_cost(F.col("input_tokens")))


def usage_per_query(requests: DataFrame, by: list[str]) -> DataFrame:
    """Requests per question to one decimal place."""
    per_question = requests.groupBy(*by, "question_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("input_tokens").alias("_tokens")
    )
    return per_question.groupBy(*by).agg(
        F.sum("_n").alias("n_requests"),
        F.round(F.sum("_n") / F.count(F.lit(1)), 1).alias("per_query_requests"),
        judge_cost(F.sum("_tokens")).alias("cost_usd"),
    )


def reliability(hist: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Calibration table from a label histogram: mean score, observed share and gap per bin."""
    n = F.col("pos") + F.col("neg")
    slot = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return hist.groupBy(*by, slot.alias("bin")).agg(
        F.sum(n).alias("n"),
        F.try_divide(F.sum(F.col("score") * n), F.sum(n)).alias("mean_score"),
        F.try_divide(F.sum("pos"), F.sum(n)).alias("observed"),
    ).withColumn("gap", F.abs(F.col("mean_score") - F.col("observed")))


def calibration_error(table: DataFrame, by: list[str]) -> DataFrame:
    return table.groupBy(*by).agg(F.try_divide(F.sum(F.col("gap") * F.col("n")), F.sum("n")).alias("ece"))


def latency_quantiles(records: DataFrame, by: list[str], latency: str) -> DataFrame:
    """Median and 95th percentile, interpolated, from running counts of distinct
    latencies: each rank is looked up in the latency whose stretch of ranks holds it."""
    counted = records.where(F.col(latency).isNotNull()).groupBy(*by, latency).agg(F.count(F.lit(1)).alias("_n"))
    placed = sum_before(counted, by, [F.asc(latency)], "_n", "_lower")
    sizes = counted.groupBy(*by).agg(F.sum("_n").alias("n"))
    upto = F.col("_lower") + F.col("_n") - 1  # ranks from 0

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_lower") <= rank) & (rank <= upto), F.col(latency)))

    def quantile(q: float) -> Column:
        place = F.lit(q) * (F.col("n") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        return low + (high - low) * (F.max(place) - F.floor(F.max(place)))

    out = placed.join(sizes, by).groupBy(*by).agg(quantile(0.5).alias("p50"), quantile(0.95).alias("p95"), F.max("n").alias("n"))
    return out


def pass_delta(first: DataFrame, second: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Second pass against the first: ratio and difference of each metric."""
    a = first.select(*by, *[F.col(m).alias(f"_{m}") for m in metrics])
    joined = second.join(a, by)
    cells = [
        c
        for m in metrics
        for c in (
            F.try_divide(F.col(m), F.col(f"_{m}")).alias(f"{m}_ratio"),
            (F.col(m) - F.col(f"_{m}")).alias(f"{m}_delta"),
        )
    ]
    return joined.select(*by, *cells)
