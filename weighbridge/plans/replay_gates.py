"""What another support threshold would have done to finished runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighbridge.operators.gates import (
    misaligned,
    proxy_ceiling,
    raise_gate_curve,
    rescue_set,
    stripped_reasons,
    zip_claims,
)
from weighbridge.operators.scoring import answer_scores


def claim_lists(records: DataFrame) -> DataFrame:
    """Records reduced to ``arm, question_id, claims<text,confidence>, labels``."""
    return records.select(
        "arm",
        "question_id",
        F.transform("claims", lambda c: F.struct(c["text"].alias("text"), c["support"]["confidence"].alias("confidence"))).alias("claims"),
        F.transform("claim_support", lambda g: g["label"]).alias("labels"),
    )


def stripped_rows(records: DataFrame) -> DataFrame:
    """One row per stripped sentence with its reason and confidence."""
    return records.select(
        "arm", "question_id", F.coalesce("abstained", F.lit(False)).alias("abstained"), "abstain_reason", F.explode("stripped").alias("s")
    ).select("arm", "question_id", "abstained", "abstain_reason", "s.sentence", "s.reason", F.col("s.support.confidence").alias("confidence"))


def replay_gates(judged: DataFrame, baseline: DataFrame) -> dict[str, DataFrame]:
    """All tables of the replay for ``judged`` records against a baseline arm's records."""
    lists = claim_lists(judged)
    graded = zip_claims(lists, ["arm", "question_id"])
    stripped = stripped_rows(judged)
    rescuable = rescue_set(stripped)
    base = answer_scores(judged.withColumn("label", F.col("grade.label")), ["arm"]).select("arm", "n", "correct", "incorrect")
    grades = baseline.select("question_id", F.col("grade.label").alias("label"))
    return {
        "misaligned": misaligned(lists, ["arm"]),
        "raise_gate_curve": raise_gate_curve(graded, ["arm"]),
        "stripped_reasons": stripped_reasons(stripped, ["arm"]),
        "rescuable": rescuable,
        "proxy_ceiling": proxy_ceiling(rescuable, grades, base, ["arm"]),
    }
