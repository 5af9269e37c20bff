"""The memory track: a judged pass leaves drawers in the store, the next one reads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weighbridge.operators.store import injection_marks
from weighbridge.operators.vector import memory_lane, precheck
from weighbridge.operators.versions import VersionedStore
from weighbridge.plans.arms import Memory, judged_arm
from weighbridge.settings import LIMITS, Limits


def verified_drawers(writes: DataFrame) -> DataFrame:
    """Admitted claims (``memory_writes`` of a judged run) as drawers to file."""
    pairs = [(c, F.col(c).cast("string")) for c in ("support_prob", "support_choice", "judge_model", "evidence_drawer_ids", "question_id", "arm")]
    meta = F.map_filter(F.create_map(*[p for name, value in pairs for p in (F.lit(name), value)]), lambda k, v: v.isNotNull())
    return writes.where("admitted").select(
        "drawer_id", "wing", "room", "text", "source_file", F.lit(0).alias("chunk_index"), "authored_at", F.col("authored_at").alias("filed_at"), meta.alias("meta")
    )


def file_run(store: VersionedStore, run: dict[str, DataFrame], filed_at: str, stamp: str = "") -> int:
    """What a judged run leaves, as the store's next version: verified claims, injected chunks in
    quarantine, marks on recalled drawers that tripped the gate. The number of the version."""
    verified = verified_drawers(run["memory_writes"])
    injected = run["quarantine"].withColumn("filed_at", F.lit(filed_at)).withColumn("authored_at", F.lit(filed_at))
    arrivals = verified.unionByName(injected, allowMissingColumns=True)
    marks = None if run["gated_memory"] is None else injection_marks(run["gated_memory"], F.lit(filed_at))
    return store.commit(arrivals, [F.asc_nulls_last("authored_at"), F.asc("text")], marks, stamp)


def recall_from(drawers: DataFrame, embed: Column, embed_query: Column, limits: Limits = LIMITS) -> Memory:
    """The recall lane over drawers as of some version. ``embed`` makes a drawer's vector from its columns,
    ``embed_query`` a question's; a model would go here."""
    searched = drawers.withColumn("embedding", embed)

    def memory(queries: DataFrame) -> DataFrame:
        asked = queries.select("question_id", embed_query.alias("embedding"))
        hits = memory_lane(asked, searched.select("drawer_id", "wing", "embedding"), limits.palace_top_k, limits.palace_max_distance)
        facts = drawers.select("drawer_id", "room", "text", "authored_at")
        return hits.select("question_id", "cite_id", "drawer_id", "wing", "similarity").join(facts, "drawer_id")

    return memory


def memory_pass(questions: DataFrame, store: VersionedStore, embed: Column, embed_query: Column, limits: Limits = LIMITS, at: int | None = None, **arm) -> dict[str, DataFrame]:
    """A judged run that recalls from the store as of a version, by default the last one.

    ``arm`` has the other inputs of ``judged_arm``. Whether the store holds verified hits for a
    question is looked up first; intake needs to know.
    """
    drawers = store.read(questions.sparkSession, at)
    asked = questions.select("question_id", embed_query.alias("embedding"))
    verified = precheck(asked, drawers.withColumn("embedding", embed).select("drawer_id", "wing", "embedding"))
    known = questions.drop("has_verified_hits").join(verified, "question_id")
    run = judged_arm(known, memory=recall_from(drawers, embed, embed_query, limits), limits=limits, **arm)
    return run | {"questions": known}
