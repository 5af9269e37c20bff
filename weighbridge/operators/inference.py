"""Batch scoring with a cache table.

A scorer is any function from an iterator of pandas batches to an iterator of
pandas batches, run by ``mapInPandas``: it gets ``cache_key, model, state`` and
returns ``cache_key, model, answers, input_tokens, output_tokens, error``, with
``answers`` as JSON. Equal requests are sent once, cached ones not at all.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weighbridge.functions.answers import fallback_answer, parse_label, parse_letter, well_formed
from weighbridge.functions.text import strip
from weighbridge.stages import materialize

Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
SCORED = "cache_key string, model string, answers string, input_tokens bigint, output_tokens bigint, error string"
LOGGED = pa.schema([(n, pa.int64() if n.endswith("tokens") else pa.string()) for n in ("cache_key", "model", "answers", "input_tokens", "output_tokens", "error")])
LOGGED_ROWS = 64  # requests of a sub-batch
REPLIED = "cache_key string, model string, reply string, error string"


def _fresh(requests: DataFrame, cache: DataFrame, columns: list[str], scorer: Scorer, schema: str, parallelism: int | None) -> DataFrame:
    """Answers to requests the cache lacks. ``parallelism`` bounds concurrent calls."""
    unknown = requests.select(*columns).join(cache.select("cache_key"), "cache_key", "left_anti")
    misses = unknown.dropDuplicates(["cache_key"])
    spread = misses.repartition(parallelism) if parallelism else misses
    return spread.mapInPandas(scorer, schema)


def fallback_answers(bank: DataFrame) -> DataFrame:
    """The "do not know" answer set as one JSON map per stage.

    ``bank(stage, qid, type, options)`` is the question bank, a few rows.
    """
    entry = F.struct(F.col("qid").alias("key"), fallback_answer(F.col("type"), F.col("options")).alias("value"))
    return bank.groupBy("stage").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("answers"))


def new_entries(requests: DataFrame, cache: DataFrame, scorer: Scorer, fallback: str | None = None,
                parallelism: int | None = None) -> DataFrame:
    """Cache rows to append. A failed call becomes the ``fallback`` answer set, marked
    as such; without one it fails the job. Answers that do not parse into typed ones
    are a failed call: they are never cached as given."""
    scored = _fresh(requests, cache, ["cache_key", "model", "state"], scorer, SCORED, parallelism)
    failed = F.col("error").isNotNull() | ~well_formed(F.col("answers"))
    if fallback is None:
        message = F.concat(F.lit("judge request failed: "), F.coalesce("error", "answers", F.lit("no answers")))
        scored = scored.where(F.when(failed, F.raise_error(message)).otherwise(F.lit(True)))
    return scored.select(
        "cache_key",
        "model",
        F.when(failed, F.lit(fallback)).otherwise(F.col("answers")).alias("answers"),
        F.when(failed, 0).otherwise(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"),
        F.when(failed, 0).otherwise(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
        failed.alias("fallback"),
    )


def answer_from(requests: DataFrame, cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Every request row with its answers; ``cached`` tells where they came from."""
    known = cache.dropDuplicates(["cache_key"]).withColumn("cached", F.lit(True)).unionByName(fresh.withColumn("cached", F.lit(False)))
    return requests.drop("model").join(known, "cache_key", "left")


def score_table(requests: DataFrame, cache: DataFrame, scorer: Scorer, fallback: str | None = None,
                parallelism: int | None = None) -> DataFrame:
    """``requests(cache_key, model, state, ...)`` with answers, in one lazy plan.

    Fits a scorer that is cheap and deterministic. With a paid or random one use
    ``score_and_store``, which writes fresh answers before anything reads them.
    """
    return answer_from(requests, cache, new_entries(requests, cache, scorer, fallback, parallelism))


def with_log(scorer: Scorer, log: str, rows: int = LOGGED_ROWS) -> Scorer:
    """The scorer, asked for ``rows`` requests at a time, whose replies are logged before they go on.

    A task writes each sub-batch to ``log/part=<partition>/<attempt>-<number>.parquet``, under another
    name until it is whole. An attempt first takes what earlier ones of its partition have logged,
    so a task lost half-way repeats at most one sub-batch. Failed calls are not logged.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = pyarrow.fs.FileSystem.from_uri(log)
        task = TaskContext.get()
        folder = f"{base}/part={task.partitionId()}"
        files.create_dir(folder, recursive=True)
        whole = [f.path for f in files.get_file_info(pyarrow.fs.FileSelector(folder)) if f.path.endswith(".parquet")]
        known = pd.concat([pq.read_table(p, filesystem=files, partitioning=None).to_pandas() for p in whole]) if whole else None
        n = 0
        for batch in batches:
            for a in range(0, len(batch), rows):
                asked = batch.iloc[a : a + rows]
                if known is not None:
                    said = known["cache_key"].isin(asked["cache_key"])
                    if said.any():
                        yield known[said]
                        asked = asked[~asked["cache_key"].isin(known.loc[said, "cache_key"])]
                if asked.empty:
                    continue
                replies = pd.concat(list(scorer(iter([asked]))))
                fine = replies[replies["error"].isna()]
                if len(fine):
                    name = f"{folder}/{task.taskAttemptId()}-{n}"
                    pq.write_table(pa.Table.from_pandas(fine.assign(error=None), LOGGED, preserve_index=False), f"{name}.part", filesystem=files)
                    files.move(f"{name}.part", f"{name}.parquet")
                    n += 1
                yield replies

    return run


def _logged_before(spark: SparkSession, log: str) -> DataFrame:
    """Replies that earlier runs have logged; a reply may be in several files."""
    try:
        rows = spark.read.schema(SCORED).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(log)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], SCORED)
    return rows.dropDuplicates(["cache_key"])


def score_and_store(requests: DataFrame, cache_path: str, scorer: Scorer, fallback: str | None = None,
                    parallelism: int | None = None, log: str | None = None) -> DataFrame:
    """As ``score_table``, with fresh answers appended to the cache table first, so a
    lost executor never causes a second call for a stored answer.

    With ``log``, a folder every executor can write to, replies are also kept as they come: a lost
    task, or a run that failed, costs at most a sub-batch of calls a second time. What earlier
    runs have logged is filed first; the folder may be emptied once a run has ended.
    """
    spark = requests.sparkSession
    schema = "cache_key string, model string, answers string, input_tokens bigint, output_tokens bigint, fallback boolean"
    before = spark.read.schema(schema).parquet(cache_path)
    hit_keys = before.select("cache_key", F.lit(True).alias("cached")).distinct()
    marked = materialize(requests.select("cache_key").distinct().join(hit_keys, "cache_key", "left"), "hits")
    if log is not None:
        unfiled = _logged_before(spark, log).where(well_formed(F.col("answers"))).join(before.select("cache_key"), "cache_key", "left_anti")
        unfiled.drop("error").withColumn("fallback", F.lit(False)).write.mode("append").parquet(cache_path)
        spark.catalog.refreshByPath(cache_path)
        before = spark.read.schema(schema).parquet(cache_path)
        scorer = with_log(scorer, f"{log}/run-{uuid.uuid4().hex}")
        # written, so that an attempt meets the requests its partition had before
        requests_left = requests.select("cache_key", "model", "state").join(before.select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"])
        asked = materialize(requests_left, "requests")
    else:
        asked = requests
    new_entries(asked, before, scorer, fallback, parallelism).write.mode("append").parquet(cache_path)
    spark.catalog.refreshByPath(cache_path)
    after = spark.read.schema(schema).parquet(cache_path).dropDuplicates(["cache_key"])
    return requests.drop("model").join(after, "cache_key", "left").join(
        marked.withColumn("cached", F.coalesce("cached", F.lit(False))), "cache_key", "left"
    )


def _reply(requests: DataFrame, cache: DataFrame, grader: Scorer, parallelism: int | None) -> DataFrame:
    fresh = _fresh(requests, cache, ["cache_key", "model", "prompt"], grader, REPLIED, parallelism)
    known = cache.select("cache_key", "model", "reply", F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached"))
    return known.unionByName(fresh.withColumn("cached", F.lit(False)))


def grade_table(answers: DataFrame, cache: DataFrame, grader: Scorer, strict: bool = False,
                parallelism: int | None = None) -> DataFrame:
    """Three-way grades of ``answers(cache_key, model, prompt, answer, abstained, ...)``.

    An abstained or empty answer is not attempted and never sent. A failed call
    leaves the label NULL (ungraded), never ``not_attempted``.
    """
    empty = F.coalesce("abstained", F.lit(False)) | (strip(F.coalesce("answer", F.lit(""))) == "")
    skipped = answers.where(empty).select(
        "*", F.lit("").alias("reply"), F.lit("not_attempted").alias("label"), F.lit(False).alias("cached")
    )
    asked = answers.where(~empty)
    replies = _reply(asked, cache, grader, parallelism)
    graded = asked.drop("model").join(replies, "cache_key", "left")
    label = F.when(F.col("error").isNull() & F.col("reply").isNotNull(), parse_letter(F.col("reply"), strict))
    return graded.withColumn("label", label).select(skipped.columns).unionByName(skipped)


def claim_jobs(records: DataFrame) -> DataFrame:
    """Claims to grade: those of answered records that carry a support verdict."""
    live = records.where(~F.coalesce("abstained", F.lit(False)))
    rows = live.select("question_id", "query", "evidence_texts", F.posexplode("claims").alias("pos", "claim"))
    return rows.where(F.col("claim.support.choice").isNotNull())


def grade_claims(jobs: DataFrame, cache: DataFrame, grader: Scorer, parallelism: int | None = None) -> DataFrame:
    """Support labels of ``jobs(cache_key, model, prompt, ...)``; a failed call is unreadable."""
    replies = _reply(jobs, cache, grader, parallelism)
    reply = F.when(F.col("error").isNull(), F.col("reply"))
    return jobs.drop("model").join(replies, "cache_key", "left").withColumn("label", parse_label(reply))


def cacheable(graded: DataFrame, kind: str) -> DataFrame:
    """New replies worth storing: successful ones, and for claims only readable ones."""
    rows = graded.where(~F.col("cached") & F.col("reply").isNotNull() & (F.col("reply") != ""))
    if kind == "claim":
        rows = rows.where(F.col("label") != "unreadable")
    return rows.select("cache_key", "model", "reply").dropDuplicates(["cache_key"])


def column_scorer(rule: Callable[[pd.DataFrame], pd.DataFrame]) -> Scorer:
    """A scorer from a function over one pandas batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield rule(batch)

    return run


def usage_of(scored: DataFrame, stage: Column) -> DataFrame:
    """Request accounting rows of a scored table."""
    return scored.select("question_id", stage.alias("stage"), "cached", "input_tokens", "output_tokens")
