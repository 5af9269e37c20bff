"""Readers with explicit schemas for scores, questions, records, caches and stores."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weighbridge import schemas
from weighbridge.functions.answers import truthy
from weighbridge.functions.ids import canonical_text, state_fingerprint
from weighbridge.functions.text import strip
from weighbridge.operators.grouped import first_rows
from weighbridge.settings import QUESTION_TABLE


def read_scores(spark: SparkSession, path: str, score: str = "score", label: str | None = None,
                judge: str | None = None, cluster: str | None = None) -> DataFrame:
    """``judge, cluster, score, label`` from a CSV with a header. No rows is an error."""
    raw = spark.read.csv(path, header=True, escape='"', multiLine=True)
    if not raw.take(1):
        raise ValueError(f"no rows in {path}")
    none = F.lit(None)
    return raw.select(
        (F.col(judge) if judge else F.lit("judge")).alias("judge"),
        (F.col(cluster) if cluster else none.cast("string")).alias("cluster"),
        F.col(score).cast("double").alias("score"),
        (truthy(F.col(label)) if label else none.cast("boolean")).alias("label"),
    )


def _with_row_index(raw: DataFrame) -> DataFrame:
    """Rows of multi-line CSV files numbered from 0 across files in name order.

    Such a file is read by one task, so row ids grow by one inside it; only one
    row per file is needed to place it among the others.
    """
    tagged = raw.select("*", F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_id"))
    per_file = tagged.groupBy("_file").agg(F.min("_id").alias("_start"), F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)
    placed = per_file.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return tagged.join(placed, "_file").withColumn(
        "row_index", F.col("_before") + F.col("_id") - F.col("_start")
    ).drop("_file", "_id", "_start", "_n", "_before")


@F.pandas_udf(T.StringType())
def _python_literal(values: pd.Series) -> pd.Series:
    """JSON of Python dict literals; NULL for anything else."""

    def convert(text):
        try:
            value = ast.literal_eval(text)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None
        if not isinstance(value, dict):
            return None
        return json.dumps({str(k): v if v is None or isinstance(v, str) else json.dumps(v, default=str) for k, v in value.items()})

    return values.map(convert, na_action="ignore")


def _literal_map(text: Column) -> Column:
    """A Python dict literal as ``map<string,string>``; ``{'raw': text}`` if it is not one."""
    parsed = F.from_json(text, "map<string,string>", {"allowSingleQuotes": "true", "mode": "PERMISSIVE"})
    parsed = F.coalesce(parsed, F.from_json(_python_literal(text), "map<string,string>"))
    raw = F.create_map(F.lit("raw"), text)
    empty = F.coalesce(strip(text), F.lit("")) == ""
    return F.when(empty, F.create_map().cast("map<string,string>")).otherwise(F.coalesce(parsed, raw))


def read_simple_questions(spark: SparkSession, path: str, prefix: str = "simpleqa") -> DataFrame:
    """Questions from a ``problem, answer, metadata`` CSV, numbered in file order."""
    head = spark.read.csv(path, header=True, multiLine=True, escape='"')
    raw = _with_row_index(head.select("metadata", "problem", "answer"))
    return raw.select(
        F.format_string(f"{prefix}-%04d", "row_index").alias("question_id"),
        strip(F.coalesce("problem", F.lit(""))).alias("query"),
        strip(F.coalesce("answer", F.lit(""))).alias("gold"),
        _literal_map(F.col("metadata")).alias("metadata"),
    )


def read_sheet_questions(spark: SparkSession, path: str, prefix: str = "freshqa") -> DataFrame:
    """Questions from a sheet export: everything up to the row that holds both
    ``question`` and ``fact_type`` is preamble; blank rows are skipped. No row has more
    cells than the line of most commas, which a pass over the lines finds."""
    width = 1 + (spark.read.text(path).agg(F.max(F.length("value") - F.length(F.translate("value", ",", "")))).first()[0] or 0)
    names = [f"c{i}" for i in range(width)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = _with_row_index(spark.read.csv(path, schema=schema, multiLine=True, escape='"'))
    cells = F.array(*names)
    found = (
        rows.where(F.array_contains(cells, "question") & F.array_contains(cells, "fact_type"))
        .orderBy("row_index").limit(1).collect()
    )
    if not found:
        raise ValueError("no header row with question and fact_type columns")
    header = found[0]
    at = {header[n]: n for n in reversed(names) if header[n]}

    def cell(name: str) -> Column:
        return strip(F.coalesce(F.col(at[name]), F.lit(""))) if name in at else F.lit("")

    golds = F.filter(F.array(*[cell(f"answer_{i}") for i in range(10)]), lambda g: g != "")
    meta = [p for name in ("split", "effective_year", "next_review", "num_hops", "fact_type", "source")
            for p in (F.lit(name), cell(name))]
    body = rows.where((F.col("row_index") > header["row_index"]) & F.exists(cells, lambda v: strip(v) != ""))
    return body.select(
        F.concat(F.lit(f"{prefix}-"), cell("id")).alias("question_id"),
        cell("question").alias("query"),
        F.coalesce(F.get(golds, 0), F.lit("")).alias("gold"),
        golds.alias("golds"),
        F.map_concat(
            F.create_map(*meta),
            F.create_map(F.lit("false_premise"), (F.upper(cell("false_premise")) == "TRUE").cast("string")),
        ).alias("metadata"),
        "row_index",
    )


def select_questions(questions: DataFrame, split: str | None = "TEST", fact_types: tuple[str, ...] | None = ("fast-changing",),
                     include_false_premise: bool = True) -> DataFrame:
    """The slice of a sheet an evaluation wants; ``None`` lifts a condition."""
    keep = F.lit(True)
    if split is not None:
        keep = keep & (F.col("metadata")["split"] == split)
    if fact_types is not None:
        keep = keep & F.col("metadata")["fact_type"].isin(*fact_types)
    if not include_false_premise:
        keep = keep & (F.col("metadata")["false_premise"] != "true")
    return questions.where(keep)


def seeded_sample(questions: DataFrame, n: int, seed: int, key: str = "question_id", position: str = "question_id") -> DataFrame:
    """``n`` questions by hash order, or all of them if there are fewer, in order of
    ``position``. The same seed and ids give the same sample on any cluster."""
    rank = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    return questions.withColumn("_h", rank).orderBy("_h", key).limit(n).drop("_h").orderBy(position)


def by_id(questions: DataFrame, wanted: DataFrame, key: str = "question_id") -> DataFrame:
    return questions.join(wanted.select(key), key, "left_semi")


def read_records(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Result records of one or more result files, with file name and position.
    ``multi_line=False`` reads files of one result object per line."""
    files = spark.read.schema(schemas.RESULTS_FILE).json(path, multiLine=multi_line)
    rows = files.select(
        F.col("arm").alias("file_arm"), "dataset", "snapshot", "manifest_updated_at",
        F.input_file_name().alias("file"), F.posexplode("records").alias("pos", "r"),
    )
    return rows.select("file_arm", "dataset", "snapshot", "manifest_updated_at", "file", "pos", "r.*")


def gold_by_query(records: DataFrame) -> DataFrame:
    """Gold answer per query over all result files; the last file and row win."""
    usable = records.where((F.coalesce("query", F.lit("")) != "") & (F.coalesce("gold", F.lit("")) != ""))
    return first_rows(usable, ["query"], [F.desc("file"), F.desc("pos")]).select("query", "gold")


def read_judge_cache(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Self-describing judge cache files, searched recursively. Unreadable files and
    entries without answers or request are left out; see ``skipped_cache_files``.
    ``multi_line=False`` reads a compacted cache with one entry per line."""
    raw = _cache_files(spark, path, multi_line)
    usable = raw.where(_usable_entry())
    state = F.col("request.state")
    return usable.select(
        F.coalesce("model", "request.model", F.lit("unknown")).alias("model"),
        "answers",
        F.coalesce("usage.input_tokens", F.lit(0)).alias("input_tokens"),
        F.coalesce("usage.output_tokens", F.lit(0)).alias("output_tokens"),
        F.coalesce("fallback", F.lit(False)).alias("fallback"),
        state.alias("state"),
        F.get_json_object(state, "$.query").alias("query"),
        F.get_json_object(state, "$.passage.text").alias("passage_text"),
        state_fingerprint(canonical_text(state, compact=False)).alias("state_id"),
        F.col("request.questions").alias("questions"),
        # by file, then by place in it
        F.format_string("%s#%016d#%012d", F.input_file_name(), F.col("_block"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("seq"),
    )


def _cache_files(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    return spark.read.schema(schemas.CACHE_FILE).json(
        path, multiLine=multi_line, recursiveFileLookup=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record"
    ).withColumn("_block", F.col("_metadata.file_block_start"))


def _usable_entry() -> Column:
    return F.col("_corrupt_record").isNull() & F.col("answers").isNotNull() & F.col("request").isNotNull()


def skipped_cache_files(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return _cache_files(spark, path, multi_line).select(F.col("_corrupt_record"), "answers", "request").where(~_usable_entry()).agg(
        F.count(F.lit(1)).alias("skipped")
    )


def read_triples(spark: SparkSession, path: str, question_id: str | None = None) -> DataFrame:
    """Judgment triples from JSON lines partitioned by family, NULL values left out."""
    rows = spark.read.schema(schemas.TRIPLE).json(path).where(F.col("value").isNotNull())
    return rows if question_id is None else rows.where(F.col("question_id") == question_id)


def read_worklist(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.WORKLIST).json(path)


def read_manifest(spark: SparkSession, path: str, multi_line: bool = True) -> dict[str, DataFrame]:
    """Snapshot manifest as ``questions``, ``results``, ``pages`` and ``chunks`` tables.
    A path without manifest is an error."""
    entry = spark.read.schema(schemas.MANIFEST).json(path, multiLine=multi_line).select(
        "snapshot_id", F.col("updated_at").alias("manifest_stamp"), F.explode("questions").alias("q")
    )
    results = entry.select("q.question_id", F.explode("q.results").alias("r")).select("question_id", "r.*")
    pages = entry.select("q.question_id", F.explode("q.pages").alias("p")).select("question_id", "p.*")
    chunks = pages.select("question_id", "rank", "url", F.explode("chunks").alias("c")).select("question_id", "rank", "url", "c.*")
    questions = entry.select(
        "snapshot_id", "manifest_stamp", "q.question_id", "q.query", "q.category", "q.time_range",
        "q.n_results", "q.n_fetched_ok", "q.n_chunks", "q.n_chunks_new",
    )
    return {"questions": questions, "results": results, "pages": pages.drop("chunks"), "chunks": chunks}


def read_drawers(spark: SparkSession, path: str) -> DataFrame:
    """The passage store, without empty documents."""
    return spark.read.schema(schemas.DRAWERS).parquet(path).where(F.coalesce("text", F.lit("")) != "")


def question_bank(spark: SparkSession, spec_path: str | None = None) -> DataFrame:
    """``stage, qid, type, options, instructions, criteria``: the built-in ids and
    options, or a specification file with the full texts."""
    if spec_path is None:
        rows = [(stage, qid, kind, list(options), None, None) for stage, qid, kind, options in QUESTION_TABLE]
    else:
        text = "\n".join(r.value for r in spark.read.text(spec_path).collect())  # one settings file
        rows = []
        for stage, block in json.loads(text)["stages"].items():
            for group in ("questions", "claim_questions", "answer_questions"):
                for qid, q in block.get(group, {}).items():
                    criteria = q.get("criteria") or {}
                    options = [str(o) for o in criteria]
                    rows.append((stage.split("_")[0].lower(), qid, q["type"], options, json.dumps(q["instructions"]), json.dumps(criteria)))
    return spark.createDataFrame(
        rows, "stage string, qid string, type string, options array<string>, instructions string, criteria string"
    )
