"""From raw documents to encoded training text, one written stage after the other."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weighbridge.llm import secret_scan, toxicity
from weighbridge.llm.bpe import bpe_digests
from weighbridge.llm.common import fold, table
from weighbridge.llm.mixing import mix, repeat
from weighbridge.llm.ngram_join import jaccard_join, numbered
from weighbridge.llm.queries import BYTE_BPE
from weighbridge.stages import stage_dir


def _packed(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns beside ``_doc``, which holds all columns: no name can clash with a stage's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the machine does not hold to be toxic."""
    machine = toxicity.learn(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    scored = toxicity.score_texts(_packed(docs), machine, ["_doc"], text="_doc.text")
    return scored.where(F.col("predicted") == 0).select("_doc.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates."""
    rows = numbered(_packed(docs), ["_doc"])
    joined = jaccard_join(rows.select("_row", "_doc.doc_id", "_doc.text"))
    return rows.join(joined.where("is_first"), "_row", "left_semi").select("_doc.*")


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    # equal texts hold equal secrets, so the text's digest is key enough
    rows = _packed(docs, "text").withColumn("_key", F.md5(F.coalesce("text", F.lit(""))))
    found = secret_scan.scan(rows.select("_key", "text", "_doc.source"), ["_key"], path="source")
    done = secret_scan.redact(rows, found, "_key")
    return done.select(*[F.col("text") if c == "text" else F.col(f"_doc.`{c}`") for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of the sources takes them."""
    return repeat(mix(_packed(docs, "doc_id", "source", "text"), keep=["_doc"]), ["_doc"]).select("_doc.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of everything the mix holds."""
    return bpe_digests(docs, BYTE_BPE, ["doc_id"])


STAGES = [
    ("toxicity", clean),
    ("near_duplicates", distinct),
    ("secrets", redacted),
    ("mixing", mixed),
    ("encoding", encoded),
]

ORACLE_SQL = None  # a factorization machine and a forest decide; SQL cannot express them


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result is written and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{stage_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        result = stage(spark, docs, sf_dir)
        result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
    return docs
