"""Small helpers the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, IntegerType, StructField

from weighbridge.stages import materialize

WORD = r"[^\x20\x09-\x0D]+"  # a run of anything but ASCII white space


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id falls into that of the empty text."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


def renamed(docs: DataFrame, keep: list[str], **columns: Column) -> tuple[DataFrame, list[StructField]]:
    """The kept columns as c0, c1 and so on, before ``columns``, and the fields of the kept ones:
    no name of a table can clash with one that an operator uses inside."""
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)], *[c.alias(name) for name, c in columns.items()])
    return rows, rows.schema.fields[: len(keep)]


def named_back(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Kept columns under their own names again, before all others."""
    others = rows.columns[len(keep) :]
    return rows.toDF(*[f"c{k}" for k in range(len(keep))], *[f"n{k}" for k in range(len(others))]).select(
        *[F.col(f"c{k}").alias(c) for k, c in enumerate(keep)], *[F.col(f"n{k}").alias(c) for k, c in enumerate(others)]
    )


def fields(**kinds: DataType) -> list[StructField]:
    return [StructField(name, kind) for name, kind in kinds.items()]


JUDGED = [StructField("score", DoubleType()), StructField("predicted", IntegerType())]


def ordered_positions(df: DataFrame, group: list[str], order: list[Column], out: str, name: str) -> DataFrame:
    """1-based position of every row inside its group, in the given order, without
    a window over the group.

    Rows are dealt out by range, so each partition holds one stretch of the order;
    the written table keeps the place of a row in its stretch, and only counts per
    stretch and group are summed up. The number of those is bounded by partitions
    plus groups, however large a group is.
    """
    keys = [F.asc_nulls_last(g) for g in group]
    placed = materialize(
        df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id()),
        name,
    )
    stretch, at = F.shiftrightunsigned(F.col("_at"), 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    earlier = W.partitionBy(*group).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        placed.groupBy(*group, stretch.alias("_stretch"))
        .agg(F.min(at).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .select(*[F.col(g).alias(f"_g_{g}") for g in group], "_stretch", "_first", "_before")
    )
    rows = placed.withColumn("_of", stretch)
    same = F.col("_of") == F.col("_stretch")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return rows.join(starts, same).withColumn(out, F.col("_before") + at - F.col("_first") + 1).select(*df.columns, out)
