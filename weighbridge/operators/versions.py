"""The passage store in versions, and entry tables whose buckets are replaced.

A store is a folder of append-only versions. Each attempt at version n writes folders of its
own, ``drawers/snapshot=n/attempt=a``, laid out by wing and id bucket, ``marks/...`` (what the
version says about drawers' metadata), ``filters/...`` (which ids the store may hold) and, last,
``commits/snapshot=n``, which names the attempt: what no commit names is not read. Reading as
of a version prunes to the attempts that made it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weighbridge import schemas
from weighbridge.operators.grouped import first_rows
from weighbridge.operators.store import filed_text, replace_below
from weighbridge.stages import materialize

STORED = f"{schemas.DRAWERS}, snapshot int, attempt string, bucket int"
COMMITS = "attempt string, stamp string, n_drawers bigint, n_marks bigint, snapshot int"
MARKS = "drawer_id string, mark map<string,string>, snapshot int, attempt string"
PROBES = 4  # bits of an id in its bucket's filter


@dataclass(frozen=True)
class VersionedStore:
    """``buckets`` and ``bits`` (of a bucket's filter, a multiple of 64) are fixed when the first version is
    written. All filters together are ``buckets * bits / 8`` bytes, 8 MB as given: that is what a
    look-up sends to every task. A store of more ids than bits reads more buckets, and misses none."""

    path: str
    buckets: int = 64
    bits: int = 1 << 20

    def _read(self, spark: SparkSession, part: str, schema: str) -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(f"{self.path}/{part}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    def commits(self, spark: SparkSession) -> DataFrame:
        """``snapshot, attempt, stamp, n_drawers, n_marks`` of every version. Should two writers have
        committed one version at the same moment, the attempt that sorts first is it."""
        found = self._read(spark, "commits", COMMITS)
        return first_rows(found, ["snapshot"], [F.asc("attempt")])

    def _attempts(self, spark: SparkSession, at: int) -> list[str]:
        """The attempts that made the versions up to one: a name per version."""
        return [r.attempt for r in self.commits(spark).where(F.col("snapshot") <= at).select("attempt").collect()]

    def latest(self, spark: SparkSession) -> int:
        """Number of the last version, 0 for a store without any."""
        return self.commits(spark).agg(F.max("snapshot")).first()[0] or 0

    def read(self, spark: SparkSession, at: int | None = None) -> DataFrame:
        """Drawers as of a version (the last one unless given), with ``snapshot`` of their filing.

        A drawer's metadata is that of its filing, then the latest mark up to the version."""
        at = self.latest(spark) if at is None else at
        made = F.col("attempt").isin(self._attempts(spark, at))
        drawers = self._read(spark, "drawers", STORED).where(made)
        marks = self._read(spark, "marks", MARKS).where(made)
        last = marks.groupBy("drawer_id").agg(F.max(F.struct("snapshot", F.map_entries("mark").alias("mark")))["mark"].alias("_mark"))
        new = F.map_from_entries("_mark")
        old = F.map_filter(F.coalesce("meta", F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys(new), k))
        marked = drawers.join(last, "drawer_id", "left")
        return marked.withColumn("meta", F.when(F.col("_mark").isNotNull(), F.map_concat(old, new)).otherwise(F.col("meta"))).drop("_mark", "bucket", "attempt")

    def _bucket(self, key: str = "drawer_id") -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _places(self, key: str = "drawer_id") -> Column:
        return F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), F.lit(self.bits)).cast("int") for i in range(1, PROBES + 1)])

    def _filters(self, spark: SparkSession, at: int) -> DataFrame:
        """``bucket, word, mask``: the words of 64 bits that hold a set one."""
        made = self.commits(spark).where(F.col("snapshot") == at).select("attempt").collect()
        every = self._read(spark, "filters", "bucket int, word int, mask bigint, snapshot int, attempt string")
        return every.where(F.col("attempt").isin([r.attempt for r in made])).drop("snapshot", "attempt")

    def fresh(self, arrivals: DataFrame, order: list[Column], at: int | None = None) -> DataFrame:
        """Rows to file: the first arrival of every id the store does not hold as of a version.

        Ids a filter rules out are new without a look at the store. For the others only
        the buckets they fall into are read; if there are none, nothing is.
        """
        spark = arrivals.sparkSession
        at = self.latest(spark) if at is None else at
        unique = first_rows(filed_text(arrivals), ["drawer_id"], order).withColumn("bucket", self._bucket())
        if not at:
            return unique
        held = np.zeros((self.buckets, self.bits // 64), np.int64)
        sent = self._filters(spark, at).toArrow()  # at most buckets * bits / 64 rows
        held[sent["bucket"].to_numpy(), sent["word"].to_numpy()] = sent["mask"].to_numpy()
        shared = spark.sparkContext.broadcast(held)

        @F.pandas_udf("boolean")
        def maybe(bucket: pd.Series, places: pd.Series) -> pd.Series:
            if bucket.empty:
                return pd.Series([], dtype=bool)
            at = np.stack(places.to_numpy()).astype(np.int64)
            words = shared.value[bucket.to_numpy()[:, None], at // 64]
            return pd.Series(((words >> (at % 64)) & 1).all(axis=1), index=bucket.index)

        tested = materialize(unique.withColumn("_maybe", maybe("bucket", self._places())), "arrivals")
        doubted = [r.bucket for r in tested.where("_maybe").select("bucket").distinct().collect()]  # at most ``buckets``
        new = tested.where("not _maybe")
        if doubted:
            stored = self._read(spark, "drawers", STORED).where(F.col("attempt").isin(self._attempts(spark, at)) & F.col("bucket").isin(doubted))
            new = new.unionByName(tested.where("_maybe").join(stored.select("drawer_id"), "drawer_id", "left_anti"))
        return new.drop("_maybe")

    def commit(self, arrivals: DataFrame, order: list[Column], marks: DataFrame | None = None, stamp: str = "") -> int:
        """Files arrivals the store lacks, and ``marks(drawer_id, mark)``, as the next version; its number.

        A non-empty ``stamp`` is filed once: the version that has it is returned instead. Of two
        writers of one version one fails, and nothing of it is read.
        """
        spark = arrivals.sparkSession
        done = self.commits(spark).where((F.col("stamp") == stamp) & (F.col("stamp") != "")).agg(F.min("snapshot")).first()[0]
        if done is not None:
            return done
        before = self.latest(spark)
        version, attempt = before + 1, uuid.uuid4().hex
        folder = f"snapshot={version}/attempt={attempt}"
        known = [f.name for f in spark.createDataFrame([], schemas.DRAWERS).schema.fields]
        rows = self.fresh(arrivals, order, before)
        lacking = {c: F.lit(None).cast(f.dataType) for f in spark.createDataFrame([], schemas.DRAWERS).schema.fields if (c := f.name) not in rows.columns}
        rows = rows.withColumns(lacking) if lacking else rows
        rows.select(*known, "bucket").write.partitionBy("wing", "bucket").parquet(f"{self.path}/drawers/{folder}")
        written = self._read(spark, "drawers", STORED).where(F.col("attempt") == attempt)
        place = F.explode(self._places())
        bits = written.select("bucket", place.alias("_p")).select("bucket", F.shiftright("_p", 6).alias("word"), F.expr("shiftleft(1L, _p & 63)").alias("mask"))
        every = bits.unionByName(self._filters(spark, before)).groupBy("bucket", "word").agg(F.bit_or("mask").alias("mask"))
        every.write.parquet(f"{self.path}/filters/{folder}")
        n_marks = 0
        if marks is not None:
            marks.select("drawer_id", "mark").write.parquet(f"{self.path}/marks/{folder}")
            n_marks = self._read(spark, "marks", MARKS).where(F.col("attempt") == attempt).count()
        head = spark.createDataFrame([(attempt, stamp, written.count(), n_marks)], "attempt string, stamp string, n_drawers bigint, n_marks bigint")
        head.coalesce(1).write.mode("error").parquet(f"{self.path}/commits/snapshot={version}")
        if attempt not in self._attempts(spark, version):
            raise RuntimeError(f"another writer has filed version {version}")
        return version


@dataclass(frozen=True)
class EntryTable:
    """Entries of questions, laid out in buckets of the question so that some can be replaced."""

    path: str
    key: str = "question_id"
    buckets: int = 64

    def _placed(self, entries: DataFrame) -> DataFrame:
        return entries.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def write(self, entries: DataFrame) -> None:
        self._placed(entries).write.mode("overwrite").partitionBy("bucket").parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).drop("bucket")

    def redo_below(self, redone: DataFrame, at_least: int) -> list[int]:
        """Entries with fewer than ``at_least`` results give way to their redone version, in place.

        Only buckets that hold such an entry are read again, written aside and then put in
        place of the old ones by one job, which replaces just those partitions when it commits: a job
        that fails leaves the table as it was, and a repeated one finds nothing to do or does the same.
        Returns the buckets replaced.
        """
        spark = redone.sparkSession
        entries = spark.read.parquet(self.path)
        weak = entries.where(F.col("n_results") < at_least).select(self.key, "bucket")
        changed = [r.bucket for r in weak.join(redone, self.key, "left_semi").select("bucket").distinct().collect()]  # at most ``buckets``
        if not changed:
            return []
        old = entries.where(F.col("bucket").isin(changed)).drop("bucket")
        new = materialize(self._placed(replace_below(old, redone, at_least, self.key)), "redone-buckets")
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        spark.catalog.refreshByPath(self.path)
        return sorted(changed)
