"""Cluster bootstrap: all replicates in one job.

A cluster's weight in a replicate follows from its own key: 16 bits of
md5("replicate div 8 | cluster") through the Poisson(1) distribution. Weights need
no numbering of clusters, no join and no broadcast; tasks multiply them with what
they hold and shuffle sums of one value per replicate. Raw rows are never resampled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weighbridge.operators.auroc import auroc
from weighbridge.settings import RESAMPLE_SEED, RESAMPLES
from weighbridge.stages import materialize

# 65536 times the distribution function of Poisson(1), from 0 on.
POISSON_STEPS = np.array([24109, 48218, 60273, 64291, 65296, 65497, 65530, 65535])
PER_DIGEST = 8  # replicates that one digest serves
ROWS_AT_ONCE = 512
FEW_CLUSTERS = 64  # of a batch, below which pairs are counted by clusters
KEYS_AT_ONCE = 2_000  # sums a task holds before it hands them on


def poisson_weights(clusters: list, resamples: int = RESAMPLES) -> np.ndarray:
    """Weight of every cluster (rows) in every replicate (columns)."""
    blocks = -(-resamples // PER_DIGEST)
    digests = b"".join(
        hashlib.md5(f"{b}|{'' if c is None else c}".encode()).digest() for c in clusters for b in range(blocks)
    )
    bits = np.frombuffer(digests, ">u2").reshape(len(clusters), blocks * PER_DIGEST)[:, :resamples]
    return np.searchsorted(POISSON_STEPS, bits, side="right").astype(np.float64)


class _Weights:
    """Weights by cluster; a bounded number is remembered."""

    def __init__(self, resamples: int):
        self.resamples, self.known = resamples, {}

    def __call__(self, clusters: list) -> np.ndarray:
        new = [c for c in dict.fromkeys(clusters) if c not in self.known]
        if new:
            if len(self.known) > 4 * KEYS_AT_ONCE:
                self.known.clear()
                new = list(dict.fromkeys(clusters))
            self.known.update(zip(new, poisson_weights(new, self.resamples)))
        return np.stack([self.known[c] for c in clusters])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(k, ROWS_AT_ONCE)


def _even_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole batches of few clusters, others in slices, so that rows times weights stay small."""
    for batch in batches:
        few = pc.count_distinct(batch.column("_cluster")).as_py() <= FEW_CLUSTERS
        yield from (batch,) if few and batch.num_rows else _slices([batch])


def _totals(p: np.ndarray, n: np.ndarray, which: np.ndarray, w: np.ndarray, rows: slice) -> np.ndarray:
    """Positives and negatives of some rows in every replicate."""
    return np.stack([np.bincount(which[rows], x[rows], len(w)) @ w for x in (p, n)])


def _wins_inside(p: np.ndarray, n: np.ndarray, which: np.ndarray, w: np.ndarray, runs: list) -> np.ndarray:
    """Winning pairs in every replicate among rows that stand in the order of their scores; ``runs`` are the
    starts of equal scores and the end. ``which`` is a row's cluster, ``w`` the clusters' weights.

    With few clusters pairs are counted once by the clusters of both sides, and the weights
    multiply that small table; a row then costs as much as there are clusters, not replicates.
    """
    if len(runs) < 2:
        return np.zeros(w.shape[1])
    rows, starts, k = slice(runs[0], runs[-1]), np.array(runs[:-1]) - runs[0], len(w)
    if k > FEW_CLUSTERS:
        won, lost = (np.add.reduceat(x[rows, None] * w[which[rows]], starts, axis=0) for x in (p, n))
        return (won * (np.cumsum(lost, axis=0) - lost / 2)).sum(0)
    cell = np.repeat(np.arange(len(starts)), np.diff(runs)) * k + which[rows]
    won, lost = (np.bincount(cell, x[rows], len(starts) * k).reshape(-1, k) for x in (p, n))
    pairs = won.T @ (np.cumsum(lost, axis=0) - lost / 2)
    return ((pairs @ w) * w).sum(0)


def _spread_out(df: DataFrame, keys: list[str]) -> DataFrame:
    """Enough partitions before rows multiply; a fixed number, so that adaptive
    execution does not merge the still small partitions."""
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *keys)


def _as_text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias("_cluster")


def weighted_sums(rows: DataFrame, keys: list[str], sums: list[str], resamples: int = RESAMPLES) -> DataFrame:
    """``keys, replicate, sums``: sums of ``rows(keys, cluster, sums...)`` weighted by
    the cluster's weight in each replicate. A task emits one row per replicate and key."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    dealt = _spread_out(rows.select(*keys, _as_text("cluster"), *[F.col(s).cast("double").alias(s) for s in sums]), ["_cluster"])

    def out(held: dict, types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        for key, total in held.items():
            named = [pa.array([v] * resamples, t) for v, t in zip(key, types)]
            yield pa.RecordBatch.from_arrays(
                [*named, pa.array(np.arange(resamples, dtype=np.int32)), *map(pa.array, total)], names=[*keys, "replicate", *sums]
            )

    def run(batches):
        weights, held, types = _Weights(resamples), {}, []
        for batch in _slices(batches):
            types = [batch.schema.field(k).type for k in keys]
            columns = [batch.column(k).to_pylist() for k in keys]
            of = list(zip(*columns)) if keys else [()] * batch.num_rows
            w = weights(batch.column("_cluster").to_pylist())
            values = [batch.column(s).to_numpy(zero_copy_only=False) for s in sums]
            numbers = {key: i for i, key in enumerate(dict.fromkeys(of))}
            which = np.array([numbers[key] for key in of])
            for key, i in numbers.items():
                mine = np.flatnonzero(which == i)
                total = np.stack([v[mine] @ w[mine] for v in values])
                held[key] = held[key] + total if key in held else total
            if len(held) > KEYS_AT_ONCE:
                yield from out(held, types)
                held = {}
        yield from out(held, types)

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "replicate int", *(f"`{s}` double" for s in sums)])
    partial = dealt.mapInArrow(run, schema)
    return partial.groupBy(*keys, "replicate").agg(*[F.sum(s).alias(s) for s in sums])


def stream_draws(spark, n: int, resamples: int = RESAMPLES, seed: int = RESAMPLE_SEED) -> DataFrame:
    """``replicate, idx`` from numpy's default generator, to reproduce published
    intervals. A stream cannot be split, so every task replays it up to its own
    replicates and holds one replicate at a time."""

    def replay(batches):
        rng, at = np.random.default_rng(seed), 0
        for batch in batches:
            for mine in sorted(batch["id"].tolist()):
                while at <= mine:
                    drawn = rng.integers(0, n, size=n)
                    at += 1
                yield pd.DataFrame({"replicate": np.full(n, mine), "idx": drawn})

    return spark.range(resamples, numPartitions=spark.sparkContext.defaultParallelism).mapInPandas(
        replay, "replicate bigint, idx bigint"
    )


def interval(replicates: DataFrame, by: list[str], stats: list[str], digits: int | None = None) -> DataFrame:
    """95% percentile interval per statistic; undefined replicates are left out."""
    pieces = []
    for name in stats:
        bounds = F.percentile(F.col(name), F.array(F.lit(0.025), F.lit(0.975)))
        for suffix, i in (("lo", 0), ("hi", 1)):
            value = bounds[i]
            pieces.append((F.round(value, digits) if digits else value).alias(f"{name}_{suffix}"))
    return replicates.groupBy(*by).agg(*pieces)


def bootstrap_sums(
    per_cluster: DataFrame, by: list[str], sums: list[str], stats: dict[str, Column], resamples: int = RESAMPLES,
    drawn: DataFrame | None = None, position: str | None = None,
) -> DataFrame:
    """Replicates of statistics that are functions of cluster sums.

    ``per_cluster(by, cluster, sums...)`` has one row per cluster. ``drawn(by,
    replicate, idx)`` brings published draws instead of weights; their indexes are
    places in the order of ``position``, which then must be given.
    """
    if drawn is None:
        weighted = weighted_sums(per_cluster, by, sums, resamples)
    else:
        if position is None:
            raise ValueError("published draws refer to the order of records: give their position")
        place = F.row_number().over(W.partitionBy(*by).orderBy(position)) - 1
        placed = per_cluster.withColumn("idx", place.cast("bigint")).select(*by, "idx", *sums)
        weighted = drawn.join(placed, [*by, "idx"]).groupBy(*by, "replicate").agg(*[F.sum(s).alias(s) for s in sums])
    return weighted.select(*by, "replicate", *[c.alias(n) for n, c in stats.items()])


def bootstrap_auroc(
    cluster_hist: DataFrame, by: list[str], across: list[str] | None = None, score: str = "score",
    on_grid: bool = False, resamples: int = RESAMPLES,
) -> DataFrame:
    """AUROC per replicate from ``cluster_hist(by, across, cluster, score, pos, neg)``.

    ``across`` columns (judges to compare) share the weights of a cluster, as do all
    strata. On a grid, histograms are weighted and summed. Free scores are dealt by
    range: each stretch of scores yields its own winning pairs and class totals per
    replicate, and pairs across stretches follow from the totals of lower stretches.
    """
    keys = [*by, *(across or [])]
    if on_grid:
        weighted = weighted_sums(cluster_hist, [*keys, score], ["pos", "neg"], resamples)
        return auroc(weighted, [*keys, "replicate"], score, on_grid)
    kinds = {f.name: f.dataType.simpleString() for f in cluster_hist.schema.fields}
    doubles = [F.col(c).cast("double").alias(c) for c in ("pos", "neg")]
    rows = cluster_hist.select(*keys, score, _as_text("cluster"), *doubles)
    dealt = rows.repartitionByRange(*keys, score).sortWithinPartitions(*keys, score)

    def run(batches):
        part = TaskContext.get().partitionId()
        weights, types, key, last = _Weights(resamples), [], None, None
        wins = below = pos = tie = None

        def close() -> Iterator[pa.RecordBatch]:
            if key is not None:
                total = wins + tie[0] * (below + tie[1] / 2)
                named = [pa.array([v] * resamples, t) for v, t in zip(key, types)]
                numbers = pa.array(np.arange(resamples, dtype=np.int32))
                where = pa.array(np.full(resamples, part, np.int32))
                arrays = [*named, where, numbers, pa.array(total), pa.array(pos + tie[0]), pa.array(below + tie[1])]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "part", "replicate", "wins", "pos", "neg"])

        for batch in _even_slices(batches):
            types = [batch.schema.field(k).type for k in keys]
            of = list(zip(*[batch.column(k).to_pylist() for k in keys])) if keys else [()] * batch.num_rows
            at = batch.column(score).to_numpy(zero_copy_only=False)
            p, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("pos", "neg"))
            cluster = batch.column("_cluster").dictionary_encode()
            which, w = cluster.indices.to_numpy(), weights(cluster.dictionary.to_pylist())
            start = 0
            while start < len(of):
                end = start
                while end < len(of) and of[end] == of[start]:
                    end += 1
                if of[start] != key:
                    yield from close()
                    key, last = of[start], None
                    wins, below, pos = np.zeros(resamples), np.zeros(resamples), np.zeros(resamples)
                    tie = np.zeros((2, resamples))
                runs = [*(start + np.flatnonzero(np.r_[True, at[start + 1 : end] != at[start : end - 1]])), end]
                if last is not None and at[start] == last:
                    tie = tie + _totals(p, n, which, w, slice(start, runs[1]))
                    runs = runs[1:]
                if len(runs) > 1:  # the scores held back are complete
                    wins, below, pos = wins + tie[0] * (below + tie[1] / 2), below + tie[1], pos + tie[0]
                    done = slice(runs[0], runs[-2])
                    p_done, n_done = _totals(p, n, which, w, done)
                    wins = wins + p_done * below + _wins_inside(p, n, which, w, runs[:-1])
                    below, pos = below + n_done, pos + p_done
                    tie = _totals(p, n, which, w, slice(runs[-2], end))
                last, start = at[end - 1], end
        yield from close()

    named = [f"`{k}` {kinds[k]}" for k in keys]
    stretches = dealt.mapInArrow(run, ", ".join([*named, "part int, replicate int, wins double, pos double, neg double"]))
    earlier = W.partitionBy(*keys, "replicate").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    across_stretches = F.col("pos") * F.coalesce(F.sum("neg").over(earlier), F.lit(0.0))
    return stretches.withColumn("wins", F.col("wins") + across_stretches).groupBy(*keys, "replicate").agg(
        F.try_divide(F.sum("wins"), F.sum("pos") * F.sum("neg")).alias("auroc"),
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
    )


def auroc_with_interval(cluster_hist: DataFrame, by: list[str], score: str = "score", on_grid: bool = False,
                        resamples: int = RESAMPLES, stored: bool = False) -> DataFrame:
    """Point AUROC, class counts, cluster-bootstrap interval and cluster count.
    ``stored`` says the histogram is a written table already."""
    cluster_hist = cluster_hist if stored else materialize(cluster_hist, "histogram")
    overall = cluster_hist.groupBy(*by, score).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    reps = bootstrap_auroc(cluster_hist, by, None, score, on_grid, resamples)
    bounds = interval(reps.withColumnRenamed("auroc", "ci"), by, ["ci"])
    clusters = cluster_hist.select(*by, "cluster").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("clusters"))
    return auroc(overall, by, score, on_grid).join(bounds, by).join(clusters, by)


def paired_difference(cluster_hist: DataFrame, by: list[str], judge: str, first: str, second: str,
                      score: str = "score", on_grid: bool = False, resamples: int = RESAMPLES) -> DataFrame:
    """AUROC of two judges on the same items, their difference and its interval."""
    hist = materialize(cluster_hist.where(F.col(judge).isin(first, second)), "histogram")

    def side(df: DataFrame, keys: list[str]) -> DataFrame:
        return df.groupBy(*keys).agg(
            F.max(F.when(F.col(judge) == first, F.col("auroc"))).alias("auroc_first"),
            F.max(F.when(F.col(judge) == second, F.col("auroc"))).alias("auroc_second"),
        ).withColumn("difference", F.col("auroc_first") - F.col("auroc_second"))

    overall = hist.groupBy(*by, judge, score).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    point = side(auroc(overall, [*by, judge], score, on_grid), by)
    reps = side(bootstrap_auroc(hist, by, [judge], score, on_grid, resamples), [*by, "replicate"])
    return point.join(interval(reps, by, ["difference"]), by)


def bootstrap_statistic(
    summary: DataFrame, stat: Callable[[pd.DataFrame], float], by: list[str], value_columns: list[str],
    resamples: int = RESAMPLES,
) -> DataFrame:
    """Replicates of a user statistic.

    ``summary(by, cluster, value_columns..., weight)`` holds pre-aggregated rows
    (a histogram, say). Per replicate the weights are summed over equal values
    before the shuffle, so ``stat`` sees one row per distinct value with its weight.
    """
    weighted = weighted_sums(summary, [*by, *value_columns], ["weight"], resamples).where(F.col("weight") > 0)
    kinds = {f.name: f.dataType.simpleString() for f in weighted.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*by, "replicate"]) + ", value double"

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[[*by, "replicate"]].iloc[:1].copy()
        head["value"] = float(stat(pdf.sort_values(value_columns)))
        return head

    return weighted.groupBy(*by, "replicate").applyInPandas(apply, schema).withColumn("value", F.nanvl("value", F.lit(None)))
