"""Exact top-k search by inner product: a Voronoi kNN join."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weighbridge.llm import blocks
from weighbridge.stages import materialize

PIVOTS = 64
BLOCK_QUERIES = 16_384
EXACT = 2.0**53


def whole_components(df: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """``vec_id, vec`` with floor(scale * x) for every component."""
    rows = df.where(blocks.usable(vector))
    return blocks.one_per_id(rows, key, F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double"))))


@dataclass
class Bounds:
    """Per query cell and data cell: nearest and farthest a row may be from its pivot."""

    least: np.ndarray
    most: np.ndarray


def _lifted(vectors: np.ndarray, norm: float, queries: bool) -> np.ndarray:
    """One more component, so that the largest inner product is the smallest distance:
    sqrt(norm^2 - |x|^2) for rows, zero for queries."""
    last = np.zeros(len(vectors)) if queries else np.sqrt(np.maximum(norm**2 - (vectors**2).sum(1), 0.0))
    return np.column_stack([vectors, last])


def _nearest(points: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    square = (points**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * points @ pivots.T
    cell = square.argmin(1)
    return cell, np.sqrt(((points - pivots[cell]) ** 2).sum(1))


def _assigned(df: DataFrame, pivots: np.ndarray, norm: float, queries: bool) -> DataFrame:
    """Every vector with its nearest pivot and the distance to it."""
    dims = pivots.shape[1] - 1

    def run(batches):
        for batch in batches:
            points = _lifted(blocks.matrix(batch.column(1), dims), norm, queries)
            cell, dist = _nearest(points, pivots)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array(dist, pa.float64())], names=["vec_id", "vec", "cell", "dist"]
            )

    return df.select("vec_id", "vec").mapInArrow(run, "vec_id long, vec array<long>, cell int, dist double")


def _bounds(pivots: np.ndarray, reach: np.ndarray, lists: dict[int, list[float]], k: int) -> Bounds:
    """Triangle inequality over summaries only. ``reach``: farthest query of each cell (-1: none);
    ``lists``: the k + 1 smallest pivot distances of each data cell."""
    between = np.sqrt(np.maximum(((pivots[:, None] - pivots[None]) ** 2).sum(-1), 0.0))
    slack = 1e-6 * (1.0 + between.max())
    least, most = np.zeros_like(between), np.full_like(between, np.inf)
    for i in np.flatnonzero(reach >= 0):
        upper = np.sort(np.concatenate([reach[i] + between[i, j] + np.array(d) for j, d in lists.items()]))
        if len(upper) > k:  # the k + 1 nearest surely lie within: one may be the query's own row
            least[i] = between[i] - reach[i] - upper[k] - slack
            most[i] = between[i] + reach[i] + upper[k] + slack
    return Bounds(least, most)


def _grouped(counts: dict[int, int], pivots: np.ndarray, most: int) -> list[list[int]]:
    """Query cells joined to near ones while a group holds at most ``most`` queries."""
    left, groups = set(counts), []
    while left:
        start = max(left, key=lambda c: (counts[c], -c))
        near = sorted(left, key=lambda c: (((pivots[c] - pivots[start]) ** 2).sum(), c))
        group, total = [], 0
        for c in near:
            if not group or total + counts[c] <= most:
                group.append(c)
                total += counts[c]
        left -= set(group)
        groups.append(group)
    return groups


def _solver(dims: int, k: int, largest: float, bounds: Bounds):
    exact = largest * largest * max(dims, 1) < EXACT
    lowest = -np.inf if exact else np.iinfo(np.int64).min

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = {"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())}
        if not len(left) or not len(right):
            return pa.table(empty)
        ids = right["vec_id"].to_numpy()
        data = blocks.matrix(right["vec"], dims)
        rows = blocks.by_id_without_copies(ids, data, k)
        ids, data = ids[rows], data[rows]
        cells, dist = right["cell"].to_numpy()[rows], right["dist"].to_numpy()[rows]
        own, queries, of = left["vec_id"].to_numpy(), blocks.matrix(left["vec"], dims), left["cell"].to_numpy()
        found = []
        for cell in np.unique(of):
            need = np.flatnonzero((dist >= bounds.least[cell, cells]) & (dist <= bounds.most[cell, cells]))
            if not len(need):
                continue
            members = np.flatnonzero(of == cell)
            step = max(1, blocks.CELLS // len(need))
            for a in range(0, len(members), step):
                part = members[a : a + step]
                if exact:
                    score = queries[part] @ data[need].T
                else:  # large whole numbers: 64-bit arithmetic, which wraps as a long does
                    score = queries[part].astype(np.int64) @ data[need].astype(np.int64).T
                at = np.minimum(np.searchsorted(ids[need], own[part]), len(need) - 1)
                self_row = ids[need][at] == own[part]
                score[np.flatnonzero(self_row), at[self_row]] = lowest
                q, r = blocks.best_rows(score, k, lowest=lowest)
                s = score[q, r]
                keep = blocks.cut(q, s, ids[need][r], k, True)
                found.append((own[part][q[keep]], ids[need][r[keep]], s[keep].astype(np.int64)))
        if not found:
            return pa.table(empty)
        return pa.table(dict(zip(empty, (pa.array(np.concatenate(x)) for x in zip(*found)))))

    return solve


def voronoi_top_k(vectors: DataFrame, is_query: Column, k: int, pivots: int = PIVOTS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The ``k`` rows of highest inner product for every query: ``query_id, rank, vec_id, score``.

    ``vectors(vec_id, vec)``, whole-number components, one row per id; ``is_query``
    selects queries by their id. A query is never its own result; ties go to
    smaller ids. Queries with fewer than k other rows get all; short vectors count
    as filled with zeros; an empty table gives an empty one.

    Rows are lifted by one component, which turns the largest inner product into
    the smallest distance. Rows and queries go to their nearest of ``pivots`` pivots
    (a bounded sample). From the smallest pivot distances of every data cell and the
    farthest query of every query cell follows, by the triangle inequality, which
    rows a query cell can need; only these are copied to the group of query cells.
    Groups hold at most ``block_queries`` queries and meet slices of rows, so no
    task holds more than a block and a slice, however many rows are alike.
    """
    spark = vectors.sparkSession
    size = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    facts = vectors.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dims"), F.max(F.sqrt(size)).alias("norm"),
        F.max(F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double"))))).alias("largest"),
    ).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not facts.n:
        return spark.createDataFrame([], schema)
    dims, norm = facts.dims, float(facts.norm or 0.0)
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    chosen = np.zeros((len(sample), dims))
    for i, row in enumerate(sample):
        chosen[i, : len(row.vec)] = row.vec
    points = np.unique(_lifted(chosen, norm, False), axis=0)
    data = materialize(_assigned(vectors, points, norm, False), "voronoi-rows")
    queries = materialize(_assigned(vectors.where(is_query), points, norm, True), "voronoi-queries")

    near = W.partitionBy("cell").orderBy("dist")
    lists: dict[int, list[float]] = {}
    for row in data.select("cell", "dist", F.row_number().over(near).alias("_i")).where(F.col("_i") <= k + 1).collect():
        lists.setdefault(row.cell, []).append(row.dist)
    reach, counts = np.full(len(points), -1.0), {}
    for row in queries.groupBy("cell").agg(F.max("dist").alias("far"), F.count(F.lit(1)).alias("n")).collect():
        reach[row.cell], counts[row.cell] = row.far, row.n
    if not counts:
        return spark.createDataFrame([], schema)
    bounds = _bounds(points, reach, lists, k)
    groups = _grouped(counts, points, block_queries)

    # what each group needs of each data cell: the union of what its query cells need
    needs, member = [], []
    number = 0
    for group in groups:
        parts = -(-sum(counts[c] for c in group) // block_queries)  # a cell of too many queries is split
        member += [(c, number, parts) for c in group]
        for j in lists:
            needs.append((j, float(bounds.least[group, j].min()), float(bounds.most[group, j].max()), number, parts))
        number += parts
    spread = blocks.slices(facts.n)
    need = F.broadcast(spark.createDataFrame(needs, "cell int, _least double, _most double, _group int, _parts int"))  # at most pivots^2 rows
    slot = F.explode(F.sequence(F.col("_group"), F.col("_group") + F.col("_parts") - 1)).alias("block")
    copies = data.join(need, "cell").where((F.col("dist") >= F.col("_least")) & (F.col("dist") <= F.col("_most"))).select(
        "vec_id", "vec", "cell", "dist", F.pmod(F.xxhash64("vec_id"), F.lit(spread)).cast("int").alias("slice"), slot
    )
    home = F.broadcast(spark.createDataFrame(member, "cell int, _group int, _parts int"))  # at most one row per pivot
    asked = queries.join(home, "cell").select(
        "vec_id", "vec", "cell", (F.col("_group") + F.pmod(F.xxhash64("vec_id"), F.col("_parts")).cast("int")).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("slice"),
    )
    solve = _solver(dims, k, float(facts.largest or 0.0), bounds)
    partials = (
        asked.groupBy("block", "slice").cogroup(copies.groupBy("block", "slice"))
        .applyInArrow(solve, "query_id long, vec_id long, score long")
    )
    return blocks.ranked(partials, k, True)
