"""Exact cosine search over the passage store.

Scores are never emitted pair by pair: a numpy block product inside a task is
cut to the best rows per query at once. ``search`` groups vectors around pivots and
leaves out the groups that cannot hold a result of a query; ``search_within`` is an equi
join for one query per group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from weighbridge.functions.ids import memory_cite_id
from weighbridge.operators.grouped import top_rows
from weighbridge.settings import EVIDENCE, LIMITS, VERIFIED
from weighbridge.stages import materialize

CELL_QUERIES = CELL_VECTORS = 65_536  # rows of one side of a task at most ...
SIDE_BYTES = 32 << 20  # ... and their bytes: of 1,024 dimensions 4,096 rows
PENDING = 2_000_000  # results of a task before they are cut to the best of each query
PER_CELL, MOST_CELLS = 512, 1_024  # vectors for a pivot at least; pivots at most (8 MB with 1,024 dimensions)
SCORES_AT_ONCE = 4_000_000  # 32 MB; a cell stays below 256 MB with its copies

HIT = "question_id string, drawer_id string, similarity double"
NO_HITS = pd.DataFrame({"question_id": pd.Series(dtype=object), "drawer_id": pd.Series(dtype=object), "similarity": pd.Series(dtype="float64")})


def _unit(vectors) -> np.ndarray:
    block = np.asarray(vectors.tolist(), dtype=np.float64)
    norm = np.linalg.norm(block, axis=1, keepdims=True)
    return block / np.where(norm > 0, norm, 1.0)


@F.pandas_udf(ArrayType(DoubleType()))
def unit_vector(vectors: pd.Series) -> pd.Series:
    """Vectors of length one, made once before they are copied to cells."""
    return pd.Series(list(_unit(vectors)) if len(vectors) else [], index=vectors.index, dtype=object)


def _nearest(asked: np.ndarray, data: np.ndarray, n: int):
    """Best ``n`` rows of ``data`` for each row of ``asked``, of equals the earlier: indices of both, and scores."""
    step = max(1, SCORES_AT_ONCE // len(data))
    for a in range(0, len(asked), step):
        scores = asked[a : a + step] @ data.T
        # rounding first keeps ties ties, whatever block they were computed in
        even = np.round(scores, 12)
        keep = min(n, even.shape[1])
        bound = np.partition(even, even.shape[1] - keep, axis=1)[:, even.shape[1] - keep]
        q, v = np.nonzero(even >= bound[:, None])  # by query and drawer id
        near = _first_of_each(q, even[q, v], v, keep)
        q, v = q[near], v[near]
        yield a + q, v, scores[q, v]


def _first_of_each(q: np.ndarray, even: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Indices of the ``n`` first rows of every query, by falling score and then place."""
    order = np.lexsort((place, -even, q))
    sorted_ = q[order]
    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(q) else np.zeros(0, int)
    return order[np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)])) < n]


def _best_in_cell(n: int):
    def best(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or vectors.empty:
            return NO_HITS
        vectors = vectors.sort_values("drawer_id", kind="stable")
        data, asked = np.stack(vectors["embedding"].to_numpy()), np.stack(queries["query_vector"].to_numpy())
        names, ids = queries["question_id"].to_numpy(), vectors["drawer_id"].to_numpy()
        found = [pd.DataFrame({"question_id": names[q], "drawer_id": ids[v], "similarity": x}) for q, v, x in _nearest(asked, data, n)]
        return pd.concat(found)

    return best


def _best_elsewhere(n: int, shared):
    """Results of queries in all cells of a task but their own: only cells whose bound a query's
    ``reached`` leaves open are multiplied, and only results that come up to it are returned."""

    def best(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or vectors.empty:
            return NO_HITS
        near, least, cells = shared.value
        row = {c: i for i, c in enumerate(cells.tolist())}
        vectors = vectors.sort_values(["cell", "drawer_id"], kind="stable")
        data, asked = np.stack(vectors["embedding"].to_numpy()), np.stack(queries["query_vector"].to_numpy())
        names, ids, cell = queries["question_id"].to_numpy(), vectors["drawer_id"].to_numpy(), vectors["cell"].to_numpy()
        reached, own = queries["reached"].to_numpy(), queries["cell"].to_numpy()
        place = np.empty(len(ids), dtype=np.int64)
        place[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        parts, pending = [], 0

        def cut():
            q, v, x = (np.concatenate(c) for c in zip(*parts))
            first = _first_of_each(q, np.round(x, 12), place[v], n)
            return q[first], v[first], x[first]

        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(cell)]):
            i = row[int(cell[a])]
            asks = np.flatnonzero((cell_bounds(asked, near[i : i + 1], least[i : i + 1])[:, 0] >= reached) & (own != cell[a]))
            for q, v, x in _nearest(asked[asks], data[a:b], n) if len(asks) else ():
                up = x >= reached[asks[q]] - 1e-9
                parts.append((asks[q[up]], a + v[up], x[up]))
                pending += int(up.sum())
                if pending > PENDING:
                    parts = [cut()]
                    pending = len(parts[0][0]) // 2  # what stays never grows past n a query
        if not parts:
            return NO_HITS
        q, v, x = cut()
        return pd.DataFrame({"question_id": names[q], "drawer_id": ids[v], "similarity": x})

    return best


def _dealt(sizes: pd.DataFrame, rows: int) -> pd.DataFrame:
    """``cell, slices, slice, unit``: cells, those above ``rows`` vectors in slices, dealt to units of that many at most."""
    slices = -(-sizes["size"] // rows)
    pieces = sizes.assign(slices=slices).loc[sizes.index.repeat(slices)]
    pieces["slice"] = pieces.groupby("cell").cumcount()
    pieces["share"] = pieces["size"] / pieces["slices"]
    pieces = pieces.sort_values(["share", "cell"], ascending=[False, True])
    load, units = [], []
    for share in pieces["share"]:
        units.append(next((k for k, x in enumerate(load) if x + share <= rows), len(load)))
        if units[-1] == len(load):
            load.append(0.0)
        load[units[-1]] += share
    return pieces.assign(unit=units)[["cell", "slices", "slice", "unit"]].astype("int32")


def _pivots(drawers: DataFrame, cells: int) -> np.ndarray:
    """Unit vectors of drawers drawn by hash of the id: ``cells`` at most reach the driver."""
    drawn = drawers.orderBy(F.xxhash64("drawer_id"), "drawer_id").limit(cells).select(unit_vector("embedding").alias("v")).collect()
    return np.array([r.v for r in drawn])


def _placed(drawers: DataFrame, shared, columns: list[str]) -> DataFrame:
    """Drawers with unit vector, the nearest pivot's cell, and the cosine to that pivot."""

    @F.pandas_udf("cell int, near double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        if vectors.empty:
            return pd.DataFrame({"cell": pd.Series(dtype="int32"), "near": pd.Series(dtype="float64")})
        scores = np.stack(vectors.to_numpy()) @ shared.value.T
        return pd.DataFrame({"cell": scores.argmax(axis=1), "near": scores.max(axis=1)})

    rows = drawers.select("drawer_id", unit_vector("embedding").alias("embedding"), *columns)
    return rows.withColumn("_c", nearest("embedding")).select("*", "_c.cell", "_c.near").drop("_c")


def cell_bounds(asked: np.ndarray, pivots: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The most that a query's cosine with any vector of a cell can be: the angle to the pivot less
    the widest angle inside the cell (``least``: smallest cosine of a member with its pivot)."""
    angle = np.arccos(np.clip(asked @ pivots.T, -1, 1))
    return np.cos(np.maximum(angle - np.arccos(np.clip(least, -1, 1))[None], 0.0)) + 1e-9  # rounding of either side


def _met(queries: DataFrame, placed: DataFrame, sizes: DataFrame, rows: int, compare) -> DataFrame:
    """Results of queries in their own cells: ``queries(question_id, query_vector, block, cell, ...)``.
    A cell's vectors are cut into slices and copied just to the blocks that ask for it."""
    slices = F.greatest(F.ceil(F.col("size") / rows).cast("int"), F.lit(1))
    parts = sizes.select("cell", slices.alias("slices"))
    q = queries.join(parts, "cell").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    wanted = queries.select(F.col("cell").alias("cell"), F.col("block").alias("block")).distinct()  # names of their own, as both sides meet again
    d = placed.join(parts, "cell").withColumn("slice", F.pmod(F.xxhash64("drawer_id"), F.col("slices")).cast("int")).join(wanted, "cell").drop("slices", "near")
    keys = ["cell", "block", "slice"]
    return q.groupBy(*keys).cogroup(d.groupBy(*keys)).applyInPandas(compare, HIT)


def _met_elsewhere(asked: DataFrame, placed: DataFrame, pieces: DataFrame, blocks: int, compare) -> DataFrame:
    """Results in other cells: blocks of queries against units of cells, so that a vector is copied
    once a block and a query once a unit in which it has a cell open."""
    d = placed.drop("near").join(pieces, "cell").where(F.pmod(F.xxhash64("drawer_id"), F.col("slices")) == F.col("slice"))
    d = d.drop("slices", "slice").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["block", "unit"]
    return asked.groupBy(*keys).cogroup(d.groupBy(*keys)).applyInPandas(compare, HIT)


def search(
    queries: DataFrame, drawers: DataFrame, n: int = LIMITS.palace_top_k,
    max_distance: float | None = LIMITS.palace_max_distance, since: bool = False,
    cap_after_top: bool = False, cells: int | None = None,
) -> DataFrame:
    """Top ``n`` drawers per query by cosine similarity, with ``distance``.

    ``queries(question_id, embedding[, since])``, ``drawers(drawer_id,
    embedding[, authored_at])`` already filtered to one wing. With ``since`` the
    drawers carry dates and every query its own floor; queries are then grouped
    by floor inside the grid. ``cap_after_top`` applies the distance cap after
    the cut to ``n``; the surviving rows are the same either way, since the cap
    only removes the tail of an ordered list.

    Vectors stand around ``cells`` pivots (by default one for ``PER_CELL`` vectors, at most
    ``MOST_CELLS``). A query meets its nearest cell first; the n-th best similarity there, or the
    distance cap, is what a vector of another cell has to reach. Cells whose bound
    (``cell_bounds``) lies below are not multiplied for it. Nothing is lost. Blocks of queries and units of
    cells hold ``SIDE_BYTES`` at most: vectors are copied once for that many queries, and queries for that many vectors.
    """
    n_vectors, n_queries = drawers.count(), queries.count()
    some = drawers.where(F.col("embedding").isNotNull()).select(F.size("embedding").alias("n")).first()
    fit = max(1_024, SIDE_BYTES // (8 * max(1, some.n if some else 1)))
    rows, blocks = min(CELL_VECTORS, fit), max(1, -(-n_queries // min(CELL_QUERIES, fit)))
    floor = ["since"] if since else []
    # the names differ on the two sides, so both may come from one table
    q = queries.select("question_id", unit_vector("embedding").alias("query_vector"), *floor).withColumn(
        "block", F.pmod(F.xxhash64("question_id"), F.lit(blocks)).cast("int")
    )
    best = _best_in_cell(n)

    def by_floor(best):
        def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not since or left.empty or right.empty:
                return best(left, right)
            parts = []
            for day in left["since"].unique():
                mine = left["since"].isna() if pd.isna(day) else left["since"] == day
                fresh = np.ones(len(right), dtype=bool) if pd.isna(day) else (right["authored_at"] >= day).to_numpy(dtype=bool)
                parts.append(best(left.loc[mine.to_numpy(dtype=bool)], right.loc[fresh]))
            return pd.concat(parts)

        return compare

    compare = by_floor(best)

    cells = min(MOST_CELLS, max(1, n_vectors // PER_CELL)) if cells is None else cells
    dated = ["authored_at"] if since else []
    if cells == 1 or not n_vectors:  # nothing to leave out
        placed = drawers.select("drawer_id", unit_vector("embedding").alias("embedding"), *dated, F.lit(0).alias("cell"), F.lit(1.0).alias("near"))
        sizes = drawers.sparkSession.createDataFrame([(0, n_vectors)], "cell int, size bigint")
        return _cut(_met(q.withColumn("cell", F.lit(0)), placed, sizes, rows, compare), n, max_distance)
    sc = drawers.sparkSession.sparkContext
    pivots = _pivots(drawers, cells)
    placed = materialize(_placed(drawers, sc.broadcast(pivots), dated), "placed-vectors")
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.min("near").alias("least"))
    summary = sizes.toPandas().sort_values("cell")  # a row per pivot
    shared = sc.broadcast((pivots[summary["cell"].to_numpy()], summary["least"].to_numpy(), summary["cell"].to_numpy()))
    sizes = materialize(sizes, "cell-sizes")
    dealt = _dealt(summary[["cell", "size"]], rows)

    @F.pandas_udf("int")
    def home(vectors: pd.Series) -> pd.Series:
        near, _, names = shared.value
        return pd.Series(names[(np.stack(vectors.to_numpy()) @ near.T).argmax(axis=1)] if len(vectors) else [], index=vectors.index, dtype="int32")

    @F.pandas_udf("array<int>")
    def others(vectors: pd.Series, reached: pd.Series, own: pd.Series) -> pd.Series:
        near, least, names = shared.value
        if vectors.empty:
            return pd.Series([], dtype=object)
        open_ = cell_bounds(np.stack(vectors.to_numpy()), near, least) >= reached.to_numpy()[:, None]
        open_ &= names[None] != own.to_numpy()[:, None]
        return pd.Series([names[x].tolist() for x in open_], index=vectors.index, dtype=object)

    q = materialize(q.withColumn("cell", home("query_vector")), "placed-queries")
    first = materialize(_met(q, placed, sizes, rows, compare), "nearest-cell")
    floor_of_cap = -2.0 if not max_distance else 1 - max_distance - 1e-9
    nth = _cut(first, n, None).where(F.col("position") == n).select("question_id", F.col("similarity").alias("_nth"))
    reached = F.greatest(F.coalesce("_nth", F.lit(-2.0)), F.lit(floor_of_cap))
    asked = q.join(nth, "question_id", "left").withColumn("reached", reached)
    asked = materialize(asked.select("question_id", "reached", F.explode(others("query_vector", "reached", "cell")).alias("cell")), "asked-cells")
    pieces, again = (F.broadcast(drawers.sparkSession.createDataFrame(dealt, "cell int, slices int, slice int, unit int")) for _ in range(2))
    asked = q.join(asked.join(again, "cell").select("question_id", "reached", "unit").distinct(), "question_id")
    elsewhere = by_floor(_best_elsewhere(n, shared))
    return _cut(first.unionByName(_met_elsewhere(asked, placed, pieces, blocks, elsewhere)), n, max_distance)


def search_within(
    queries: DataFrame, drawers: DataFrame, n: int = LIMITS.palace_top_k,
    max_distance: float | None = LIMITS.palace_max_distance,
) -> DataFrame:
    """Top ``n`` of every question's own drawers for its one query.

    ``queries(question_id, embedding)`` is unique per question and ``drawers``
    carries ``question_id``, so the join adds no rows and Spark may split a
    question with many drawers over tasks.
    """
    asked = queries.select("question_id", F.col("embedding").alias("_q"))

    @F.pandas_udf(DoubleType())
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        if a.empty:
            return pd.Series([], dtype="float64")
        return pd.Series((_unit(a) * _unit(b)).sum(axis=1))

    scored = drawers.join(asked, "question_id").select(
        "question_id", "drawer_id", cosine("_q", "embedding").alias("similarity")
    )
    return _cut(scored, n, max_distance)


def _cut(scored: DataFrame, n: int, max_distance: float | None) -> DataFrame:
    order = [F.desc(F.round("similarity", 12)), F.asc("drawer_id")]
    best = top_rows(scored, ["question_id"], order, n).withColumn("distance", 1 - F.col("similarity"))
    return best if not max_distance else best.where(F.col("distance") <= max_distance)


def memory_lane(queries: DataFrame, drawers: DataFrame, n: int = LIMITS.palace_top_k,
                max_distance: float | None = LIMITS.palace_max_distance, since: bool = False) -> DataFrame:
    """Verified hits first, then evidence hits, numbered ``m01`` on per question."""
    lanes = []
    for order, wing in enumerate((VERIFIED, EVIDENCE)):
        found = search(queries, drawers.where(F.col("wing") == wing), n, max_distance, since)
        lanes.append(found.withColumn("wing", F.lit(wing)).withColumn("_lane", F.lit(order)))
    both = lanes[0].unionByName(lanes[1])
    # at most 2n rows per question are left
    numbered = top_rows(both.drop("position"), ["question_id"],
                        [F.asc("_lane"), F.desc(F.round("similarity", 12)), F.asc("drawer_id")], 2 * n, "position")
    return numbered.withColumn("cite_id", memory_cite_id(F.col("position"))).drop("_lane")


def precheck(queries: DataFrame, drawers: DataFrame, n: int = 3) -> DataFrame:
    """Whether the verified wing holds anything near each query."""
    hits = search(queries, drawers.where(F.col("wing") == VERIFIED), n).select("question_id").distinct()
    return queries.select("question_id").join(
        hits.withColumn("_hit", F.lit(True)), "question_id", "left"
    ).select("question_id", F.coalesce("_hit", F.lit(False)).alias("has_verified_hits"))


def merge_recalled(judged: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Fold refinement hits into the known passages of each question.

    ``judged(question_id, id, drawer_id, kept, ...)``: already judged passages,
    ``chunks(question_id, cite_id, drawer_id, rank)``: every frozen chunk,
    ``hits(question_id, drawer_id, similarity, position)``. A judged passage
    keeps its verdict and gains the similarity (``lane`` both); an unjudged known
    chunk keeps its engine rank (``lane`` palace); an unknown drawer is numbered
    by its hit position.
    """
    known = chunks.select("question_id", "drawer_id", F.col("cite_id").alias("_cite"), F.col("rank").alias("_rank"))
    seen = judged.select("question_id", F.col("id").alias("_cite"), F.lit(True).alias("_judged"))
    placed = hits.join(known, ["question_id", "drawer_id"], "left").join(seen, ["question_id", "_cite"], "left")
    return placed.select(
        "question_id",
        "drawer_id",
        F.coalesce("_cite", F.format_string("p%02d", "position")).alias("id"),
        "similarity",
        F.col("_rank").alias("engine_rank"),
        F.when(F.col("_judged"), "both").otherwise("palace").alias("lane"),
        F.when(F.col("_judged"), "keep_verdict").when(F.col("_cite").isNotNull(), "judge_chunk")
        .otherwise("judge_drawer").alias("action"),
    )
