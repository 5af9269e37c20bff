"""Approximate nearest neighbours by learned partitions.

On a bounded sample the graph of nearest neighbours is cut into balanced parts, and
a small network learns which parts hold the neighbours of a vector. Every vector is
filed under its most probable part; a query asks several most probable ones and
ranks what they hold by exact distance.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weighbridge.llm import blocks
from weighbridge.stages import materialize

SAMPLE = 12_288  # vectors the model is fitted on; a third of them only measures recall
PART_ROWS = 2_048  # vectors per part to aim at
PARTS = (4, 128)
NEIGHBOURS = 10
HIDDEN = 96
EPOCHS = 30
RECALL = 0.97  # on the measuring third, when the number of parts to ask is set
SEED = 11


@dataclass
class Index:
    """Network weights, the number of parts and how many of them a query asks."""

    mean: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    ask: int

    @property
    def dims(self) -> int:
        return len(self.mean)

    def logits(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors - self.mean
        return np.maximum(unit @ self.w1 + self.b1, 0.0) @ self.w2 + self.b2


def _neighbours(queries: np.ndarray, data: np.ndarray, k: int, same: bool) -> np.ndarray:
    """Row numbers of the k nearest rows of ``data``; its own row is left out where the two are the same."""
    out = np.empty((len(queries), min(k, len(data) - same)), np.int64)
    square = (data**2).sum(1)
    for a in range(0, len(queries), 1024):
        d = square[None] - 2 * queries[a : a + 1024] @ data.T
        if same:
            d[np.arange(len(d)), a + np.arange(len(d))] = np.inf
        out[a : a + 1024] = np.argpartition(d, out.shape[1] - 1, axis=1)[:, : out.shape[1]] if out.shape[1] else 0
    return out


def balanced_parts(vectors: np.ndarray, graph: np.ndarray, parts: int, sweeps: int = 12) -> np.ndarray:
    """Part of every node: equal halves along the widest direction first, then moves to
    the part of most neighbours while no part outgrows its share by a tenth."""
    part = np.zeros(len(vectors), np.int64)
    waiting, label = [(np.arange(len(vectors)), parts)], 0
    while waiting:
        rows, into = waiting.pop()
        if into == 1:
            part[rows] = label
            label += 1
            continue
        centred = vectors[rows] - vectors[rows].mean(0)
        axis = np.linalg.svd(centred, full_matrices=False)[2][0] if len(rows) > 1 else np.zeros(vectors.shape[1])
        order = rows[np.argsort(centred @ axis, kind="stable")]
        cut = len(rows) * (into // 2) // into
        waiting += [(order[:cut], into // 2), (order[cut:], into - into // 2)]
    room = int(np.ceil(1.1 * len(vectors) / parts))
    source = np.repeat(np.arange(len(vectors)), graph.shape[1])
    both = np.concatenate([source, graph.ravel()]), np.concatenate([graph.ravel(), source])
    for _ in range(sweeps):
        votes = np.bincount(both[0] * parts + part[both[1]], minlength=len(vectors) * parts).reshape(-1, parts)
        own = votes[np.arange(len(vectors)), part]
        best = votes.argmax(1)
        gain = votes[np.arange(len(vectors)), best] - own
        held = np.bincount(part, minlength=parts)
        moved = 0
        for node in np.argsort(-gain, kind="stable"):
            if gain[node] <= 0:
                break
            if held[best[node]] < room:
                held[part[node]] -= 1
                held[best[node]] += 1
                part[node] = best[node]
                moved += 1
        if moved * 200 < len(vectors):
            break
    return part


def _network(vectors: np.ndarray, targets: np.ndarray, rng: np.random.Generator) -> Index:
    """One hidden layer, softmax over parts, Adam on mini-batches; targets are distributions."""
    n, dims = vectors.shape
    parts = targets.shape[1]
    scale = 1.0 / max(np.sqrt(((vectors - vectors.mean(0)) ** 2).sum(1).mean()), 1e-12)
    w = [rng.normal(0, 2 * scale, (dims, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    mean, step = vectors.mean(0), 0
    for epoch in range(EPOCHS):
        rate = 0.01 * (1 - epoch / EPOCHS) + 0.0005
        for rows in np.array_split(rng.permutation(n), max(1, n // 128)):
            x = vectors[rows] - mean
            h = np.maximum(x @ w[0] + w[1], 0.0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - targets[rows]) / len(rows)
            back = (g @ w[2].T) * (h > 0)
            step += 1
            for i, d in enumerate((x.T @ back, back.sum(0), h.T @ g, g.sum(0))):
                size = scale if i < 2 else 1.0  # inputs may have any scale
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.999 * v[i] + 0.001 * d * d
                w[i] -= rate * (size if i == 0 else 1.0) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-12)
    return Index(mean, *w, 1)


def learned_index(vectors: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> Index | None:
    """Model fitted on at most ``sample`` of ``vectors(vec_id, vec)``, taken by hash of the id.

    The parts to ask are as many as reach ``RECALL`` for the measuring third of the
    sample, which the network has not seen. None for an empty table.
    """
    facts = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dims")).first()
    if not facts.n:
        return None
    taken = vectors.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample).select("vec").toArrow()
    points = blocks.matrix(taken["vec"], facts.dims)
    held = len(points) // 3
    test, train = points[:held], points[held:]
    parts = int(np.clip(-(-facts.n // PART_ROWS), *PARTS))
    parts = min(parts, len(train))
    graph = _neighbours(train, train, NEIGHBOURS, True)
    part = balanced_parts(train, graph, parts)
    targets = np.zeros((len(train), parts))
    targets[np.arange(len(train)), part] += 1.0
    if graph.shape[1]:
        np.add.at(targets, (np.repeat(np.arange(len(train)), graph.shape[1]), part[graph].ravel()), 1.0)
    targets /= targets.sum(1, keepdims=True)
    index = _network(train, targets, np.random.default_rng(seed))
    index.ask = parts
    if held > NEIGHBOURS:
        asked = test[:1024]
        home = index.logits(test).argmax(1)
        near = home[_neighbours(asked, test, NEIGHBOURS + 1, False)]  # its own row is found in any case
        place = np.empty((len(asked), parts), np.int64)
        np.put_along_axis(place, np.argsort(-index.logits(asked), axis=1), np.arange(parts)[None], axis=1)
        needed = np.sort(np.take_along_axis(place, near, axis=1), axis=1)[:, 1:]
        reached = [(needed < r).mean() for r in range(1, parts + 1)]
        index.ask = 1 + next(r for r, x in enumerate(reached) if x >= RECALL or r == parts - 1)
    return index


def _filed(vectors: DataFrame, index: Index, ask: int) -> DataFrame:
    """Vectors with their ``ask`` most probable parts."""
    dims = index.dims

    def run(batches):
        for batch in batches:
            logits = index.logits(blocks.matrix(batch.column(1), dims))
            best = np.argsort(-logits, axis=1, kind="stable")[:, :ask].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, best.size + 1, best.shape[1]), pa.int32()), pa.array(best.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["vec_id", "vec", "parts"])

    filed = vectors.select("vec_id", "vec").mapInArrow(run, "vec_id long, vec array<double>, parts array<int>")
    return filed.select("vec_id", "vec", F.explode("parts").alias("part"))


def _nearest(dims: int, k: int):
    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ("query_id", "vec_id", "score")
        if not len(left) or not len(right):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        ids, data = right["vec_id"].to_numpy(), blocks.matrix(right["vec"], dims)
        rows = blocks.by_id_without_copies(ids, data, k)
        ids, data = ids[rows], data[rows]
        own, queries = left["vec_id"].to_numpy(), blocks.matrix(left["vec"], dims)
        size, found = (data**2).sum(1), []
        step = max(1, blocks.CELLS // len(ids))
        for a in range(0, len(own), step):
            q0, o = queries[a : a + step], own[a : a + step]
            norm = (q0**2).sum(1)
            close = 2 * q0 @ data.T - size[None] - norm[:, None]
            at = np.minimum(np.searchsorted(ids, o), len(ids) - 1)
            close[np.flatnonzero(ids[at] == o), at[ids[at] == o]] = -np.inf
            q, r = blocks.best_rows(close, k, slack=1e-9 * (1e-300 + norm.max() + size.max()))
            distance = np.concatenate([np.sqrt(((q0[q[i : i + 65536]] - data[r[i : i + 65536]]) ** 2).sum(1)) for i in range(0, len(q), 65536)] or [np.zeros(0)])
            keep = blocks.cut(q, distance, ids[r], k, False)
            found.append((o[q[keep]], ids[r[keep]], distance[keep]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*found)], names=names)

    return solve


def search(vectors: DataFrame, is_query: Column, k: int, index: Index | None) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k nearest found for every query.

    ``vectors(vec_id, vec)``, double components, one row per id; all are filed, none
    is sampled. Score is the Euclidean distance of the original vectors in double
    precision; ties go to smaller ids; a query is never its own result. Fewer than k
    candidates give fewer rows; short vectors count as filled with zeros; an empty
    table gives an empty one. Parts are cut into slices of bounded size, so a part
    that holds many copies of a vector is no larger task than another.
    """
    spark = vectors.sparkSession
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    filed = materialize(_filed(vectors, index, 1), "filed-vectors")
    asked = materialize(_filed(vectors.where(is_query), index, index.ask), "asked-parts")
    cuts = lambda df, out: df.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / blocks.SLICE_ROWS[0]).cast("int").alias(out))
    cuts_of = materialize(cuts(filed, "_slices").join(cuts(asked, "_blocks"), "part"), "part-sizes")
    cuts_of = F.broadcast(cuts_of)  # a row per part: at most PARTS[1]
    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["part", "slice", "block"]
    data = filed.join(cuts_of, "part").select("vec_id", "vec", "part", place("_slices").alias("slice"), each("_blocks").alias("block"))
    asked = asked.join(cuts_of, "part").select("vec_id", "vec", "part", each("_slices").alias("slice"), place("_blocks").alias("block"))
    partials = (
        asked.groupBy(*keys).cogroup(data.groupBy(*keys))
        .applyInArrow(_nearest(index.dims, k), "query_id long, vec_id long, score double")
    )
    return blocks.ranked(partials, k, False)
