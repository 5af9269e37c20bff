"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weighbridge.llm import words as wd
from weighbridge.llm.common import JUDGED, named_back, renamed
from weighbridge.llm.machine import FACTORS, Model, dealt, fitted, labelled, of_each_label
from weighbridge.stages import materialize

BITS = 18
PREFIXES = (4, 5, 6)  # bytes of a word's beginning that are terms besides the word
TRAIN_ROWS = 200_000  # labelled rows the model is fitted on at most (sampled by hash of the id)
LEAST_Z = 4.0  # how far a term's share among toxic texts lies from that among others, in standard deviations
LEAST_LIFT = 2.0  # how many times as often a term stands in texts of one label as in the others
LEAST_TEXTS = 4  # toxic texts that hold such a term, or texts of either label that hold any other
TASK_ROWS = 2_048  # labelled rows at least for each of the tasks that learn all terms
RATES = [(0.003, 0.005), (0.05, 0.02)]  # of weights and factors in the steps over all terms; the larger ones where the smaller ones gain little
ROUNDS = 4  # of these steps over all rows at most
EPOCHS = 25
STEPS = 20  # of an epoch at least
SEED = 7


@dataclass
class Machine:
    """score = sigmoid(bias + sum of weights + sum of products of factors over pairs of terms)."""

    place: np.ndarray  # bucket -> number of the term, -1 for terms without weight
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def score(self, terms: np.ndarray) -> float:
        at = self.place[terms]
        at = at[at >= 0]
        total = self.bias
        if len(at):
            v = self.factor[at]
            total += self.weight[at].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
        return float(1.0 / (1.0 + np.exp(-np.clip(total, -40, 40))))


def terms(text: str) -> np.ndarray:
    """Distinct hashed terms of a whole text: its words and their beginnings."""
    data = wd.lower_bytes(text)
    starts, ends = wd.spans(data)
    if not len(starts):
        return np.zeros(0, np.int64)
    found = [wd.hashes_of(data, starts, ends)]
    for n in PREFIXES:
        longer = starts[ends - starts > n]
        found.append(wd.hashes_of(data, longer, longer + n) ^ np.uint64(n))
    return np.unique(wd.mixed(np.concatenate(found)) >> np.uint64(64 - BITS)).astype(np.int64)


def _counts(train: DataFrame) -> DataFrame:
    """``bucket, toxic, clean``: how many texts of either label hold a term."""

    def run(batches):
        held = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                held[label, terms(text.as_py() or "")] += 1
        seen = np.flatnonzero(held.any(0))
        for a in range(0, len(seen), 50_000):
            part = seen[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(held[1, part]), pa.array(held[0, part])], names=["bucket", "toxic", "clean"])

    partial = train.select("text", "label").mapInArrow(run, "bucket long, toxic long, clean long")
    return partial.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _rows(train: DataFrame, place: np.ndarray) -> DataFrame:
    def run(batches):
        for batch in batches:
            lists = []
            for text in batch.column(0):
                at = place[terms(text.as_py() or "")]
                lists.append(at[at >= 0].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(lists, pa.list_(pa.int32()))], names=["label", "terms"])

    return train.select("text", "label").mapInArrow(run, "label int, terms array<int>")


def _lists(train: DataFrame, place: np.ndarray) -> DataFrame:
    """Labels and all terms that have a place, as bytes; every value is 1."""

    def run(batches):
        for batch in batches:
            lists = []
            for text in batch.column(0):
                at = place[terms(text.as_py() or "")]
                lists.append(at[at >= 0].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(lists, pa.binary()), pa.nulls(len(lists), pa.binary())], names=["label", "at", "terms", "value"])

    return train.select("text", "label", "at").mapInArrow(run, "label int, at long, terms binary, value binary")


def fit_machine(lists: list[np.ndarray], labels: np.ndarray, n_terms: int, seed: int = SEED) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by AdaGrad on mini-batches of the logistic loss."""
    rng = np.random.default_rng(seed)
    rate = labels.mean() if len(labels) else 0.5
    bias = float(np.log((rate * len(labels) + 0.5) / ((1 - rate) * len(labels) + 0.5)))
    w, v = np.zeros(n_terms), rng.normal(0, 0.01, (n_terms, FACTORS))
    gw, gv, gb = np.full(n_terms, 1e-3), np.full((n_terms, FACTORS), 1e-3), 1e-3
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    flat = np.concatenate([*lists, np.zeros(0, np.int32)]).astype(np.int64)
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(labels)), max(1, min(len(labels), max(STEPS, len(labels) // 256)))):
            size = offsets[rows + 1] - offsets[rows]
            row = np.repeat(np.arange(len(rows)), size)
            at = flat[np.repeat(offsets[rows], size) + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)]
            sums = np.zeros((len(rows), FACTORS))
            np.add.at(sums, row, v[at])
            squares = np.bincount(row, (v[at] ** 2).sum(1), len(rows))
            z = bias + np.bincount(row, w[at], len(rows)) + 0.5 * ((sums**2).sum(1) - squares)
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[rows]) / len(rows)
            touched, inverse = np.unique(at, return_inverse=True)
            dw = np.bincount(inverse, g[row], len(touched)) + 1e-5 * w[touched]
            dv = np.zeros((len(touched), FACTORS))
            np.add.at(dv, inverse, g[row][:, None] * (sums[row] - v[at]))
            dv += 1e-4 * v[touched]
            gw[touched] += dw**2
            gv[touched] += dv**2
            gb += g.sum() ** 2
            w[touched] -= 0.3 * dw / np.sqrt(gw[touched])
            v[touched] -= 0.05 * dv / np.sqrt(gv[touched])
            bias -= 0.3 * g.sum() / np.sqrt(gb)
    return bias, w, v


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column, label: str = "toxic", rows: int = TRAIN_ROWS) -> Machine:
    """Machine fitted on labelled ``docs(doc_id, text)`` for which ``learn_from`` holds.

    Of several labels of an id the highest counts; null labels teach nothing. A first
    fit has the terms alone whose shares among toxic and other texts differ, so that a
    long text is not judged by how much it says. From there all terms of ``LEAST_TEXTS``
    texts learn on, with their pairs, whatever a term tells by itself; the machine
    after any round is taken if it has less loss on unseen rows. Term counts are one
    aggregation of at most 2^18 buckets; the first fit is one task on at most about
    ``rows`` texts, of which only the numbers of its terms travel; the rounds over all
    terms run in as many tasks as there are rows for, and executors add up what these
    change (``machine.learned_round``). Without labelled rows every score is 0.5 less a little.
    """
    train = materialize(labelled(docs, labels, learn_from, label, rows, "text"), "labelled")
    total = of_each_label(train)
    toxic, clean = max(total[1], 1), max(total[0], 1)
    share = (F.col("toxic") + F.col("clean")) / (toxic + clean)
    z = (F.col("toxic") / toxic - F.col("clean") / clean) / F.sqrt(share * (1 - share + 1e-9) * (1 / toxic + 1 / clean))
    lift = (F.col("toxic") + 0.5) / (toxic + 1) / ((F.col("clean") + 0.5) / (clean + 1))
    telling = (F.abs(z) >= LEAST_Z) & ((F.col("toxic") >= LEAST_TEXTS) | (z < 0)) & ((lift >= LEAST_LIFT) | (lift <= 1 / LEAST_LIFT))
    supported = F.col("toxic") + F.col("clean") >= LEAST_TEXTS
    counted = _counts(train).select("bucket", telling.alias("telling")).where(supported | telling).toArrow().sort_by("bucket")  # at most 2^18
    every, told = counted["bucket"].to_numpy(), counted["telling"].to_numpy()
    place, wide = np.full(1 << BITS, -1, np.int32), np.full(1 << BITS, -1, np.int32)
    n_terms = int(told.sum())
    place[every[told]] = np.arange(n_terms)
    wide[every] = np.arange(len(every))

    def fit(table: pa.Table) -> pa.Table:
        column = table["terms"].combine_chunks()
        order = np.lexsort((table["label"].to_numpy(), column.value_lengths().to_numpy()))  # a fixed order of the rows
        flat, offsets = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
        lists = [flat[offsets[i] : offsets[i + 1]] for i in order]
        bias, w, v = fit_machine(lists, table["label"].to_numpy()[order], n_terms)
        lists = {name: pa.array([x.ravel().tolist()], pa.list_(pa.float64())) for name, x in (("weight", w), ("factor", v))}
        return pa.table({"bias": [bias]} | lists)

    fits = _rows(train, place).groupBy().applyInArrow(fit, "bias double, weight array<double>, factor array<double>").collect()
    if not fits:
        return Machine(place, -0.01, np.zeros(0, np.float32), np.zeros((0, FACTORS), np.float32))
    got = fits[0]
    first = Machine(place, got.bias, np.array(got.weight, np.float32), np.array(got.factor, np.float32).reshape(n_terms, FACTORS))
    if not (total[0] and total[1] and len(every)):
        return first
    weight, factor = np.zeros(len(every)), np.random.default_rng(SEED).normal(0, 0.01, (len(every), FACTORS))
    weight[told], factor[told] = first.weight, first.factor
    lists = dealt(materialize(_lists(train, wide), "labelled-terms"), total[0] + total[1], TASK_ROWS)
    best, _ = fitted(lists, Model.start(first.bias, weight, factor), RATES, ROUNDS, SEED)
    return first if best is None else Machine(wide, best.bias, best.table[:, 0], best.table[:, 1 : 1 + FACTORS])


def score_texts(docs: DataFrame, machine: Machine, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Null, empty and wordless texts get the score of a text without any known term.
    Rows are judged one by one, so repeated ones score alike; an empty table gives an
    empty one. Kept columns may have any name but the two new ones.
    """
    rows, kept = renamed(docs, keep, text=F.col(text))
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # at most 2^18 terms
    schema = StructType([*kept, *JUDGED])

    def run(batches):
        for batch in batches:
            score = np.array([shared.value.score(terms(t.as_py() or "")) for t in batch.column("text")], np.float64)
            columns = [*batch.columns[:-1], pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return named_back(rows.mapInArrow(run, schema), keep)
