"""Factorization machines over sparse rows, learned in tasks whose changes executors add up."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACTORS = 8
SLICE = 8_192  # terms of a slice of the model; executors add up a slice at a time
UNSEEN = 8  # one of so many rows gives no gradients
BATCH, STEPS = 64, 20  # rows of a step; steps over a task's rows at least
ROWS = 4_096  # rows that a task learns from at once
PASSES = 2  # over a row in a round
GAIN = 0.05  # share of the loss that rates have to take away, else the next ones are tried


@dataclass
class Model:
    """score = sigmoid(bias + sum of weight times value + sum over pairs of the products of factors and values)."""

    bias: float
    table: np.ndarray  # of every term: weight, factors and, while it is learned, squares of either's gradients
    had: float = 1e-3

    @staticmethod
    def start(bias: float, weight: np.ndarray, factor: np.ndarray) -> Model:
        return Model(bias, np.column_stack([weight, factor, np.full((len(weight), 2), 1e-3)]).astype(np.float32))

    @staticmethod
    def random(bias: float, terms: int, seed: int) -> Model:
        return Model.start(bias, np.zeros(terms), np.random.default_rng(seed).normal(0, 0.01, (terms, FACTORS)))

    def learned(self) -> Model:
        """Without what only learning needs."""
        return Model(self.bias, np.ascontiguousarray(self.table[:, : 1 + FACTORS]))

    def logits(self, at: np.ndarray, value: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of rows whose terms and values stand one row after the other."""
        return _forward(self.bias, np.take(self.table, at, axis=0), value, size)[0]

    def scores(self, at: np.ndarray, value: np.ndarray, size: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(at, value, size).astype(np.float64), -40, 40)))


def _of_rows(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sum of the values of each row, which stand one row after the other; rows may be empty."""
    out = np.zeros((len(size), *values.shape[1:]), values.dtype)
    some = size > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(size) - size)[some], axis=0)
    return out


def _of_terms(values: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
    """Sum of the rows of values that have the same number, for numbers below n."""
    width = values.shape[1]
    cell = (which * width)[:, None] + np.arange(width)
    return np.bincount(cell.ravel(), values.ravel(), n * width).reshape(n, width)


def _forward(bias: float, held: np.ndarray, value: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits by the square of the sum less the sum of squares, in linear time; the rows' sums of factors times values."""
    crossed = held[:, 1 : 1 + FACTORS] * value[:, None]
    sums = _of_rows(crossed, size)
    squares = _of_rows(np.einsum("ij,ij->i", crossed, crossed), size)
    return bias + _of_rows(held[:, 0] * value, size) + 0.5 * ((sums**2).sum(1) - squares), sums


class _Rows:
    """Terms and values of a batch of rows; rows can be taken in any order."""

    def __init__(self, batch: pa.RecordBatch):
        self.labels = batch.column(0).to_numpy()
        self.unseen = batch.column(1).to_numpy().astype(np.uint64) % np.uint64(UNSEEN) == 0
        blobs = batch.column(2).to_pylist()
        self.size = np.array([len(b) // 4 for b in blobs], np.int64)
        self.at = np.frombuffer(b"".join(blobs), np.int32)
        self.value = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.float32) if batch.column(3).null_count == 0 else None
        self.first = np.cumsum(self.size) - self.size

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = self.size[rows]
        place = np.repeat(self.first[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.at[place], np.ones(len(place), np.float32) if self.value is None else self.value[place], size


def _step(new: Model, met: np.ndarray, labels: np.ndarray, at: np.ndarray, value: np.ndarray, size: np.ndarray, rates: tuple[float, float]) -> None:
    """One step of AdaGrad on the logistic loss of some rows."""
    met_now = np.zeros(len(new.table), bool)
    met_now[at] = True
    touched = np.flatnonzero(met_now)
    number = np.zeros(len(new.table), np.int64)
    number[touched] = np.arange(len(touched))
    which = number[at]
    z, sums = _forward(new.bias, np.take(new.table, at, axis=0), value, size)
    g = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) / len(labels)).astype(np.float32)
    if len(touched):
        held = new.table[touched]
        own, n = np.repeat(g, size) * value, len(touched)
        dw = np.bincount(which, own, n) + 1e-5 * held[:, 0]
        # of a pair: the gradient times both values times the other one's factor, summed as all less the own part
        crossed = np.repeat(g[:, None] * sums, size, axis=0)
        crossed *= value[:, None]
        dv = _of_terms(crossed, which, n) + (1e-4 - np.bincount(which, own * value, n))[:, None] * held[:, 1 : 1 + FACTORS]
        held[:, -2] += dw**2
        held[:, -1] += (dv**2).mean(1)
        held[:, 0] -= rates[0] * dw / np.sqrt(held[:, -2])
        held[:, 1 : 1 + FACTORS] -= rates[1] * dv / np.sqrt(held[:, -1])[:, None]
        new.table[touched] = held
        met[touched] += np.bincount(which, minlength=len(touched))
    new.had += float(g.sum() ** 2)
    new.bias -= rates[0] * float(g.sum()) / np.sqrt(new.had)


def _learn(model: Model, new: Model, met: np.ndarray, rows: _Rows, rates: tuple[float, float], rng) -> tuple[float, int]:
    """Loss of ``model`` over the unseen rows and their number; ``new`` passes over the others."""
    unseen, rest, loss = np.flatnonzero(rows.unseen), np.flatnonzero(~rows.unseen), 0.0
    for a in range(0, len(unseen), 256):
        part = unseen[a : a + 256]
        z = model.logits(*rows.take(part))
        loss += float(np.logaddexp(0, np.where(rows.labels[part] == 1, -z, z)).sum())
    for _ in range(PASSES if len(rest) else 0):
        for part in np.array_split(rng.permutation(rest), max(1, min(len(rest), max(STEPS, len(rest) // BATCH)))):
            _step(new, met, rows.labels[part], *rows.take(part), rates)
    return loss, len(unseen)


def _changed(rows: DataFrame, shared, rates: tuple[float, float], seed: int) -> DataFrame:
    """What the tasks change: a row per task and slice of terms with ``change * met, met``, and one (slice -1)
    with loss and number of unseen rows, changes of the bias and of its gradients' squares."""

    def run(batches):
        model, task = shared.value, TaskContext.get().partitionId()
        new, met, rng = Model(model.bias, model.table.copy(), model.had), np.zeros(len(model.table), np.float32), np.random.default_rng([seed, task])
        loss, n, seen = 0.0, 0, False
        for batch in batches:
            for part in (batch.slice(k, ROWS) for k in range(0, batch.num_rows, ROWS)):
                more, of = _learn(model, new, met, _Rows(part), rates, rng)
                loss, n, seen = loss + more, n + of, True
        if not seen:
            return
        yield _sent(task, -1, np.array([loss, n, new.bias - model.bias, new.had - model.had, 1.0], np.float32))
        for a in range(0, len(met), SLICE):
            mine = met[a : a + SLICE]
            if mine.any():
                change = (new.table[a : a + SLICE] - model.table[a : a + SLICE]) * mine[:, None]
                yield _sent(task, a // SLICE, np.column_stack([change, mine]))

    return rows.mapInArrow(run, "task int, slice int, blob binary")


def _sent(task: int, part: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([part], pa.int32()), pa.array([values.tobytes()])], names=["task", "slice", "blob"])


def _added(table: pa.Table) -> pa.Table:
    """Sum of what tasks changed of a slice, in order of the tasks."""
    total = None
    for i in np.argsort(table["task"].to_numpy()):
        values = np.frombuffer(table["blob"][int(i)].as_py(), np.float32)
        total = values.copy() if total is None else total + values
    return pa.table({"task": table["task"][:1], "slice": table["slice"][:1], "blob": pa.array([total.tobytes()])})


def learned_round(rows: DataFrame, model: Model, rates: tuple[float, float], seed: int) -> tuple[float, Model]:
    """Mean loss of ``model`` on unseen rows (NaN without any) and the model after one more round over
    ``rows(label, at, terms, value)``: changes averaged per term, weighted by how often a task has met it.

    Every task gets the model by broadcast (its size is fixed by the number of terms) and sends
    changed slices; a slice is added up where its parts meet, and the driver gets the sums, one model in all.
    A task redone on another executor gives the same changes, and sums go by task.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    try:
        sums = _changed(rows, shared, rates, seed).groupBy("slice").applyInArrow(_added, "task int, slice int, blob binary").toArrow()
    finally:
        shared.destroy()
    loss, n, new = 0.0, 0.0, Model(model.bias, model.table.copy(), model.had)
    for part, blob in zip(sums["slice"].to_pylist(), sums["blob"]):
        values = np.frombuffer(blob.as_buffer(), np.float32)
        if part < 0:
            loss, n = float(values[0]), float(values[1])
            new.bias += float(values[2] / values[4])
            new.had += float(values[3] / values[4])
            continue
        values = values.reshape(-1, model.table.shape[1] + 1)
        new.table[part * SLICE : part * SLICE + len(values)] += values[:, :-1] / np.maximum(values[:, -1:], 1.0)
    return (loss / n if n else float("nan")), new


def fitted(rows: DataFrame, start: Model, rates: list[tuple[float, float]], rounds: int, seed: int) -> tuple[Model | None, list[float]]:
    """The model of least loss on unseen rows after up to ``rounds`` rounds, None where ``start`` is best;
    and the losses met. Rates come in turn until some have lowered the loss by ``GAIN``. Without
    unseen rows the last model at the first rates.

    ``rows(label int, at long, terms binary, value binary)``: numbers of terms as int32, values
    as float32 (null: all 1); ``at``, a hash, tells which rows are unseen. Rows may be empty.
    """
    best, least, losses = None, np.inf, []
    for each in rates:
        if losses and least <= (1 - GAIN) * losses[0]:
            break
        now, last = start, np.inf
        for turn in range(rounds + 1):
            loss, after = learned_round(rows, now, each, seed + turn)
            losses.append(loss)
            if np.isnan(loss):
                if turn == rounds:
                    return now, losses
                now = after
                continue
            if loss >= last:
                break
            if loss < least:
                best, least = now, loss
            now, last = after, loss
    return (None if best is start else best), losses


def dealt(rows: DataFrame, n: int, least: int) -> DataFrame:
    """Rows for as many tasks as there are cores, or fewer with at least ``least`` rows each. A round
    shuffles as many copies of the model as there are tasks."""
    return rows.coalesce(max(1, min(n // least, rows.sparkSession.sparkContext.defaultParallelism)))


def of_each_label(rows: DataFrame) -> dict[int, int]:
    """Number of rows of label 0 and 1."""
    return {0: 0, 1: 0} | {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}


def labelled(docs: DataFrame, labels: DataFrame, learn_from, label: str, rows: int, *columns: str) -> DataFrame:
    """``label`` (0, 1), ``at`` (hash of the id) and ``columns`` of documents with a label for which
    ``learn_from`` holds, of at most about ``rows`` ids, chosen by hash.

    Of several labels of an id the highest counts; null labels and ids teach nothing.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).alias("_label"))
    known = known.where(learn_from)
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    # at most about ``rows`` ids and labels, so the texts need not be shuffled
    joined = docs.select("doc_id", *columns).join(F.broadcast(known), "doc_id")
    return joined.select(F.col("_label").alias("label"), F.xxhash64("doc_id").alias("at"), *columns)
