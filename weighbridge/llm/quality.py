"""Quality of whole texts by a factorization machine over hashed words, structure and metadata."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weighbridge.llm import words as wd
from weighbridge.llm.common import JUDGED, named_back, renamed
from weighbridge.llm.machine import Model, dealt, fitted, labelled, of_each_label
from weighbridge.stages import materialize

BITS = 16  # buckets of hashed words and runs of signs
BINS = 64  # of every statistic and number
TRAIN_ROWS = 40_000  # labelled rows the machine is fitted on at most (sampled by hash of the id)
TASK_ROWS = 2_048  # labelled rows at least for each of the tasks that learn
ROUNDS = 12
RATES = [(0.1, 0.05)]
SEED = 13

_SIGNS = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)], bool)
_LINES = np.array([b != 10 for b in range(256)], bool)
_CLASS = np.zeros(256, np.int64)  # 0 other, 1 small, 2 capital, 3 digit, 4 sign, 5 blank, 6 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[_SIGNS], _CLASS[[9, 10, 11, 12, 13, 32]], _CLASS[128:] = 4, 5, 6
STATISTICS = (
    "words", "word length", "distinct words", "commonest word", "repeated neighbours", "distinct pairs of words", "capitals", "digits", "signs", "blanks",
    "beyond ASCII", "lines", "distinct lines", "commonest line", "words a line", "distinct signs", "signs after words", "one-letter words", "longest word", "capitals first",
)


def _share(part: float, whole: float) -> int:
    """Bin of a share: fine near 0 and 1, coarse between."""
    s = part / whole if whole else 0.0
    return 1 + min(int(20 * s), 19) + (20 if s > 0.99 else 21 if 0 < s < 0.01 else 0) if whole else 0


def _scale(x: float) -> int:
    """Bin of a number from 0 on: four for each doubling."""
    return min(int(4 * np.log2(1 + x)), BINS - 1) if np.isfinite(x) and x >= 0 else BINS - 1


def _repeats(hashes: np.ndarray) -> tuple[int, int]:
    """Distinct ones and how often the commonest stands."""
    if not len(hashes):
        return 0, 0
    _, n = np.unique(hashes, return_counts=True)
    return len(n), int(n.max())


def features(raw: bytes, numbers: tuple[float | None, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values of the terms of a whole text: its words and runs of signs, hashed, of length 1 in
    all; a bin of every statistic of its structure and of every number that comes with it."""
    data = np.frombuffer(raw, np.uint8)
    lowered = np.frombuffer(raw.lower(), np.uint8)
    count = sum((np.bincount(data[a : a + wd.STRETCH], minlength=256) for a in range(0, len(data), wd.STRETCH)), np.zeros(256, np.int64))
    kinds = np.bincount(_CLASS, count, 7)
    starts, ends = wd.spans(lowered)
    hashes = wd.hashes_of(lowered, starts, ends)
    sign_starts, sign_ends = wd.spans(lowered, _SIGNS)
    signs = wd.hashes_of(lowered, sign_starts, sign_ends)
    line_starts, line_ends = wd.spans(lowered, _LINES)
    lines = wd.hashes_of(lowered, line_starts, line_ends)
    distinct, tf = np.unique(hashes, return_counts=True)
    sign_kinds, sign_tf = np.unique(signs, return_counts=True)
    n, letters = len(hashes), kinds[1] + kinds[2]
    pairs = hashes[:-1] * np.uint64(3) + hashes[1:]
    different_lines, most_lines = _repeats(lines)
    after = len(np.intersect1d(ends, sign_starts, assume_unique=True))
    binned = [
        _scale(n), _scale(float((ends - starts).mean()) if n else 0), _share(len(distinct), n), _share(int(tf.max()) if n else 0, n), _share(int((hashes[1:] == hashes[:-1]).sum()), max(n - 1, 0)),
        _share(_repeats(pairs)[0], len(pairs)), _share(kinds[2], letters), _share(kinds[3], len(data)), _share(kinds[4], len(data)), _share(kinds[5], len(data)),
        _share(kinds[6], len(data)), _scale(len(lines)), _share(different_lines, len(lines)), _share(most_lines, len(lines)), _scale(n / max(len(lines), 1)), _scale(len(sign_kinds)),
        _share(after, n), _share(int((ends - starts == 1).sum()), n), _scale(float((ends - starts).max()) if n else 0), _share(int((_CLASS[data[starts]] == 2).sum()), n),
    ]
    binned += [0 if x is None else 1 + min(_scale(float(x)), BINS - 2) for x in numbers]
    every = np.concatenate([distinct, wd.mixed(sign_kinds + np.uint64(1))])
    at = (wd.mixed(every) >> np.uint64(64 - BITS)).astype(np.int32)
    value = 1 + np.log(np.concatenate([tf, sign_tf]).astype(np.float32))
    value /= max(float(np.sqrt((value**2).sum())), 1e-9)
    at = np.concatenate([at, (1 << BITS) + BINS * np.arange(len(binned), dtype=np.int32) + np.array(binned, np.int32)])
    return at.astype(np.int32), np.concatenate([value, np.full(len(binned), 1.0)]).astype(np.float32)


def _featured(batch: pa.RecordBatch, text: int, numbers: range) -> list[tuple[np.ndarray, np.ndarray]]:
    beside = [batch.column(k).to_pylist() for k in numbers]
    return [features(raw.as_py() or b"", tuple(x[i] for x in beside)) for i, raw in enumerate(batch.column(text).cast(pa.binary()))]


@dataclass
class Quality:
    model: Broadcast
    metadata: list[str]
    losses: list[float]  # on unseen rows, round by round


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column, label: str = "quality", metadata: list[str] | None = None, rows: int = TRAIN_ROWS) -> Quality:
    """Machine fitted on labelled ``docs(doc_id, text)`` for which ``learn_from`` holds.

    ``metadata`` names numeric columns beside the text that the machine may look at;
    a null is a value of its own. Of several labels of an id the highest counts; null
    labels and ids teach nothing; repeated documents count as often as they stand. At most about ``rows`` ids
    teach; the model has 2^16 buckets of words and 64 bins of each statistic, whatever the corpus.
    Rounds end when the loss on the eighth of the rows that gives no gradients rises. Without labelled
    rows, or without any of one label, every score is the share of label 1 (0.5 without any).
    """
    metadata = metadata or []
    numbers = [F.col(f"`{m}`").cast("double").alias(f"_m{k}") for k, m in enumerate(metadata)]
    named = docs.select("doc_id", F.col("text").alias("_text"), *numbers)
    names = [f"_m{k}" for k in range(len(metadata))]
    train = labelled(named, labels, learn_from, label, rows, "_text", *names)

    def run(batches):
        for batch in batches:
            made = _featured(batch, 2, range(3, 3 + len(names)))
            columns = [pa.array([x[k].tobytes() for x in made], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["label", "at", "terms", "value"])

    known = materialize(train.mapInArrow(run, "label int, at long, terms binary, value binary"), "labelled")
    total = of_each_label(known)
    start = Model.random(float(np.log((total[1] + 0.5) / (total[0] + 0.5))), (1 << BITS) + BINS * (len(STATISTICS) + len(names)), SEED)
    best, losses = fitted(dealt(known, total[0] + total[1], TASK_ROWS), start, RATES, ROUNDS, SEED) if total[0] and total[1] else (None, [])
    if best is None:
        best = Model(start.bias, np.zeros_like(start.table)) if not losses else start
    return Quality(docs.sparkSession.sparkContext.broadcast(best.learned()), metadata, losses)


def score_texts(docs: DataFrame, quality: Quality, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) of every whole text.

    Null text is empty; an empty text is judged by its metadata and by being empty.
    Rows are judged one by one, so repeated ones score alike. Kept columns may have any name but the two new ones.
    """
    numbers = {f"m{k}": F.col(f"`{m}`").cast("double") for k, m in enumerate(quality.metadata)}
    rows, kept = renamed(docs, keep, text=F.col(text), **numbers)
    model, at = quality.model, len(keep)
    schema = StructType([*kept, *JUDGED])

    def run(batches):
        for batch in batches:
            for part in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                made = _featured(part, at, range(at + 1, part.num_columns))
                size = np.array([len(x) for x, _ in made], np.int64)
                score = model.value.scores(np.concatenate([x for x, _ in made]), np.concatenate([v for _, v in made]), size)
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=schema.names)

    return named_back(rows.mapInArrow(run, schema), keep)
