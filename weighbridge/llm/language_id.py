"""Languages of a text as a mixture, inferred from n-gram likelihoods."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType, StructType

from weighbridge.llm import words as wd
from weighbridge.llm.common import fields, named_back, renamed

BITS = 15  # buckets of hashed n-grams
LENGTHS = (1, 2, 3, 4)  # bytes of an n-gram
SMOOTHING = 0.5
TEMPER = 0.35  # overlapping n-grams say less than independent ones
PENALTY = 1.5  # of a further language, in units of half the logarithm of the words
ROUNDS = 25
STRETCH = 1 << 18  # characters of a text whose n-grams are held at once
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
_LETTERS = np.array([b >= 128 or chr(b).isalpha() for b in range(256)], bool)


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # bucket x language
    prior: np.ndarray


def _grams(text: str, after: str = "") -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams (length x place) of lower-case text whose other characters are
    blanks, and the word each place belongs to (-1 outside of words). The last ones reach
    into what stands ``after``."""
    data, more = wd.lower_bytes(text), wd.lower_bytes(after)[: max(LENGTHS) - 1]
    inside = np.concatenate([[False], _LETTERS[data], [False] * max(LENGTHS)])
    padded = np.full(len(inside), 32, np.uint64)
    padded[1 : len(data) + 1] = np.where(inside[1 : len(data) + 1], data, 32)
    padded[len(data) + 1 : len(data) + 1 + len(more)] = np.where(_LETTERS[more], more, 32)
    n = len(data) + 1
    code, rows = np.zeros(n, np.uint64), []
    for k in range(max(LENGTHS)):
        code = code * np.uint64(256) + padded[k : n + k]
        if k + 1 in LENGTHS:
            rows.append(wd.mixed(code * np.uint64(8) + np.uint64(k)) >> np.uint64(64 - BITS))
    starts = np.flatnonzero(inside[1 : n + 1] & ~inside[:n])  # place before a word: its n-grams begin with the blank
    word = np.cumsum(np.bincount(starts, minlength=n)[:n]) - 1
    within = inside[:n] | (np.bincount(starts, minlength=n)[:n] > 0)
    return np.array(rows, np.int64), np.where(within, word, -1)


def _stretches(text: str):
    """A text in stretches of about ``STRETCH`` characters that end between words, each with the
    characters that its last n-grams reach into."""
    a = 0
    while a < len(text):
        b = min(a + STRETCH, len(text))
        while b < len(text) and not (text[b - 1].isascii() and not text[b - 1].isalpha()):
            b += 1
        yield text[a:b], text[b : b + max(LENGTHS)]
        a = b


def learn(docs: DataFrame, learn_from: Column) -> Model:
    """n-gram counts per language over all ``docs(doc_id, text, lang)`` for which
    ``learn_from`` holds; null text or language teaches nothing.

    Tasks count into 2^15 buckets per language and send sums; the model has as many
    numbers as buckets times languages, whatever the size of the corpus.
    """

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                count = held.setdefault(lang, np.zeros(1 << BITS, np.int64))
                for part in _stretches(text.as_py()):
                    grams, word = _grams(*part)
                    count += np.bincount(grams[:, word >= 0].ravel(), minlength=1 << BITS)
        for lang, count in held.items():
            seen = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen), pa.array(count[seen])], names=["lang", "bucket", "n"])

    train = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & learn_from).select("text", "lang")
    sums = train.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sums["lang"].to_pylist()
    names = sorted(set(langs))
    counts = np.zeros((1 << BITS, len(names)))
    place = {name: i for i, name in enumerate(names)}
    counts[sums["bucket"].to_numpy(), np.array([place[x] for x in langs], np.int64)] = sums["n"].to_numpy()
    total = counts.sum(0)
    log_p = np.log((counts + SMOOTHING) / (total + SMOOTHING * (1 << BITS)))
    return Model(names, log_p.astype(np.float32), np.log((total + 1) / (total + 1).sum()) if names else np.zeros(0))


def _mixture(likely: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Expectation-maximisation of the proportions; and the log-likelihood."""
    peak = likely.max(1, keepdims=True)
    p = np.exp(likely - peak)
    for _ in range(rounds):
        mass = p @ share
        new = share * (p / mass[:, None]).mean(0)
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, float(np.log(np.maximum(p @ share, 1e-300)).sum() + peak.sum())


def _word_likelihoods(text: str, after: str = "", *, model: Model) -> np.ndarray:
    """Log-likelihood of every word in every language, from its n-grams."""
    grams, word = _grams(text, after)
    inside = np.flatnonzero(word >= 0)
    if not len(inside):
        return np.zeros((0, len(model.languages)))
    starts = np.flatnonzero(np.r_[True, np.diff(word[inside]) > 0])
    likely = np.zeros((len(starts), len(model.languages)))
    for row in grams:
        likely += np.add.reduceat(model.log_p[row[inside]], starts, axis=0)
    return likely


def infer(text: str, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the languages of a text, their proportions).

    Words are drawn from languages; a word's likelihood comes from its n-grams. From
    the mixture of all languages the least is taken away again and again; the set of
    highest log-likelihood less the penalty per further language is kept.
    """
    parts = [likely for part in _stretches(text) if len(likely := _word_likelihoods(*part, model=model))] if model.languages else []
    if not parts:
        return np.zeros(0, int), np.zeros(0)
    likely = np.concatenate(parts)
    likely *= TEMPER
    words = len(likely)
    each = 0.5 * PENALTY * np.log(words + 1)
    share = np.full(len(model.languages), 1 / len(model.languages))
    share, value = _mixture(likely, share, ROUNDS)
    one = int(likely.sum(0).argmax())
    best = (likely[:, one].sum(), np.array([one]), np.ones(1))
    chosen = np.flatnonzero(share > 0.5 / words)
    while len(chosen) > 1:
        part, value = _mixture(likely[:, chosen], share[chosen] / share[chosen].sum(), 10)
        if value - each * (len(chosen) - 1) > best[0]:
            best = (value - each * (len(chosen) - 1), chosen, part)
        share = np.zeros(len(share))
        share[chosen] = part
        chosen = np.delete(chosen, part.argmin())
    return best[1], best[2]


def identify(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with ``lang_pred``, ``score`` (its proportion) and ``languages``
    (all of the text's languages with their proportions).

    Null text and text without a letter is ``und`` with score 0, as is every text if
    nothing was learned. Rows are judged one by one, so repeated ones get the same; of equal
    proportions the language that sorts first counts; an empty table gives an empty one.
    Kept columns may have any name but the three new ones.
    """
    rows, kept = renamed(docs, keep, text=F.col(text))
    new = fields(lang_pred=StringType(), score=DoubleType(), languages=MapType(StringType(), DoubleType()))
    schema = StructType([*kept, *new])

    def run(batches):
        for batch in batches:
            names, scores, mixtures = [], [], []
            for value in batch.column("text"):
                value = value.as_py()
                found, share = infer(value, model) if value and LETTER.search(value) else ((), ())
                if not len(found):
                    names.append(UNKNOWN), scores.append(0.0), mixtures.append([])
                    continue
                top = int(np.argmax(share))
                names.append(model.languages[found[top]])
                scores.append(min(1.0, float(share[top])))
                mixtures.append([(model.languages[i], float(s)) for i, s in zip(found, share)])
            columns = [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(mixtures, pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return named_back(rows.mapInArrow(run, schema), keep)
