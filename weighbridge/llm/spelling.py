"""Spelling variants: one-edit neighbourhoods of words in a reduced alphabet, verified on the words.

Letters are mapped to a few symbols. Words one edit apart have reduced words at most one
edit apart, so every reduced word generates its whole one-edit neighbourhood,
which is joined to the reduced words there are; the words behind both are compared.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weighbridge.llm.words import mixed
from weighbridge.stages import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LETTERS, LEAST_COUNT = 7, 2
RATIO = 10  # times as often as a word its form stands at least
CANDIDATES = 64  # pairs to verify a word, on average; beyond, letters get more symbols
CELLS = 2_000_000  # neighbours generated at once
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def corpus_words(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, drop_one_in: int | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``word, n``: runs of Latin letters of all whole texts, A-Z in lower case, with their number.

    Words of at least ``least_letters`` letters that stand ``least_count`` times count.
    With ``drop_one_in`` a run loses a letter where crc32 of ``<doc_id>:<run>`` is divisible by
    it: the letter at that value modulo the length. A null id is empty there. Null, empty
    and letterless texts have no words; repeated rows count as often as they stand.
    """
    runs = docs.select(F.col(doc_id).alias("_id"), F.explode(F.regexp_extract_all(text, F.lit(f"([{LETTERS}]{{{least_letters},}})"), F.lit(1))).alias("_run"))
    word = F.translate("_run", UPPER, LOWER)
    if drop_one_in:
        runs = runs.select("_id", word.alias("_run"))
        h = F.crc32(F.concat(F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit(":"), F.col("_run")).cast("binary"))
        at = (h % F.length("_run")).cast("int")
        word = F.when(h % drop_one_in == 0, F.concat(F.substr("_run", F.lit(1), at), F.substr("_run", at + 2))).otherwise(F.col("_run"))
    counted = runs.select(word.alias("word")).where(F.length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


def alphabet(letters: dict[str, int], symbols: int) -> dict[str, str]:
    """Symbol of every letter; all symbols stand for about as many letters of the words."""
    load, out = [0] * symbols, {}
    for letter, n in sorted(letters.items(), key=lambda x: (-x[1], x[0])):
        least = load.index(min(load))
        load[least] += n
        out[letter] = chr(33 + least)
    return out


def _matrices(codes: list[str]):
    """Numbers and symbols of the reduced words of each length, bounded in size."""
    sizes = np.array([len(c) for c in codes], np.int64)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        step = max(1, CELLS // (64 * (int(size) + 1)))
        for a in range(0, len(rows), step):
            part = rows[a : a + step]
            data = np.frombuffer("".join(codes[i] for i in part).encode(), np.uint8).reshape(len(part), int(size))
            yield part, data.astype(np.uint64) - np.uint64(32)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def _named(sums: np.ndarray, size: int) -> np.ndarray:
    return mixed(sums + np.uint64(size * 0xD6E8FEB86659FD93 % (1 << 64))).view(np.int64)


def neighbourhood(data: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of reduced words of one length (rows of symbols from 1 on), and of all that one
    inserted, deleted or replaced symbol makes of them, with repeats."""
    rows, size = data.shape
    power = _powers(size + 1)
    terms = data * power[:size]
    before = np.zeros((rows, size + 1), np.uint64)
    np.cumsum(terms, axis=1, out=before[:, 1:])
    whole = before[:, -1:]
    every = np.arange(1, symbols + 1, dtype=np.uint64)
    deleted = before[:, :-1] + (whole - before[:, 1:]) * _INVERSE
    replaced = (whole - terms)[:, :, None] + every * power[:size, None]
    inserted = (before + (whole - before) * _BASE)[:, :, None] + every * power[:, None]
    made = [_named(deleted, size - 1), _named(replaced, size).reshape(rows, -1), _named(inserted, size + 1).reshape(rows, -1)]
    return _named(whole, size)[:, 0], np.concatenate(made, axis=1)


def _coded(words: DataFrame) -> DataFrame:
    """``word, n, key``: key names the reduced word ``code``."""

    def run(batches):
        for batch in batches:
            key = np.zeros(batch.num_rows, np.int64)
            for rows, data in _matrices(batch.column(2).to_pylist()):
                key[rows] = _named((data * _powers(data.shape[1])).sum(1, dtype=np.uint64), data.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(key)], names=["word", "n", "key"])

    return words.select("word", "n", "code").mapInArrow(run, "word string, n long, key long")


def _generated(codes: DataFrame, symbols: int) -> DataFrame:
    """``key, near``: a reduced word and those of its neighbourhood, itself included, that do not come
    after it. Being neighbours is mutual, so each pair is generated from its later one."""

    def run(batches):
        for batch in batches:
            for _, data in _matrices(batch.column(0).to_pylist()):
                own, made = neighbourhood(data, symbols)
                made = np.sort(np.column_stack([own, made]), axis=1)
                fresh = made <= own[:, None]
                fresh[:, 1:] &= made[:, 1:] != made[:, :-1]
                row, _ = np.nonzero(fresh)
                yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(made[fresh])], names=["key", "near"])

    return codes.select("code").mapInArrow(run, "key long, near long")


def _reduced_pairs(words: DataFrame, n_words: int, ratio_of_candidates: int) -> tuple[DataFrame, DataFrame]:
    """Words with the key of their reduced word, and pairs of keys within one edit.

    The alphabet has so many symbols that words of eight letters alone could all
    differ; if reduced words are crowded all the same, symbols are added until there are at most
    ``ratio_of_candidates`` pairs of words to verify for each word, or every letter has its own.
    """
    letters = {r.letter: r.n for r in words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").agg(F.count(F.lit(1)).alias("n")).collect()}
    symbols = min(max(2, math.ceil(n_words ** (1 / 8))), max(1, len(letters)))
    while True:
        symbol = alphabet(letters, symbols)
        coded = words.withColumn("code", F.translate("word", "".join(symbol), "".join(symbol.values())))
        keyed = materialize(_coded(coded), "reduced-words")
        sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
        near = F.broadcast if n_words <= 1_000 else lambda df: df.hint("shuffle_hash")
        pairs = _generated(coded.select("code").distinct(), symbols).join(near(sizes.withColumnRenamed("key", "near")), "near")
        pairs = materialize(pairs, "reduced-pairs")
        load = pairs.join(sizes.withColumnRenamed("size", "other"), "key").agg(F.sum(F.col("size") * F.col("other"))).first()[0] or 0
        if load <= ratio_of_candidates * n_words or symbols >= len(letters):
            return keyed, pairs.select("key", "near")
        symbols = min(len(letters), symbols + max(1, symbols // 2))


def one_edit_pairs(words: DataFrame, n_words: int, candidates: int = CANDIDATES) -> DataFrame:
    """``a, a_n, b, b_n``: every two of ``words(word, n)`` that differ by exactly one inserted, deleted or replaced code point, once."""
    keyed, pairs = _reduced_pairs(words, n_words, candidates)
    a = keyed.select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = keyed.select(F.col("key").alias("near"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    both = pairs.join(a, "key").join(b, "near").where((F.col("key") != F.col("near")) | (F.col("a") < F.col("b")))
    return both.where((F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")


def _roots(forms: DataFrame, most: int, ratio: int) -> DataFrame:
    """``word, root``: the last form reached from every word that has one. A form stands ``ratio`` times as
    often, so a way has few steps; each round doubles the steps taken."""
    steps = max(1, math.ceil(math.log(max(most, 2)) / math.log(ratio)) + 1)
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        on = now.select(F.col("word").alias("_at"), F.col("root").alias("_on"))
        now = materialize(now.join(on, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_on", "root").alias("root")), "roots")
    return now


def spelling_variants(words: DataFrame, ratio: int = RATIO, candidates: int = CANDIDATES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of ``words(word, n)`` (distinct words).

    Two words are near if they differ by exactly one code point inserted, deleted or
    replaced; ``n_near`` counts the near words. A word's form is its near word of
    largest n, of equal ones the smallest in code-point order, if that stands at least ``ratio`` times
    as often (ratio above 1), else null; root is where forms lead from the word, itself
    without a form. Rows with a null word are left out, a null n is 0. An empty table gives an empty one.

    How many words can be near one is bounded by its length and the letters there are, and
    ``candidates`` bounds what is verified, so no group grows with the corpus.
    """
    words = materialize(words.where(F.col("word").isNotNull()).select("word", F.coalesce(F.col("n").cast("long"), F.lit(0)).alias("n")), "vocabulary")
    facts = words.agg(F.count(F.lit(1)).alias("words"), F.max("n").alias("most")).first()

    def side(x: str, y: str) -> Column:
        return F.struct(F.col(x).alias("word"), F.col(f"{x}_n").alias("n"), F.col(y).alias("near"), F.col(f"{y}_n").alias("near_n"))

    sides = one_edit_pairs(words, facts.words, candidates).select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("s")).select("s.*")
    fine = F.when(F.col("near_n") >= ratio * F.col("n"), F.struct((-F.col("near_n")).alias("less"), "near"))
    near = materialize(sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(fine).alias("best")), "near-words")
    roots = _roots(near.where(F.col("best").isNotNull()).select("word", F.col("best.near").alias("form")), facts.most or 0, ratio)
    return words.join(near, "word", "left").join(roots, "word", "left").select(
        "word", F.col("best.near").alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), (-F.col("best.less")).alias("form_n")
    )
