"""Ranked lexical search, term at a time with a limited number of accumulators.

Every task holds some documents. For each item it goes through the item's terms,
rarest first, and adds what a term gives to the accumulators of its documents. As
soon as the most that all terms from here on can give lies below the k-th best sum
so far, a document without an accumulator cannot come among the best any more: no
accumulator is created from there on, and those that exist go on exactly, less those that
fall out of reach themselves.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weighbridge.llm.words import rows_and_hashes
from weighbridge.stages import materialize

BEST = 10
BLOCK_TERMS = 1 << 20  # terms of a block of items, about; what the driver and every task hold of them
POSTINGS = 4_000_000  # that a task searches at once, about


def _lowered(column: pa.Array):
    """Bytes of texts, A-Z in lower case; null is empty."""
    return ((x.as_py() or b"").lower() for x in column.cast(pa.binary()))


def _item_terms(items: DataFrame) -> DataFrame:
    """``item, term, times``: hashes of the terms of every item."""

    def run(batches):
        for batch in batches:
            number = batch.column(0).to_numpy()
            parts = list(rows_and_hashes(_lowered(batch.column(1))))
            rows, terms = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))
            order = np.lexsort((terms, rows))
            rows, terms = rows[order], terms[order].view(np.int64)
            first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (terms[1:] != terms[:-1])]) if len(rows) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number[rows[first]]), pa.array(terms[first]), pa.array(np.diff(np.r_[first, len(rows)]))], names=["item", "term", "times"]
            )

    return items.select("_item", "_text").mapInArrow(run, "item long, term long, times long")


def _postings(docs: DataFrame, text: str, doc_id: str, vocabulary: np.ndarray) -> DataFrame:
    """``doc_id, n, terms, tf``: number of all terms of a whole text; which terms of the vocabulary it holds, how often."""

    def run(batches):
        for batch in batches:
            rows = batch.num_rows
            n, keys = np.zeros(rows, np.int64), []
            for row, found in rows_and_hashes(_lowered(batch.column(1))):
                n += np.bincount(row, minlength=rows)
                if len(vocabulary):
                    at = np.minimum(np.searchsorted(vocabulary, found.view(np.int64)), len(vocabulary) - 1)
                    known = vocabulary[at] == found.view(np.int64)
                    keys.append(np.unique((row[known].astype(np.int64) << 32) | at[known], return_counts=True))
            key, which = np.unique(np.concatenate([k for k, _ in keys]) if keys else np.zeros(0, np.int64), return_inverse=True)
            tf = np.bincount(which, np.concatenate([c for _, c in keys]), len(key)) if keys else np.zeros(0)  # a long text comes in pieces
            offsets = pa.array(np.searchsorted(key, np.arange(rows + 1) << 32).astype(np.int32))
            terms = pa.ListArray.from_arrays(offsets, pa.array((key & 0xFFFFFFFF).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), terms, pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int64)))], names=["doc_id", "n", "terms", "tf"])

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<long>")


@dataclass
class Block:
    """Items of a block: their terms by ascending document frequency."""

    numbers: np.ndarray  # of the items
    offsets: np.ndarray
    terms: np.ndarray
    times: np.ndarray
    weight: np.ndarray  # of every term of the vocabulary


def search_block(block: Block, ids: np.ndarray, n: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray, floor: np.ndarray, totals: tuple[int, int], k: int):
    """``item, row, score`` of the k best documents of each item; raises ``floor``, the k-th best score each item has met."""
    every, length = totals
    m = 25 + (75 * n * every) // max(length, 1)
    gain = block.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
    order = np.lexsort((row, term))
    row, gain, term = row[order], gain[order], term[order]
    present, start = np.unique(term, return_index=True)
    end = np.r_[start[1:], len(term)]
    most = np.maximum.reduceat(gain, start) if len(start) else np.zeros(0, np.int64)
    sums, met = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    out = []
    for i in range(len(block.numbers)):
        a, b = block.offsets[i], block.offsets[i + 1]
        at = np.searchsorted(present, block.terms[a:b])
        here = (at < len(present)) & (present[np.minimum(at, len(present) - 1)] == block.terms[a:b]) if len(present) else np.zeros(b - a, bool)
        at, times = at[here], block.times[a:b][here]
        rest = np.cumsum((times * most[at])[::-1])[::-1]
        least, new, held, partial = floor[i], [], None, None
        for j, (t, q) in enumerate(zip(at, times)):
            lo, hi = start[t], end[t]
            if held is None and rest[j] < least:  # no other document can come among the best
                held = np.sort(np.concatenate(new)) if new else np.zeros(0, np.int64)
                partial = sums[held]
            if held is None:
                where = row[lo:hi]
                new.append(where[~met[where]])
                met[where] = True
                sums[where] += q * gain[lo:hi]
                so_far = sums[np.concatenate(new)] if j + 1 < len(at) else np.zeros(0)
            else:
                reach = partial + rest[j] >= least
                held, partial = held[reach], partial[reach]
                if hi - lo and len(held):
                    place = np.minimum(np.searchsorted(row[lo:hi], held), hi - lo - 1)
                    partial = partial + np.where(row[lo + place] == held, q * gain[lo + place], 0)
                so_far = partial
            if len(so_far) >= k:
                least = max(least, np.partition(so_far, len(so_far) - k)[len(so_far) - k])
        touched = np.concatenate(new) if new else np.zeros(0, np.int64)
        if held is None:
            held, partial = touched, sums[touched]
        sums[touched], met[touched] = 0, False
        fine = (partial > 0) & (partial >= least)
        held, partial = held[fine], partial[fine]
        best = np.lexsort((ids[held], -partial))[:k]
        if len(best) == k:
            floor[i] = max(floor[i], partial[best[-1]])
        out.append((np.full(len(best), block.numbers[i]), held[best], partial[best]))
    return [np.concatenate(x) if out else np.zeros(0, np.int64) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


def _found(postings: DataFrame, block: Block, totals: tuple[int, int], k: int) -> DataFrame:
    """The best of every task: ``item, doc_id, score``."""
    nowhere = np.iinfo(np.int64).max  # null ids come last

    def run(batches):
        floor = np.zeros(len(block.numbers), np.int64)
        held, size = [], 0

        def solve():
            table = pa.Table.from_batches(held).combine_chunks()
            if not len(table):
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, names=["item", "doc_id", "score"])
            ids = table["doc_id"].combine_chunks()
            lists = table["terms"].combine_chunks()
            row = np.repeat(np.arange(len(table)), lists.value_lengths().to_numpy())
            item, which, score = search_block(
                block, ids.fill_null(nowhere).to_numpy(), table["n"].to_numpy(), row, lists.flatten().to_numpy(), table["tf"].combine_chunks().flatten().to_numpy(), floor, totals, k
            )
            return pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), ids.take(pa.array(which, pa.int64())), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

        for batch in batches:
            held.append(batch)
            size += len(batch.column(2).flatten())
            if size >= POSTINGS:
                yield solve()
                held, size = [], 0
        if held:
            yield solve()

    return postings.mapInArrow(run, "item long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = BEST, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score`` of the k documents of highest score above 0 for each item.

    Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII,
    A-Z in lower case. With N documents of at least one term, L terms in all, n in a
    document, df documents with a term and tf of it in one: a term weighs
    floor(1000 ln((2N + 2) / (2 df + 1))), m is 25 + (75 n N) div L, and a score sums weight times
    (10^9 tf div (1000 tf + 8 m)) over the item's terms with repeats, in 64-bit integers.

    Every row of ``items`` is an item and every row of ``docs`` a document, also where ids
    repeat or are null (null ids come last among equals). Null and termless texts have no
    terms: such an item has no rows, such a document counts nowhere. Equal scores go by
    ascending id. Empty tables give an empty result.

    Items are taken in blocks of about ``block_terms`` terms, each against all documents:
    one pass over the texts that writes which of the block's terms a document holds, one
    over those postings in every task on its own (what a task's earlier documents have
    reached carries over), and a merge of k rows per item and task. Terms are 64-bit hashes.
    """
    numbered = materialize(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("_text")).withColumn("_item", F.monotonically_increasing_id()), "items")
    terms = materialize(_item_terms(numbered), "item-terms")
    blocks = max(1, -(-terms.count() // BLOCK_TERMS))
    found = None
    for which in range(blocks):
        mine = terms if blocks == 1 else terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == which)
        asked = mine.toArrow()  # about BLOCK_TERMS rows
        vocabulary, term = np.unique(asked["term"].to_numpy(), return_inverse=True)
        postings = materialize(_postings(docs, text, doc_id, vocabulary), "postings")
        sums = postings.agg(F.count_if(F.col("n") > 0).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        df = np.zeros(len(vocabulary), np.int64)
        for r in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row per term of the block
            df[r.term] = r["count"]
        weight = np.array([math.floor(1000 * math.log((2 * sums.n + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        item = asked["item"].to_numpy()
        order = np.lexsort((term, df[term], item))
        numbers, first = np.unique(item[order], return_index=True)
        block = Block(numbers, np.r_[first, len(order)], term[order], asked["times"].to_numpy()[order], weight)
        part = _found(postings, block, (sums.n, sums.length), k)
        found = part if found is None else found.unionByName(part)
    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = found.withColumn("rank", place).where(F.col("rank") <= k)
    return best.join(numbered.select(F.col("_item").alias("item"), "item_id"), "item").select("item_id", "rank", "doc_id", "score")
