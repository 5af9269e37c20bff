"""Byte-level BPE: encode with a queue of merge ranks, decode by joining vocabulary strings."""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# The published split pattern of this tokenizer family.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBERED = 500_000  # pieces whose ids a Python worker keeps; bounds memory (some 130 MB), never the result


def byte_symbols() -> dict[str, int]:
    """The character each byte is written as in the vocabulary file: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE file: bytes of each id, merge ranks, special strings."""

    def __init__(self, content: str):
        file = json.loads(content)
        byte_of = byte_symbols()
        ids = file["model"]["vocab"]
        self.bytes_of = {i: bytes(byte_of[c] for c in word) for word, i in ids.items()}
        self.single = [0] * 256
        for i, b in self.bytes_of.items():
            if len(b) == 1:
                self.single[b[0]] = i
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(file["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[left], ids[right]] = (rank, ids[left + right])
        self.special = {x["content"]: x["id"] for x in file.get("added_tokens", [])}
        self.bytes_of |= {i: text.encode() for text, i in self.special.items()}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces = regex.compile(SPLIT)
        self.known: dict[str, list[int]] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply merges in rank order, leftmost first among equals.

        Symbols form a doubly linked list; the queue holds (rank, place, left,
        right) of neighbours. An entry whose symbols have changed meanwhile is
        stale and skipped.
        """
        n = len(symbols)
        if n < 2:
            return symbols
        merges = self.merges
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []
        for i in range(n - 1):
            found = merges.get((symbols[i], symbols[i + 1]))
            if found:
                queue.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, joined = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue
            symbols[i], symbols[j] = joined, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                found = merges.get((joined, symbols[k]))
                if found:
                    heapq.heappush(queue, (found[0], i, joined, symbols[k], found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get((symbols[h], joined))
                if found:
                    heapq.heappush(queue, (found[0], h, symbols[h], joined, found[1]))
        return [s for s in symbols if s >= 0]

    def _plain(self, text: str, out: list[int]) -> None:
        known = self.known
        for piece in self.pieces.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.merge([self.single[b] for b in piece.encode()])
                if len(piece) <= 64:  # longer ones hardly come again
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            out += ids

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; special strings in it are their own ids."""
        out: list[int] = []
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            self._plain(text[at : m.start()], out)
            out.append(self.special[m.group()])
            at = m.end()
        self._plain(text[at:] if at else text, out)
        return out

    def decode(self, ids) -> str:
        """The vocabulary strings of the ids, joined; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(content: str) -> Vocabulary:
    return Vocabulary(content)


def _texts(batch: pa.RecordBatch, column: str):
    for x in batch.column(column):  # one text at a time
        yield x.as_py() or ""


def bpe_digests(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with ``n_tokens, ids_sha256, decoded_sha256`` of every whole text.

    The vocabulary file is read once on the driver (its size does not depend on
    the data) and broadcast; a worker compiles it once. Null text is empty: no
    tokens, digests of nothing. Every row is worked on by itself, so repeated rows,
    ties and empty tables need no rule.
    """
    held = _broadcast(docs, path)

    def run(batches):
        vocab = vocabulary(held.value)
        for batch in batches:
            counts, first, second = [], [], []
            for value in _texts(batch, "_text"):
                ids = vocab.encode(value)
                counts.append(len(ids))
                first.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                second.append(hashlib.sha256(vocab.decode(ids).encode()).hexdigest())
            arrays = [batch.column(c) for c in keep] + [pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    return _mapped(docs, run, keep, text, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_encode(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with ``ids array<int>`` of every whole text."""
    held = _broadcast(docs, path)

    def run(batches):
        vocab = vocabulary(held.value)
        for batch in batches:
            ids = pa.array([vocab.encode(value) for value in _texts(batch, "_text")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [ids], names=[*keep, "ids"])

    return _mapped(docs, run, keep, text, "ids array<int>")


def bpe_decode(encoded: DataFrame, path: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """``keep`` columns with ``decoded`` text of the ids; null ids give the empty text."""
    held = _broadcast(encoded, path)

    def run(batches):
        vocab = vocabulary(held.value)
        for batch in batches:
            texts = pa.array([vocab.decode(value) for value in _texts(batch, "_text")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [texts], names=[*keep, "decoded"])

    return _mapped(encoded, run, keep, ids, "decoded string")


def _broadcast(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def _mapped(df: DataFrame, run, keep: list[str], text: str, new: str) -> DataFrame:
    from pyspark.sql import functions as F

    rows = df.select(*keep, F.col(text).alias("_text"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keep]
    return rows.mapInArrow(run, ", ".join([*kept, new]))
