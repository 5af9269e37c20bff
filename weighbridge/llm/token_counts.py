"""Count tokens with a tokenizer compiled to finite-state transducers.

Two deterministic transducers in a row:

* ``Splitter`` cuts a text into pieces, as the published split pattern does. Its
  dozen states run over classes of characters; a transition tells whether a piece
  begins before the current character, and whether one begins before the previous
  one (the pattern looks one character ahead of white space). Texts of a batch lie
  in one buffer that is cut into chunks of fixed length. Every chunk is run from
  all states at once, which gives its state map; the maps are composed by a
  parallel prefix scan, and a last pass emits the cuts from the then known states.
* ``PieceCounter`` counts the tokens of a piece byte by byte. A transition carries
  the change of the token count. It is compiled where texts first need it.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weighbridge.llm.bpe import Vocabulary, _broadcast, _mapped, _texts

CHUNK = 64
BUFFER = 1 << 20  # characters of one buffer; a longer text has a buffer of its own
FEW = 16  # vocabulary strings a beginning may become, up to which tokens are told apart by what fits them
REMEMBERED = 600_000  # counts of pieces a worker keeps (some 60 MB); bounds memory only
STATES = 100_000  # compiled states a worker keeps before it starts over; bounds memory only

# Classes of characters.
END, LETTER, NUMBER, SPACE, BLANK, QUOTE, OTHER, SINGLE, R, E_, V, L = range(12)
# States.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, AFTER_BLANK, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L, FRESH = range(11)
CUT, CUT_BEFORE = 1, 2  # a piece begins before this character, before the previous one


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Class of every code point, from the Unicode categories."""
    classes = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            classes[code] = LETTER
        elif kind == "N":
            classes[code] = NUMBER
    blanks = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    classes[blanks] = BLANK
    classes[0x20], classes[0x27] = SPACE, QUOTE
    for letters, kind in (("stmd", SINGLE), ("r", R), ("e", E_), ("v", V), ("l", L)):
        for letter in letters:
            classes[ord(letter)] = kind
    return classes


def _splitter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and cuts by (state, class)."""
    nxt, cut = np.zeros((11, 12), np.uint8), np.zeros((11, 12), np.uint8)
    letters = (LETTER, SINGLE, R, E_, V, L)
    for state in range(11):
        for kind in range(12):
            if kind == END:
                nxt[state, kind] = START
                continue
            blank_before = state in (AFTER_SPACE, AFTER_BLANK)
            own = {**dict.fromkeys(letters, IN_LETTERS), NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, QUOTE: IN_OTHERS, SPACE: AFTER_SPACE, BLANK: AFTER_BLANK}[kind]
            emit = CUT
            if kind in (SPACE, BLANK):
                emit = 0 if blank_before else CUT
            elif state == AFTER_SPACE:
                emit = CUT_BEFORE  # the space belongs to this piece, and that begins with it
            elif state == AFTER_BLANK:
                emit = CUT | CUT_BEFORE  # the last blank stands alone
            elif own == state:
                emit = 0
            if kind == QUOTE:
                if state in (QUOTED, IN_OTHERS):
                    own, emit = IN_OTHERS, 0
                elif state != AFTER_SPACE:
                    own = QUOTED
            if state == QUOTED and kind == OTHER:
                emit = 0
            if state == QUOTED and kind in letters:
                own = {SINGLE: FRESH, R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}.get(kind, IN_LETTERS)
                emit = 0 if kind == SINGLE else CUT
            # 're, 've, 'll: known with the second letter; the cut before the first is then taken back
            if (state, kind) in ((QUOTED_R, E_), (QUOTED_V, E_), (QUOTED_L, L)):
                own, emit = FRESH, 4
            elif state in (QUOTED_R, QUOTED_V, QUOTED_L) and kind in letters:
                emit = 0
            nxt[state, kind], cut[state, kind] = own, emit
    return nxt, cut


class Splitter:
    def __init__(self):
        self.classes = character_classes()
        nxt, cut = _splitter_tables()
        self.next = nxt.ravel().astype(np.intp)  # at state * 12 + class
        self.cut = cut.ravel()

    def starts(self, codes: np.ndarray) -> np.ndarray:
        """Places where a piece begins. ``codes`` are code points; -1 ends a text."""
        n = len(codes)
        kinds = np.where(codes < 0, END, self.classes[np.maximum(codes, 0)])
        rows = -(-n // CHUNK)
        grid = np.full(rows * CHUNK, END, np.intp)
        grid[:n] = kinds
        grid = grid.reshape(rows, CHUNK)
        # state map of every chunk: where each state leads
        maps = np.broadcast_to(np.arange(11) * 12, (rows, 11)).copy()
        for k in range(CHUNK):
            maps = self.next[maps + grid[:, k : k + 1]] * 12
        maps //= 12
        # prefix scan: after each round a map spans twice as many chunks
        reach = 1
        while reach < rows:
            maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
            reach *= 2
        state = np.concatenate([[START], maps[:-1, START]]) * 12
        emitted = np.empty((rows, CHUNK), np.uint8)
        for k in range(CHUNK):
            at = state + grid[:, k]
            emitted[:, k] = self.cut[at]
            state = self.next[at] * 12
        emitted = emitted.ravel()[:n]
        begins = (emitted & CUT).astype(bool)
        begins[:-1] |= (emitted[1:] & CUT_BEFORE).astype(bool)
        begins[:-1] &= ~(emitted[1:] & 4).astype(bool)
        return np.flatnonzero(begins)


class PieceCounter:
    """Transducer from the bytes of a piece to its token count.

    The encoding of a prefix ends in one token, and the tokens before it encode the
    rest; so what a further byte does depends only on the last tokens at the places
    where a longer vocabulary string may be going on. A state is the longest suffix
    that such a string begins with, with last token and relative count at those of
    its places. There are finitely many; those that texts reach are compiled.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        special = set(vocab.special.values())
        self.ids = {b: i for i, b in vocab.bytes_of.items() if i not in special}
        self.beginnings = {b[:k] for b in self.ids for k in range(len(b))}
        self.going_on: dict[bytes, list[int]] = {}  # few vocabulary strings that a beginning may become
        for b, i in self.ids.items():
            for k in range(1, len(b)):
                self.going_on.setdefault(b[:k], []).append(i)
        self.going_on = {b: ids for b, ids in self.going_on.items() if len(ids) <= FEW}
        self.fits: dict[tuple[int, int], bool] = {}
        self.alike: dict[tuple, tuple[int, int] | None] = {}
        self._reset()

    def _reset(self) -> None:
        if len(self.alike) > 10 * STATES:
            self.alike.clear()
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[int, tuple[int, int]]] = []
        self._number((b"", ((-1, 0),)))

    def _number(self, state: tuple) -> int:
        found = self.numbers.get(state)
        if found is None:
            found = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        return found

    def _fit(self, left: int, right: int) -> bool:
        """Whether two tokens side by side stay as they are."""
        found = self.fits.get((left, right))
        if found is None:
            vocab = self.vocab
            both = vocab.merge([vocab.single[b] for b in vocab.bytes_of[left] + vocab.bytes_of[right]])
            if len(self.fits) >= 10 * STATES:
                self.fits.clear()
            found = self.fits[left, right] = both == [left, right]
        return found

    def _place(self, begun: bytes, place: tuple[int, int]) -> tuple[int, int] | None:
        """What is left of a place: nothing where no vocabulary string can go on, and
        one token for all that fit the same strings."""
        if begun not in self.beginnings:
            return None
        strings = self.going_on.get(begun)
        if strings is None or place[0] == -1:
            return place
        found = self.alike.get((begun, place[0]), 0)
        if found == 0:
            fit = tuple(self._fit(place[0], i) for i in strings)
            found = self.alike.setdefault((begun, fit), place[0]) if any(fit) else None
            self.alike[begun, place[0]] = found
        return None if found is None else (found, place[1])

    def _compile(self, number: int, byte: int) -> tuple[int, int]:
        """One transition. ``places`` has (last token, count less the state's) for
        every place from the start of the suffix to its end; -1 begins the piece."""
        suffix, places = self.states[number]
        longer = suffix + bytes([byte])
        token = change = None
        for k in range(len(longer)):  # the token that ends here: longest first
            ending = self.ids.get(longer[k:])
            if ending is not None and places[k]:
                before, count = places[k]
                if before == -1 or self._fit(before, ending):
                    token, change = ending, count + 1
                    break
        places = [x and (x[0], x[1] - change) for x in places] + [(token, 0)]
        begun = self.beginnings
        while longer not in begun:
            longer, places = longer[1:], places[1:]
        places = [x and self._place(longer[k:], x) for k, x in enumerate(places)]
        while places[0] is None:
            longer, places = longer[1:], places[1:]
        move = (self._number((longer, tuple(places))), change)
        self.moves[number][byte] = move
        return move

    def count(self, piece: bytes) -> int:
        state = total = 0
        moves = self.moves
        for byte in piece:
            move = moves[state].get(byte)
            if move is None:
                move = self._compile(state, byte)
            state = move[0]
            total += move[1]
        if len(self.states) > STATES:
            self._reset()
        return total


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (multiply and shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class TokenCounter:
    """Token counts of many texts at once."""

    def __init__(self, content: str):
        self.vocab = Vocabulary(content)
        self.splitter = Splitter()
        self.pieces = PieceCounter(self.vocab)
        self.known: dict[int, int] = {}

    def counts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        parts, owners = [], []
        size = 0
        for i, text in enumerate(texts):
            if self.vocab.cut:
                found = self.vocab.cut.findall(text)
                out[i] += len(found)
                pieces = self.vocab.cut.split(text) if found else [text]
            else:
                pieces = [text]
            for piece in pieces:
                if piece:
                    if size and size + len(piece) > BUFFER:
                        self._add(parts, owners, out)
                        parts, owners, size = [], [], 0
                    parts.append(piece)
                    owners.append(i)
                    size += len(piece) + 1
        if parts:
            self._add(parts, owners, out)
        return out

    def _add(self, parts: list[str], owners: list[int], out: np.ndarray) -> None:
        whole = "\n".join(parts) + "\n"  # the places of the ends are known, so the character doesn't matter
        codes = np.frombuffer(whole.encode("utf-32-le"), np.int32).copy()
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        codes[ends] = -1
        starts = self.splitter.starts(codes)
        stops = np.minimum(np.append(starts[1:], len(codes)), ends[np.searchsorted(ends, starts)])
        # equal pieces are counted once: 64-bit sums of powers over the piece, spread, with its length
        power = np.cumprod(np.full(len(codes), 0x9E3779B97F4A7C15, np.uint64))
        inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        back = np.cumprod(np.full(len(codes), inverse, np.uint64))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_mixed(codes.astype(np.uint64)) * power, dtype=np.uint64)])
        keys = _mixed((sums[stops] - sums[starts]) * back[starts] + (stops - starts).astype(np.uint64))
        keys, first, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, count = self.known, self.pieces.count
        each = np.empty(len(keys), np.int64)
        for i, (key, a, b) in enumerate(zip(keys.tolist(), starts[first].tolist(), stops[first].tolist())):
            n = known.get(key)
            if n is None:
                n = known[key] = count(whole[a:b].encode())
            each[i] = n
        per_part = np.bincount(np.searchsorted(ends, starts), weights=each[which], minlength=len(parts)).astype(np.int64)
        np.add.at(out, np.array(owners), per_part)


@lru_cache(maxsize=2)
def counter(content: str) -> TokenCounter:
    return TokenCounter(content)


def count_tokens(docs: DataFrame, path: str, limit: int, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with ``n_bytes, n_tokens, over_limit`` of every whole text.

    Null text counts as empty: no bytes, no tokens, not over the limit. Special
    strings of the vocabulary file inside a text are one token each. Every row is
    worked on by itself, so repeated rows and empty tables need no rule. The
    vocabulary file is read on the driver (its size does not depend on the data),
    broadcast and compiled once per worker.
    """
    held = _broadcast(docs, path)

    def run(batches):
        compiled = counter(held.value)
        for batch in batches:
            sizes, counts, waiting, held_size = [], [], [], 0
            for value in _texts(batch, "_text"):
                sizes.append(len(value.encode()))
                waiting.append(value)
                held_size += len(value)
                if held_size >= BUFFER:
                    counts.append(compiled.counts(waiting))
                    waiting, held_size = [], 0
            counts.append(compiled.counts(waiting))
            n = np.concatenate(counts)
            arrays = [batch.column(c) for c in keep] + [pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    return _mapped(docs, run, keep, text, "n_bytes long, n_tokens long, over_limit boolean")
