"""Words of a text as 64-bit hashes, whole texts at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15
STRETCH = 1 << 20  # bytes of a text worked on at once
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _table(keep) -> np.ndarray:
    return np.array([keep(b) for b in range(256)], bool)


# Anything but ASCII white space.
NO_BLANKS = _table(lambda b: b not in b" \t\n\x0b\x0c\r")
# Bytes of a word: ASCII letters and digits, and every byte of a non-ASCII character.
WORD_BYTES = _table(lambda b: b >= 128 or chr(b).isalnum())


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (multiply and shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, n: int) -> np.ndarray:
    have = _powers[name]
    if len(have) < n:
        base = _BASE if name == "up" else pow(_BASE, -1, 1 << 64)
        steps = np.full(max(n, 2 * len(have)), np.uint64(base))
        steps[0] = 1
        have = _powers[name] = np.cumprod(steps)
    return have[:n]


_SPREAD = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def spans(data: np.ndarray, kind: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes of a kind. Long data are gone through in
    stretches, so what is held besides the result does not grow with them."""
    if len(data) <= STRETCH:
        edge = np.flatnonzero(np.diff(np.concatenate([[False], kind[data], [False]]).view(np.int8)))
        return edge[::2], edge[1::2]
    edges, last = [], np.zeros(1, bool)
    for a in range(0, len(data), STRETCH):
        inside = np.concatenate([last, kind[data[a : a + STRETCH]]])
        edges.append(np.flatnonzero(np.diff(inside.view(np.int8))) + a)
        last = inside[-1:]
    if last[0]:
        edges.append(np.array([len(data)]))
    edge = np.concatenate(edges)
    return edge[::2], edge[1::2]


def hashes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every span (in order): sums of powers over its bytes, spread. Sums are
    carried on from stretch to stretch; what is held does not grow with the data."""
    size = (ends - starts).astype(np.uint64)
    if len(data) <= STRETCH:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_SPREAD[data] * _power("up", len(data)), out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * _power("down", len(data) + 1)[starts] + size)
    low, high = np.zeros(len(starts), np.uint64), np.zeros(len(ends), np.uint64)  # sums up to a start, up to an end
    down = np.ones(len(starts), np.uint64)
    carried = np.uint64(0)
    for a in range(0, len(data), STRETCH):
        part = data[a : a + STRETCH]
        scale, back = (np.uint64(pow(x, a, 1 << 64)) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_SPREAD[part] * _power("up", len(part)), out=sums[1:])
        sums = sums * scale + carried
        carried = sums[-1]
        i, j = np.searchsorted(starts, [a, a + len(part)])
        low[i:j] = sums[starts[i:j] - a]
        down[i:j] = _power("down", len(part) + 1)[starts[i:j] - a] * back
        i, j = np.searchsorted(ends, [a + 1, a + len(part) + 1])
        high[i:j] = sums[ends[i:j] - a]
    return mixed((high - low) * down + size)


def lower_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)


def pieces(texts: Iterable[bytes], kind: np.ndarray = WORD_BYTES, size: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``data, starts, rows``: whole texts one after the other in stretches of about
    ``size`` bytes, with the place where each text begins and its number. A longer text is cut
    between words (a word that is longer itself stays whole), so what a stretch takes
    is bounded however long texts are."""
    held, starts, rows, n = [], [], [], 0
    for i, raw in enumerate(texts):
        if held and n + len(raw) > size:
            yield np.frombuffer(b"".join(held), np.uint8), np.array(starts), np.array(rows)
            held, starts, rows, n = [], [], [], 0
        if len(raw) <= size:
            held += [raw, b"\n"]
            starts.append(n)
            rows.append(i)
            n += len(raw) + 1
            continue
        data, a = np.frombuffer(raw, np.uint8), 0
        while a < len(data):
            b = min(a + size, len(data))
            if b < len(data):
                gaps = np.flatnonzero(~kind[data[a:b]])
                if len(gaps):
                    b = a + int(gaps[-1]) + 1
                while b < len(data) and kind[data[b - 1]]:  # one word fills the stretch
                    gaps = np.flatnonzero(~kind[data[b : b + size]])
                    b = b + int(gaps[0]) + 1 if len(gaps) else min(b + size, len(data))
            yield data[a:b], np.zeros(1, np.int64), np.array([i])
            a = b
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.array(starts), np.array(rows)


def rows_and_hashes(texts: Iterable[bytes], kind: np.ndarray = WORD_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``row, hash`` of the words of texts, in order, a stretch at a time."""
    for data, starts, rows in pieces(texts, kind):
        a, b = spans(data, kind)
        yield rows[np.searchsorted(starts, a, side="right") - 1], hashes_of(data, a, b)


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words between white space, without
    case; a shorter text has one run of all its words, a text without words none."""
    data = lower_bytes(text)
    words = hashes_of(data, *spans(data, NO_BLANKS))
    if not len(words):
        return words
    n = min(n, len(words))
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total = total * np.uint64(_BASE) + words[k : len(words) - n + 1 + k]
    return np.unique(mixed(total + np.uint64(n)))
