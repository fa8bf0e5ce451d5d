"""Words, word windows and their 64-bit codes, computed for whole slices with numpy.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``, unchanged. Codes are
polynomial sums over the bytes (and over the words of a window) modulo 2^64,
mixed afterwards; equal words and windows always have equal codes.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    """Powers of an odd multiplier and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U)

    def get(self, n: int):
        if len(self.up) < n:
            size = -(-n // _GROW) * _GROW
            for name, b in (("up", self.base), ("down", self.inverse)):
                a = np.full(size, b, dtype=U)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a, out=a))
        return self.up[:n], self.down[:n]


_GROW = 1 << 17
_BYTES, _WORDS = _Powers(0x9E3779B97F4A7C15), _Powers(0xC2B2AE3D27D4EB4F)


def _byte_table(seed: int) -> np.ndarray:
    """What each byte stands for in the sums; the seed alone tells independent codes apart."""
    return mix(np.arange(256 * seed + 1, 256 * seed + 257, dtype=U) * U(0xD6E8FEB86659FD93))


def char_powers(n: int):
    """Powers for sums over ``n`` entries, and their inverses."""
    return _BYTES.get(n)


def window_codes(codes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """The code of the ``size`` entries from each place on, also across texts."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    up, down = _WORDS.get(len(codes))
    sums = np.zeros(len(codes) + 1, dtype=U)
    np.cumsum(codes * up, out=sums[1:])
    return mix((sums[size:] - sums[:n]) * down[:n] + U(seed))


def whole_windows(n: np.ndarray, size: int) -> np.ndarray:
    """True at each place that starts a window of one text; ``n``: the texts' lengths."""
    last = np.cumsum(n)
    total = int(last[-1]) if len(n) else 0
    step = np.zeros(total + 1, dtype=np.int32)
    has = n >= size
    np.add.at(step, (last - n)[has], 1)
    np.add.at(step, last[has] - size + 1, -1)
    return np.cumsum(step)[:max(total - size + 1, 0)] > 0


class Words:
    """The words of a slice of texts: start and end bytes, and each text's word range."""

    def __init__(self, texts: list[bytes]):
        self.buffer = b"\n".join(texts) + b"\n"
        self.bytes = np.frombuffer(self.buffer, dtype=np.uint8)
        space = _SPACE[self.bytes]
        turn = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
        self.start, self.end = turn[0::2], turn[1::2]
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.last = np.searchsorted(self.start, ends)  # one past each text's last word
        self.first = np.concatenate(([0], self.last[:-1]))
        self.n = self.last - self.first

    def codes(self, seed: int = 0) -> np.ndarray:
        table = _byte_table(seed)
        up, down = _BYTES.get(len(self.bytes))
        sums = np.zeros(len(self.bytes) + 1, dtype=U)
        np.cumsum(table[self.bytes] * up, out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start])

    def windows(self, codes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
        """The code of the ``size`` words from each word on; see ``whole`` for which count."""
        return window_codes(codes, size, seed)

    def whole(self, size: int) -> np.ndarray:
        """True at each word that starts a window of ``size`` words of one text."""
        return whole_windows(self.n, size)

    def doc(self) -> np.ndarray:
        """The index of the text of each word."""
        return np.repeat(np.arange(len(self.n)), self.n)


def least_in_window(values: np.ndarray, width: int) -> np.ndarray:
    """Offset of the leftmost smallest of ``width`` values from each place on."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    low, have = values, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    offset = np.zeros(n, dtype=np.int64)
    for o in range(width - 1, -1, -1):
        offset[values[o:o + n] == low] = o
    return offset


def span_codes(codes: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """The code of the words ``start:end`` (equal word sequences have equal codes)."""
    up, down = _WORDS.get(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=U)
    np.cumsum(codes * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + U(seed))


def shingles(words: Words, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Codes of every text's ``size``-word shingles, text by text, and their numbers.

    A text of one to ``size - 1`` words has one shingle: all its words.
    """
    codes = words.codes(seed)
    windows, whole = words.windows(codes, size, seed), words.whole(size)
    n = np.maximum(words.n - size + 1, (words.n > 0).astype(np.int64))
    out = np.empty(int(n.sum()), dtype=U)
    first = np.cumsum(n) - n
    short = np.flatnonzero((words.n > 0) & (words.n < size))
    is_short = np.zeros(len(out), dtype=bool)
    is_short[first[short]] = True
    out[~is_short] = windows[whole]
    out[is_short] = span_codes(codes, words.first[short], words.last[short], seed)
    return out, n
