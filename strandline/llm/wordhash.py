"""Vectorised word splitting and hashing over UTF-8 buffers (NumPy)."""

from __future__ import annotations

import numpy as np

#: Bytes between words: space and \x09-\x0D.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Everything but ASCII letters, digits and the bytes of other characters.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

U = np.uint64
BASE_A = U(0x9E3779B97F4A7C15)
BASE_B = U(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inv = base, U(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            up, down = np.full(size, self.base), np.full(size, self.inv)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up[:n], self.down[:n]


_POWERS = {BASE_A: _Powers(BASE_A), BASE_B: _Powers(BASE_B)}
_COEF = np.zeros(0, dtype=np.uint64)


def _coefficients(n: int) -> np.ndarray:
    global _COEF
    if len(_COEF) < n:
        _COEF = mix(np.arange(1, max(n, 256) + 1, dtype=np.uint64) * BASE_A) | U(1)
    return _COEF


class Words:
    """Words of many texts held in one buffer.

    ``buf`` holds the texts with one white-space byte after each; ``text_start`` their
    byte offsets. ``first[t] .. first[t + 1]`` are the words of text ``t``.
    """

    def __init__(self, buf: np.ndarray, text_start: np.ndarray, fold_case: bool = False, between: np.ndarray = _SPACE):
        if fold_case:
            buf = _LOWER[buf]
        word = ~between[buf]
        edge = np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.n = len(self.start)
        self.first = np.append(np.searchsorted(self.start, text_start), self.n)
        self.n_words = np.diff(self.first)
        self.text_of = np.repeat(np.arange(len(text_start)), self.n_words)
        self.pos = np.arange(self.n) - np.repeat(self.first[:-1], self.n_words)
        self.hash = self._hash(buf[word])

    def _hash(self, chars: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.zeros(0, dtype=np.uint64)
        length = self.end - self.start
        at = np.cumsum(length) - length
        offset = np.arange(len(chars)) - np.repeat(at, length)
        coef = _coefficients(int(length.max()))
        h = np.add.reduceat((chars.astype(np.uint64) + U(1)) * coef[offset], at)
        return mix(h + length.astype(np.uint64) * BASE_B)

    def left(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.n_words, self.n_words) - self.pos

    def windows(self, size: int, at: np.ndarray, second: bool = False) -> np.ndarray:
        """Hash of the ``size`` words from each word index in ``at``."""
        base = BASE_B if second else BASE_A
        h = mix(self.hash + base) if second else self.hash
        up, down = _POWERS[base].get(self.n + 1)
        total = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(h * up[: self.n], out=total[1:])
        return mix((total[at + size] - total[at]) * down[at])


def ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Indices start[0] .. start[0] + n[0] - 1, start[1] .. and so on."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def hash_segments(buf: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hash of each stretch of ``buf`` that begins at ``start``; the last ends with ``buf``."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    length = np.diff(np.append(start, len(buf)))
    offset = np.arange(len(buf)) - np.repeat(start, length)
    h = np.add.reduceat((buf.astype(np.uint64) + U(1)) * _coefficients(int(length.max()))[offset], start)
    return mix(h + length.astype(np.uint64) * BASE_B)
