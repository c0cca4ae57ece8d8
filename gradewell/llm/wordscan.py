"""Words of many texts at once, as numpy arrays over one byte buffer.

A word is a run of digits, letters a-z (A-Z lowered) and bytes from 0x80 up, that is the
pattern ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` over the lowered text. Word hashes are 64-bit
polynomials of the word's bytes, mixed; equal words have equal hashes.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


def _lowered_word_bytes() -> np.ndarray:
    table = np.zeros(256, dtype=np.uint8)
    for b in range(256):
        c = b + 32 if 0x41 <= b <= 0x5A else b
        if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80:
            table[b] = c
    return table


LOWER = _lowered_word_bytes()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


with np.errstate(over="ignore"):
    _VALUE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_BASE = U(0x5851F42D4C957F2D)
_BASE_INVERSE = U(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_POWERS = [np.ones(1, dtype=U), np.ones(1, dtype=U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            x = np.full(size, base, dtype=U)
            x[0] = 1
            _POWERS[k] = np.cumprod(x, dtype=U)
    return _POWERS[0][:n], _POWERS[1][:n]


class Words:
    """Words of a list of texts.

    first, stop: byte range of each word in ``data``; hash: its hash; doc: index of its text;
    begin[i]: index of text i's first word (len(texts) + 1 entries); at[i]: its first byte.
    """

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        low = LOWER[self.data]
        edge = np.diff((low > 0).view(np.int8), prepend=np.int8(0))
        self.first = np.flatnonzero(edge == 1)
        self.stop = np.flatnonzero(edge == -1)
        self.begin = np.searchsorted(self.first, self.at)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.begin))
        power, inverse = _powers(len(low) + 1)
        prefix = np.empty(len(low) + 1, dtype=U)
        prefix[0] = 0
        np.cumsum(_VALUE[low] * power[: len(low)], out=prefix[1:], dtype=U)
        self.hash = mix((prefix[self.stop] - prefix[self.first]) * inverse[self.first])

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each run of n words that lies in one text."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U)
        total = self.hash[:m].copy()
        factor = 1
        for k in range(1, n):
            factor = factor * 0x2545F4914F6CDD1D % (1 << 64)
            total += self.hash[k : k + m] * U(factor)
        inside = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        return inside, mix(total[inside])

    def words(self, first: int, n: int) -> list[bytes]:
        """The lowered words from one on."""
        return [
            LOWER[self.data[a:b]].tobytes() for a, b in zip(self.first[first : first + n], self.stop[first : first + n])
        ]
