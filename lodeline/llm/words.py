"""Words of whole texts as 64-bit hashes, for many texts at once.

A word's hash is a polynomial over its bytes, taken as the difference of two prefix sums, so that no Python code runs
per word. Bytes stand for random 64-bit values, and the result is mixed with the word's length.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from lodeline.llm.common import SPACES, mix, random_words

_BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64
_STEP = 1 << 20


class Words(NamedTuple):
    """Words of consecutive rows. ``first[i]:first[i + 1]`` are those of the i-th row; offsets are bytes."""

    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


#: All of ASCII but letters and digits: what is left are words without punctuation.
MARKS = tuple(b for b in range(128) if not chr(b).isalnum())


#: First bytes of kana and ideographs; Thai, Lao, Burmese and Khmer begin with E0 or E1 and some second bytes.
UNSPACED = (0xE3, 0xE9)


class Hasher:
    """Splits bytes at white space, or at other bytes, and hashes the words; with ``lower``, A-Z count as a-z.

    With ``unspaced``, each character of a script that puts no space between words is a word.
    """

    def __init__(self, lower: bool, separators: tuple[int, ...] = SPACES, unspaced: bool = False):
        self.unspaced = unspaced
        self.space = np.zeros(256, bool)
        self.space[list(separators)] = True
        self.value = random_words(256, 7)
        if lower:
            self.value[65:91] = self.value[97:123]
        self.value[self.space] = 0
        self.power = self.inverse = np.ones(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            size = max(n, _STEP + 1)
            for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p))

    def _range(self, data: np.ndarray, edges: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = data[a:b]
        space = self.space[x]
        first = np.empty(b - a + 1, bool)  # a word cannot go on across these places
        first[0] = first[-1] = True
        first[1:-1] = space[:-1]
        inner = edges[np.searchsorted(edges, a) : np.searchsorted(edges, b)] - a
        first[inner] = True
        if self.unspaced:
            at = np.flatnonzero((x >= UNSPACED[0]) & (x <= UNSPACED[1]))
            south = np.flatnonzero((x[:-1] == 0xE0) & (x[1:] >= 0xB8) & (x[1:] <= 0xBB) | (x[:-1] == 0xE1) & ((x[1:] == 0x80) | (x[1:] == 0x81) | (x[1:] == 0x9E)))
            at = np.concatenate([at, south])
            first[at] = first[np.minimum(at + 3, b - a)] = True
        last = first[1:].copy()
        last[:-1] |= space[1:]
        # an edge closes the word before it and opens the one after it; white space closes and opens as well
        word = ~space
        start = np.flatnonzero(word & first[:-1])
        end = np.flatnonzero(word & last) + 1
        self._powers(b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(self.value[x] * self.power[: b - a], out=sums[1:])
        h = (sums[end] - sums[start]) * self.inverse[start]
        return start + a, end + a, mix(h + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def words(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        """Words of the rows between ``offsets``, in steps of about a megabyte that end at white space or a row's end."""
        a, stop, parts = int(offsets[0]), int(offsets[-1]), []
        while a < stop:
            b, size = min(stop, a + _STEP), _STEP
            while b < stop:
                cuts = np.flatnonzero(self.space[data[a:b]])
                edge = int(offsets[np.searchsorted(offsets, b, "right") - 1])
                cut = max(a + int(cuts[-1]) + 1 if len(cuts) else a, edge)
                if cut > a:
                    b = cut
                    break
                size *= 2
                b = min(stop, a + size)  # one word longer than a step
            parts.append(self._range(data, offsets, a, b))
            a = b
        if not parts:
            empty = np.zeros(0, np.int64)
            return Words(np.zeros(len(offsets), np.int64), empty, empty, np.zeros(0, np.uint64))
        start, end, h = (np.concatenate(p) for p in zip(*parts))
        return Words(np.searchsorted(start, offsets), start, end, h)


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; empty when there are fewer."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    k = random_words(size, 11) | np.uint64(1)
    out = h[:n] * k[0]
    for j in range(1, size):
        out = out + h[j : n + j] * k[j]
    return mix(out)


def shingle_set(h: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; a shorter text is one shingle of all its words."""
    if not len(h):
        return h
    return np.unique(windows(h, min(size, len(h))) + np.uint64(min(size, len(h))))
