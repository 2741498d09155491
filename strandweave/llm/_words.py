"""Words of many texts at once, as arrays over their UTF-8 bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text whose words are hashed at a time, unless one word is longer.
SPAN = 1 << 18
#: An odd multiplier and its inverse modulo 2**64, for polynomial word hashes.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size - 1, _BASE, np.uint64))])
            _INVERSES = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size - 1, _INVERSE, np.uint64))])
    return _POWERS, _INVERSES


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words `[^\\x20\\x09-\\x0D]+`: byte spans, and how many lie before each text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, some words at a time."""
        n, i = len(self.start), 0
        out = np.empty(n, np.uint64)
        while i < n:
            a = int(self.start[i])
            j = max(i + 1, int(np.searchsorted(self.end, a + SPAN, side="right")))
            part, start, end = self.data[a : int(self.end[j - 1])], self.start[i:j] - a, self.end[i:j] - a
            powers, inverses = _tables(len(part) + 1)
            with np.errstate(over="ignore"):
                sums = np.zeros(len(part) + 1, np.uint64)
                np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers[: len(part)], out=sums[1:])
                out[i:j] = mixed((sums[end] - sums[start]) * inverses[start])
            i = j
        return out


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``; none spans two texts."""
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(begins)
    return Words(data, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` consecutive words, starting at every word; the last ones are short and not meant for use."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(hashes), np.uint64)
        for k in range(width):
            total *= np.uint64(0xD6E8FEB86659FD93)
            part = hashes[k:]
            total[: len(part)] += part
        return mixed(total)
