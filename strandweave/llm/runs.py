"""Periodic runs of words by the runs theorem.

Every run (a maximal stretch whose smallest period fits into it twice) holds, in one
of the two orders of its words, a longest Lyndon word that is one period long.  The
longest Lyndon word at a place ends before the next place whose suffix is smaller, so
next-smaller values of the inverse suffix array give the candidates of one order, and
next-larger ones those of the other.  Each candidate is extended to the right by the
longest common prefix of two suffixes and to the left by that of the reversed text; both
are range minima over the array of neighbouring suffixes' common prefixes, which a
sparse table over blocks answers.

Many texts are handled at once: each ends with a mark of its own, so no comparison
leaves a text.  The suffix array comes from prefix doubling of what is not yet told
apart, and the common prefixes are noted when two groups part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm._common import pieces_by_bytes, utf8_of
from strandweave.llm._words import Words, words_of

LEAST_LENGTH = 12
_FAR = np.int32(2**31 - 1)


class RangeMin:
    """Minima of ranges of an array: within blocks by running minima, over whole blocks by a sparse table."""

    SHIFT = 4

    def __init__(self, values: np.ndarray):
        size = 1 << self.SHIFT
        self.values = np.full(max(1, -(-len(values) // size)) * size, _FAR, np.int32)
        self.values[: len(values)] = values
        blocks = self.values.reshape(-1, size)
        self.upto = np.minimum.accumulate(blocks, 1).ravel()
        self.onward = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        levels = [blocks.min(1)]
        while 2 << (len(levels) - 1) <= len(blocks):
            half, last = 1 << (len(levels) - 1), levels[-1]
            wider = last.copy()
            wider[:-half] = np.minimum(last[:-half], last[half:])
            levels.append(wider)
        self.levels = np.stack(levels)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least value from place ``a`` to place ``b``, both counted; ``a <= b``."""
        first, last = a >> self.SHIFT, b >> self.SHIFT
        out = np.minimum(self.onward[a], self.upto[b])
        gap = np.flatnonzero(last - first > 1)
        if len(gap):
            lo, width = first[gap] + 1, (last - first)[gap] - 1
            level = np.frexp(width.astype(np.float64))[1] - 1
            out[gap] = np.minimum(out[gap], np.minimum(self.levels[level, lo], self.levels[level, lo + width - (1 << level.astype(np.int64))]))
        same = np.flatnonzero(first == last)
        if len(same):
            low, x, y = np.full(len(same), _FAR, np.int32), a[same], b[same]
            for t in range(int((y - x).max()) + 1):
                low = np.minimum(low, self.values[np.minimum(x + t, y)])
            out[same] = low
        return out


def suffixes(symbols: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, RangeMin]:
    """Inverse suffix array, and range minima over the common prefixes of neighbouring suffixes.

    ``symbols`` are positive but for a 0 at the end of each text; ``text`` numbers the texts, which lie one after the other.
    """
    n = len(symbols)
    key = text * (int(symbols.max(initial=0)) + 1) + symbols
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    common = np.where(new, 0, _FAR).astype(np.int32)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    # Places of the order whose suffix shares its group with others; a group's rank is its first place.
    active = np.flatnonzero(~(new & np.append(new[1:], True)))
    h = 1
    while len(active):
        at = order[active]
        pair = rank[at] * n + rank[at + h]
        by = np.argsort(pair)
        at, pair = at[by], pair[by]
        order[active] = at
        new = np.ones(len(at), bool)
        new[1:] = pair[1:] != pair[:-1]
        parted = np.flatnonzero(new[1:] & (pair[1:] // n == pair[:-1] // n)) + 1
        if len(parted):
            # Two neighbours agree in h symbols and then as far as what follows them, whose groups have parted before.
            left, right = pair[parted - 1] % n, pair[parted] % n
            common[active[parted]] = h + RangeMin(common).of(left + 1, right)
        rank[at] = np.maximum.accumulate(np.where(new, active, 0))
        active = active[~(new & np.append(new[1:], True))]
        h *= 2
    return rank, RangeMin(common)


def next_smaller(values: list[int]) -> list[int]:
    """For each place the first one behind it with a smaller value, or the number of places."""
    found, waiting = [len(values)] * len(values), []
    for i, v in enumerate(values):
        while waiting and values[waiting[-1]] > v:
            found[waiting.pop()] = i
        waiting.append(i)
    return found


def runs_of(symbols: np.ndarray, first: np.ndarray, least: int = LEAST_LENGTH) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of at least ``least`` symbols, by text, start and period.

    ``symbols`` are positive, ``first`` the offsets of the texts (length texts + 1); starts count from the text's first symbol.
    """
    count = np.diff(first)
    texts = len(count)
    # A mark behind each text.
    opens = first[:-1] + np.arange(texts)
    text = np.repeat(np.arange(texts), count + 1)
    marked = np.zeros(len(symbols) + texts, np.int64)
    marked[np.arange(len(symbols)) + np.repeat(np.arange(texts), count)] = symbols
    if not len(symbols):
        return np.zeros((0, 4), np.int64)
    rank, common = suffixes(marked, text)
    ends = opens + count
    starts, roots = [], []
    for sign in (1, -1):
        value = sign * rank
        value[ends] = -len(marked)  # no Lyndon word leaves its text
        behind = np.array(next_smaller(value.tolist()), np.int64)
        # In one root at least of each run, the word behind it equals its first one.
        i = np.flatnonzero(marked > 0)
        i = i[marked[i] == marked[np.minimum(behind[i], len(marked) - 1)]]
        starts.append(i)
        roots.append(behind[i])
    i, j = np.concatenate(starts), np.concatenate(roots)
    if not len(i):
        return np.zeros((0, 4), np.int64)
    right = common.of(np.minimum(rank[i], rank[j]) + 1, np.maximum(rank[i], rank[j]))
    del rank, common
    left = np.zeros(len(i), np.int64)
    inner = np.flatnonzero((i > opens[text[i]]) & (marked[i - 1] == marked[j - 1]))
    if len(inner):
        # The reversed texts that these lie in, one after the other, each with its mark.
        used = np.unique(text[i[inner]])
        own = np.concatenate([[0], np.cumsum(count[used] + 1)])
        number = np.repeat(np.arange(len(used)), count[used] + 1)
        place = np.arange(own[-1]) - own[number]
        back = np.zeros(own[-1], np.int64)
        word = place < count[used][number]
        back[word] = marked[ends[used][number[word]] - 1 - place[word]]
        rank, common = suffixes(back, number)
        k = np.searchsorted(used, text[i[inner]])
        a, b = (rank[own[k] + ends[used[k]] - x[inner]] for x in (i, j))
        left[inner] = common.of(np.minimum(a, b) + 1, np.maximum(a, b))
    period = j - i
    start, length = i - left, left + period + right
    good = length >= np.maximum(least, 2 * period)
    rows = np.unique(np.stack([text[i], start - opens[text[i]], period, length], 1)[good], axis=0)
    return rows[:, [0, 1, 3, 2]]


def _joined(found: Words, source: np.ndarray, kept: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words with one space between them, and the offsets of the texts."""
    word = source[kept]
    size = found.end[word] - found.start[word] + 1
    upto = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(upto[-1], np.uint8)
    inside = np.ones(upto[-1], bool)
    inside[upto[1:] - 1] = False
    out[inside] = found.data[(np.arange(upto[-1]) + np.repeat(found.start[word] - upto[:-1], size))[inside]]
    out[~inside] = 0x20
    bounds = upto[np.searchsorted(kept, first)]
    # The space behind a text's last word goes.
    some = np.diff(bounds) > 0
    stay = np.ones(len(out), bool)
    stay[bounds[1:][some] - 1] = False
    return out[stay], bounds - np.concatenate([[0], np.cumsum(some)])


Rewrite = Callable[[pa.Array, np.ndarray], np.ndarray]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, rewrite: Rewrite | None = None) -> DataFrame:
    """(id, n_runs, runs, collapsed) for each row of ``docs``.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0.  ``runs`` has (start, length, period) of every maximal stretch of words with
    smallest period q and at least ``least`` and 2 * q words, by start and period.  ``collapsed`` has the words that no run
    contains behind its first q words, joined by one space.  ``rewrite(ids, first)`` may name, for each place of the
    texts whose words begin at ``first``, the number (over all of them) of the word that stands there instead.

    Null texts and texts without words have no runs and an empty ``collapsed``.  Repeated rows and null ids are handled like any
    others, and an empty table gives an empty one.  Other columns of ``docs`` are not used.  Words are told apart by 64-bit
    hashes.  A text of any length is one row and one task's work.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    frame = docs.select(F.col(id_col).alias("_sw_id"), F.col(text_col).alias("_sw_text"))
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for big in batches for piece in pieces_by_bytes(big, "_sw_text")):
            ids = batch.column(0)
            data, offsets = utf8_of(batch.column(1))
            found = words_of(data, offsets)
            first = found.first
            source = np.arange(len(found.start)) if rewrite is None else rewrite(ids, first)
            symbols = np.unique(found.hashes(), return_inverse=True)[1][source] + 1
            rows = runs_of(symbols, first, least)
            # Starts and ends of what goes, summed along the words.
            edge = np.zeros(len(symbols) + 1, np.int64)
            begin = first[rows[:, 0]] + rows[:, 1]
            np.add.at(edge, begin + rows[:, 3], 1)
            np.add.at(edge, begin + rows[:, 2], -1)
            kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
            text, bounds = _joined(found, source, kept, first)
            upto = np.searchsorted(rows[:, 0], np.arange(len(ids) + 1))
            lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, c])) for c in (1, 2, 3)], fields=list(item)))
            collapsed = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(text)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(upto), pa.int64()), lists, collapsed], names=[id_col, "n_runs", "runs", "collapsed"])

    return frame.mapInArrow(run, f"`{id_col}` {kind}, n_runs bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
