"""State carried along ordered rows, in parallel: a prefix scan over range partitions.

A step along a key (a filter, a refractory rule, a run) maps the state before a row to the
state behind it.  Rows are sorted by range partition of key and order, so one key of any
length is spread over all tasks.  Each partition first composes the maps of its rows into
one; those few maps, one a partition, give the state in which each partition begins; then
all partitions are gone through again with the states known.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.operators.ordered import cut

Columns = dict[str, pa.Array]


class Scan(Protocol):
    """How a state goes along the rows of one key.  ``start`` is the state before a key's first row."""

    start: Any

    def map_of(self, rows: Columns) -> Any:
        """What these consecutive rows of one key do to a state."""

    def compose(self, first: Any, then: Any) -> Any:
        """The map of ``first`` and ``then``, one behind the other."""

    def after(self, state: Any, step: Any) -> Any:
        """The state behind the rows of a map."""

    def apply(self, state: Any, rows: Columns) -> pa.RecordBatch:
        """Output for these rows, which begin in ``state``: any number of rows, all columns but the key."""


def _same(a: Any, b: Any) -> bool:
    return a == b or (a != a and b != b)


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[Any, Columns, pa.Array]]:
    """Key, rows and key column of each stretch of one key in a batch."""
    key = batch.column("key")
    if not len(key):
        return
    behind, before = key[1:], key[:-1]
    # Null keys are alike, and so are those that are not numbers.
    same = pc.or_(pc.fill_null(pc.equal(behind, before), False), pc.and_(pc.is_null(behind, nan_is_null=True), pc.is_null(before, nan_is_null=True)))
    edges = [0, *(np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1).tolist(), len(key)]
    names = [c for c in batch.schema.names if c not in ("key", "_part", "_state")]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield key[a].as_py(), {c: batch.column(c)[a:b] for c in names}, key[a:b]


def along(rows: DataFrame, order: str, scan: Scan, schema: str) -> DataFrame:
    """(key, and the columns of ``schema`` that ``scan`` gives) for rows with ``key``, ``order`` and any other columns.

    Rows of one key and equal order follow each other anyhow.  Null keys are one key.  An empty table gives an empty one.
    """
    kind = rows.schema["key"].dataType.simpleString()
    sorted_rows = rows.repartitionByRange("key", order).sortWithinPartitions("key", order)
    parts = cut(sorted_rows.withColumn("_part", F.spark_partition_id()))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partition, its first and last key, whether it has that one alone, and the map of its last key's rows."""
        part, first, last, alone, step, keys = None, None, None, True, None, None
        for batch in batches:
            for key, own, column in _stretches(batch):
                if part is None:
                    part, first = batch.column("_part")[0].as_py(), column[:1]
                elif not _same(key, keys):
                    alone, step = False, None
                mine = scan.map_of(own)
                step = mine if step is None else scan.compose(step, mine)
                keys, last = key, column[:1]
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), first, last, pa.array([alone]), pa.array([pickle.dumps(step)], pa.binary())], names=["_part", "first", "last", "alone", "step"])

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partition and the state in which it begins, of the maps in the partitions' order."""
        key, state, known = None, scan.start, False
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                state = state if known and _same(key, r["first"]) else scan.start
                out.append((r["_part"], pickle.dumps(state)))
                state = scan.after(state if r["alone"] else scan.start, pickle.loads(r["step"]))
                key, known = r["last"], True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([s for _, s in out], pa.binary())], names=["_part", "_state"])

    maps = parts.mapInArrow(summed, f"_part int, first {kind}, last {kind}, alone boolean, step binary")
    # One row for each partition.
    states = maps.coalesce(1).sortWithinPartitions("_part").mapInArrow(begun, "_part int, _state binary")

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, begun_here = None, None, False
        for batch in batches:
            for now, own, column in _stretches(batch):
                if not begun_here:
                    state, begun_here = pickle.loads(batch.column("_state")[0].as_py()), True
                elif not _same(now, key):
                    state = scan.start
                key = now
                out = scan.apply(state, own)
                state = scan.after(state, scan.map_of(own))
                if out.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array([now] * out.num_rows, column.type) if out.num_rows != len(column) else column, *out.columns], names=["key", *out.schema.names])

    return parts.join(F.broadcast(states), "_part").mapInArrow(applied, f"key {kind}, {schema}")


def _floats(column: pa.Array) -> np.ndarray:
    """Nulls as NaN."""
    return column.to_numpy(zero_copy_only=False).astype(np.float64)


class Affine:
    """r = r * a + x * (1 - a), from 0; a null sample leaves r as it is."""

    def __init__(self, a: float, order: str, out: str):
        self.a, self.order, self.out, self.start = a, order, out, 0.0

    def filtered(self, x: np.ndarray, state: float) -> np.ndarray:
        """The state and those behind the steps r -> r * a + x, one after the other, so that all rows round alike."""
        a = self.a
        return np.array(list(itertools.accumulate(x.tolist(), lambda r, y: r * a + y, initial=state)))

    def map_of(self, rows: Columns) -> tuple[float, float]:
        x = _floats(rows["x"])
        x = x[~np.isnan(x)] if rows["x"].null_count else x
        return (float(self.a) ** len(x), float(self.filtered(x * (1 - self.a), 0.0)[-1]))

    def compose(self, first: tuple[float, float], then: tuple[float, float]) -> tuple[float, float]:
        return first[0] * then[0], first[1] * then[0] + then[1]

    def after(self, state: float, step: tuple[float, float]) -> float:
        return state * step[0] + step[1]

    def apply(self, state: float, rows: Columns) -> pa.RecordBatch:
        x = _floats(rows["x"])
        there = rows["x"].is_valid().to_numpy(zero_copy_only=False)
        r = self.filtered(x[there] * (1 - self.a), state)[np.cumsum(there)]
        return pa.RecordBatch.from_arrays([rows[self.order], pa.array(r)], names=[self.order, self.out])


class Refractory:
    """Events are taken from the first on, each more than ``span`` behind the last one taken.

    The state is the last place that is still barred.  A map is (limits, barred): a state takes the entry of the first limit
    beyond it, and stays as it is beyond all limits.  Of events within ``span`` of the first one few kinds of outcome are left.
    """

    def __init__(self, span: int):
        self.span, self.start = span, -(2**62)

    def map_of(self, rows: Columns) -> tuple[np.ndarray, np.ndarray]:
        at = rows["i"].to_numpy()
        # Only these can be the first one taken, whatever was taken before.
        heads = int(np.searchsorted(at, at[0] + self.span, side="right"))
        heads = min(len(at), heads + 1)
        follow = np.append(np.searchsorted(at, at + self.span, side="right"), len(at))
        last = np.append(np.arange(len(at)), len(at))
        # The last one taken behind each, by jumps of doubled length.
        while (follow[:-1] < len(at)).any():
            last = np.where(follow < len(at), last[np.minimum(follow, len(at))], last)
            follow = follow[follow]
        return self._short(at[:heads], at[last[:heads]] + self.span)

    def _short(self, limits: np.ndarray, barred: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = np.append(barred[1:] != barred[:-1], True) if len(barred) else np.zeros(0, bool)
        return limits[keep], barred[keep]

    def compose(self, first: tuple[np.ndarray, np.ndarray], then: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        barred = np.array([self.after(int(b), then) for b in first[1]], np.int64)
        beyond = then[0] > (first[0][-1] if len(first[0]) else self.start)
        return self._short(np.concatenate([first[0], then[0][beyond]]), np.concatenate([barred, then[1][beyond]]))

    def after(self, state: int, step: tuple[np.ndarray, np.ndarray]) -> int:
        k = int(np.searchsorted(step[0], state, side="right"))
        return int(step[1][k]) if k < len(step[0]) else state

    def apply(self, state: int, rows: Columns) -> pa.RecordBatch:
        at, taken = rows["i"].to_numpy(), []
        k = int(np.searchsorted(at, state, side="right"))
        while k < len(at):
            taken.append(k)
            k = int(np.searchsorted(at, at[k] + self.span, side="right"))
        chosen = pa.array(taken, pa.int64())
        return pa.RecordBatch.from_arrays([c.take(chosen) for c in rows.values()], names=list(rows))


class Sustained:
    """Length of the longest stretch where ``ok`` holds; each such sample adds the time since the one before it.

    The state is (time of the last sample, length of the stretch it ends, longest so far).
    """

    def __init__(self):
        self.start = (None, 0, 0)

    def map_of(self, rows: Columns) -> tuple:
        """First and last time, lengths at the start and the end, longest inside, whether all and whether the first holds."""
        t, ok = rows["t_us"].to_numpy(), rows["ok"].to_numpy(zero_copy_only=False)
        own = np.where(ok, np.diff(t, prepend=t[0]), 0)
        total = np.concatenate([[0], np.cumsum(own)])
        # The sum up to the last sample that does not hold, before each sample.
        broken = np.maximum.accumulate(np.where(ok, 0, total[1:]))
        runs = np.where(ok, total[1:] - broken, 0)
        head = int(np.argmin(ok)) if not ok.all() else len(ok)
        return int(t[0]), int(t[-1]), int(total[head]), int(runs[-1]), int(runs.max()), bool(ok.all()), bool(ok[0])

    def compose(self, first: tuple, then: tuple) -> tuple:
        gap = then[0] - first[1] if then[6] else 0
        joined = first[3] + gap + then[2] if then[6] else 0
        head = first[2] + gap + then[2] if first[5] and then[6] else first[2]
        return first[0], then[1], head, (joined if then[5] else then[3]), max(first[4], then[4], joined), first[5] and then[5], first[6]

    def after(self, state: tuple, step: tuple) -> tuple:
        before, run, best = state
        gap = step[0] - before if before is not None and step[6] else 0
        joined = run + gap + step[2] if step[6] else 0
        return step[1], (joined if step[5] else step[3]), max(best, joined, step[4])

    def apply(self, state: tuple, rows: Columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([self.after(state, self.map_of(rows))[2]], pa.int64())], names=["sustained_us"])


class Unwrapped:
    """Angle without jumps: the first one and the sum of differences wrapped to half a turn each way; null angles are passed over.

    The state is (last angle, its unwrapped value).
    """

    def __init__(self, out: str):
        self.out, self.start = out, (None, 0.0)

    @staticmethod
    def _wrapped(d):
        return d - 2 * np.pi * np.floor((d + np.pi) / (2 * np.pi))

    def map_of(self, rows: Columns) -> tuple | None:
        """First and last angle, and the sum of the steps between them."""
        x = _floats(rows["angle"].drop_null())
        return (float(x[0]), float(x[-1]), float(self._wrapped(np.diff(x)).sum())) if len(x) else None

    def compose(self, first: tuple | None, then: tuple | None) -> tuple | None:
        if first is None or then is None:
            return first if then is None else then
        return first[0], then[1], first[2] + float(self._wrapped(then[0] - first[1])) + then[2]

    def after(self, state: tuple, step: tuple | None) -> tuple:
        if step is None:
            return state
        begun = step[0] if state[0] is None else state[1] + float(self._wrapped(step[0] - state[0]))
        return step[1], begun + step[2]

    def apply(self, state: tuple, rows: Columns) -> pa.RecordBatch:
        column = rows["angle"]
        there = column.is_valid().to_numpy(zero_copy_only=False)
        x = _floats(column)[there]
        out = np.full(len(column), np.nan)
        if len(x):
            begun = x[0] if state[0] is None else state[1] + self._wrapped(x[0] - state[0])
            out[there] = begun + np.concatenate([[0.0], np.cumsum(self._wrapped(np.diff(x)))])
        names = [c for c in rows if c != self.out]
        return pa.RecordBatch.from_arrays([*(rows[c] for c in names), pa.array(out, mask=~there)], names=[*names, self.out])


class LastSeen:
    """Adds ``out``, the last value of ``column`` that is not null up to each row."""

    def __init__(self, column: str, out: str):
        self.column, self.out, self.start = column, out, None

    def map_of(self, rows: Columns) -> Any:
        known = rows[self.column].drop_null()
        return known[-1].as_py() if len(known) else None

    def compose(self, first: Any, then: Any) -> Any:
        return first if then is None else then

    def after(self, state: Any, step: Any) -> Any:
        return state if step is None else step

    def apply(self, state: Any, rows: Columns) -> pa.RecordBatch:
        own = rows[self.column]
        filled = pc.fill_null_forward(own)
        filled = filled if state is None else pc.fill_null(filled, pa.scalar(state, own.type))
        return pa.RecordBatch.from_arrays([*rows.values(), filled], names=[*rows, self.out])
