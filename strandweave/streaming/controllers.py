"""Controllers: keyed state machines over samples of several signals at one time.

A step is a row (key, t_us, signals) with signals a map from name to value.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from strandweave.errors import CausalityError

SEEK, GROOM, FEED, RESUME = "SEEK", "GROOM", "FEED", "RESUME"


class Arbiter:
    """Grooming goes before feeding, feeding before seeking; each begins above its trigger and ends below its
    release, grooming is followed by a pause."""

    def __init__(self, groom: tuple[float, float], feed: tuple[float, float], pause_us: int):
        self.groom, self.feed, self.pause_us = groom, feed, pause_us

    def next_state(self, state: str, since: int, t: int, signals: dict[str, float]) -> str:
        groom, feed = signals.get("groom", 0.0), signals.get("feed", 0.0)
        if state != GROOM and groom >= self.groom[0]:
            return GROOM
        if state == GROOM:
            return GROOM if groom > self.groom[1] else RESUME
        if state == RESUME:
            return RESUME if t - since < self.pause_us else SEEK
        if state == FEED:
            return FEED if feed > self.feed[1] else SEEK
        return FEED if feed >= self.feed[0] else SEEK

    #: State before the first step: name and the time it began.
    start = (SEEK, 0)
    columns = "state string, changed boolean"

    def step(self, state: tuple, t: int, signals: dict[str, float]) -> tuple[tuple, tuple]:
        now, since = state
        new = self.next_state(now, since, t, signals)
        return (new, since if new == now else t), (new, new != now)

    def run(self, steps: DataFrame) -> DataFrame:
        """(key, t_us, state, changed): for batches and streams alike one state machine for each key."""
        return _driven(self, steps, "state string, since bigint")


QUIESCENT, WATCHING, MOVING = "QUIESCENT", "WATCHING", "MOVING"


class Steering:
    """Forward and turning drive from the signals ``left`` and ``right`` alone.

    After ``quiet_us`` the decoder watches; once their mean has been at or above ``threshold`` for ``hold_us``, it moves: forward
    is mean / (mean + half), the turn gain times their difference over ``most``, within one either way.
    """

    start = (QUIESCENT, None)
    columns = "state string, forward double, turn double"

    def __init__(self, quiet_us: int, threshold: float, hold_us: int, half: float, gain: float, most: float):
        self.quiet_us, self.threshold, self.hold_us, self.half, self.gain, self.most = quiet_us, threshold, hold_us, half, gain, most

    def step(self, state: tuple, t: int, signals: dict[str, float]) -> tuple[tuple, tuple]:
        now, above = state
        left, right = signals.get("left", 0.0), signals.get("right", 0.0)
        drive = (left + right) / 2
        if now == QUIESCENT:
            now = WATCHING if t >= self.quiet_us else now
        elif now == WATCHING:
            if drive < self.threshold:
                above = None
            elif above is None:
                above = t
            elif t - above >= self.hold_us:
                now = MOVING
        forward = turn = 0.0
        if now == MOVING:
            forward = drive / (drive + self.half) if drive > 0 else 0.0
            turn = max(-1.0, min(1.0, self.gain * (left - right) / self.most))
        return (now, above), (now, forward, turn)

    def run(self, steps: DataFrame) -> DataFrame:
        """(key, t_us, state, forward, turn), for batches and streams alike."""
        return _driven(self, steps, "state string, above bigint")


def _driven(machine, steps: DataFrame, held: str) -> DataFrame:
    """Steps (key, t_us, signals) along each key; going back in time raises.  A batch is sorted by key and time and the state
    carried from one record batch to the next; a stream keeps it in its store."""
    columns = machine.columns
    names = ["key", "t_us", *[c.split()[0] for c in columns.split(", ")]]

    def each(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, *now = state.get if state.exists else (-1, *machine.start)
        rows = []
        frame = pd.concat(list(batches)).sort_values("t_us", kind="stable")
        for t, signals in zip(frame["t_us"].tolist(), frame["signals"].tolist(), strict=True):
            if t < last:
                raise CausalityError(f"key {key[0]}: step at {t} after {last}")
            now, out = machine.step(tuple(now), t, dict(signals))
            rows.append((key[0], t, *out))
            last = t
        state.update((last, *now))
        yield pd.DataFrame(rows, columns=names)

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, now = None, machine.start
        for batch in batches:
            rows = []
            for key, t, signals in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if before is None or key != before[0]:
                    now = machine.start
                before = (key,)
                now, out = machine.step(now, t, dict(signals or ()))
                rows.append((key, t, *out))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    kind = steps.schema["key"].dataType.simpleString()
    if steps.isStreaming:
        return steps.groupBy("key").applyInPandasWithState(each, f"key {kind}, t_us bigint, {columns}", f"last bigint, {held}", "append", GroupStateTimeout.NoTimeout)
    kinds = [f.type for f in to_arrow_schema(StructType.fromDDL(f"key {kind}, t_us bigint, {columns}"))]
    own = steps.select("key", F.col("t_us").cast("bigint"), "signals").repartition("key").sortWithinPartitions("key", "t_us")
    return own.mapInArrow(along, f"key {kind}, t_us bigint, {columns}")


def steering(left: float, right: float, gain: float, limit: float) -> float:
    """Turn towards the stronger side: gain times their index, clipped; 0 when both are silent."""
    total = left + right
    return max(-limit, min(limit, gain * (left - right) / total)) if total > 0 else 0.0
