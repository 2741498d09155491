"""Short-term plasticity of a synapse: seven families as settings of one recurrence.

A synapse has a release level, two additive facilitations and a pool.  Between two
pulses each relaxes towards its value at rest, the level and the facilitations with their own
times, the pool with that of its recovery.  At a pulse the level first steps towards one; the
response is read; then the facilitations step up and the pool loses the share that was used.
What is read, and what is used, is the family's mode:

``pool``: the pool; ``level``: level times pool, of which the level is used; ``sum``: a share of the
facilitation and the rest of the pool; ``product``: the pool times the facilitations.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published depression, and times and shares that no fit can tell.
PUBLISHED_USE, PUBLISHED_RECOVERY_MS = 0.22, 893.0
SHARE = 0.5
FAST_MS, NO_RECOVERY_MS = 5.0, 20000.0
# The recorded protocol, pairs of pulses at 0.2 Hz, twenty of which are averaged.
PAIR_PERIOD_MS, PAIRS = 5000.0, 20


@dataclass(frozen=True)
class Terms:
    mode: str
    rest: float = 0.0
    jump: float = 0.0
    level_ms: float = 1.0
    fast: float = 0.0
    fast_ms: float = 1.0
    slow: float = 0.0
    slow_ms: float = 1.0
    use: float = 0.0
    pool_ms: float = 1.0

    def first_use(self) -> float:
        """The share of the pool that a pulse at rest uses."""
        if self.mode == "level":
            return self.rest + self.jump * (1 - self.rest)
        return (1 - SHARE) * self.use if self.mode == "sum" else self.use


def _published_rest(jump: float) -> float:
    """The level at rest for which a first pulse uses the published share."""
    return max(0.0, (PUBLISHED_USE - jump) / (1 - jump))


_USE, _LEVEL, _RECOVERY, _DECAY = (0.001, 1.0), (0.001, 0.999), (10.0, 20000.0), (1.0, 1000.0)

#: Settings by parameters, and the parameters' names and bounds.  The bounds are fixed values.
FAMILIES: dict[str, tuple[Callable[..., Terms], dict[str, tuple[float, float]]]] = {
    "depression": (lambda use, pool_ms: Terms("pool", use=use, pool_ms=pool_ms), {"use": _USE, "pool_ms": _RECOVERY}),
    "facilitation_depression": (
        lambda rest, jump, level_ms, pool_ms: Terms("level", rest, jump, level_ms, pool_ms=pool_ms),
        {"rest": _LEVEL, "jump": (0.0, 0.999), "level_ms": _DECAY, "pool_ms": _RECOVERY},
    ),
    "tied_facilitation": (
        lambda rest, level_ms, pool_ms: Terms("level", rest, rest, level_ms, pool_ms=pool_ms),
        {"rest": _LEVEL, "level_ms": _DECAY, "pool_ms": _RECOVERY},
    ),
    "parallel_pools": (
        lambda fast, fast_ms, use, pool_ms: Terms("sum", fast=fast, fast_ms=fast_ms, use=use, pool_ms=pool_ms),
        {"fast": (0.0, 10.0), "fast_ms": _DECAY, "use": _USE, "pool_ms": _RECOVERY},
    ),
    "published_depression": (
        lambda jump, level_ms: Terms("level", _published_rest(jump), jump, level_ms, pool_ms=PUBLISHED_RECOVERY_MS),
        {"jump": (0.0, 0.219), "level_ms": _DECAY},
    ),
    "two_time_facilitation": (
        lambda fast, slow, slow_ms, use: Terms("product", fast=fast, fast_ms=FAST_MS, slow=slow, slow_ms=slow_ms, use=use, pool_ms=NO_RECOVERY_MS),
        {"fast": (0.0, 40.0), "slow": (0.0, 10.0), "slow_ms": (20.0, 2000.0), "use": _USE},
    ),
    "two_time_facilitation_free": (
        lambda fast, fast_ms, slow, slow_ms, use: Terms("product", fast=fast, fast_ms=fast_ms, slow=slow, slow_ms=slow_ms, use=use, pool_ms=NO_RECOVERY_MS),
        {"fast": (0.0, 40.0), "fast_ms": (1.0, 200.0), "slow": (0.0, 10.0), "slow_ms": (20.0, 2000.0), "use": _USE},
    ),
}


def terms(family: str, theta: Sequence[float]) -> Terms:
    make, box = FAMILIES[family]
    if len(theta) != len(box):
        raise ValueError(f"{family} has {len(box)} parameters, not {len(theta)}")
    return make(*map(float, theta))


class Synapse:
    """The recurrence, one pulse at a time."""

    __slots__ = ("t", "level", "fast", "slow", "pool")

    def __init__(self, t: Terms):
        self.t, self.level, self.fast, self.slow, self.pool = t, t.rest, 0.0, 0.0, 1.0

    def pulse(self, gap: float) -> float:
        """The response to a pulse ``gap`` after the one before (any gap before the first)."""
        t, exp = self.t, math.exp
        self.pool = 1 + (self.pool - 1) * exp(-gap / t.pool_ms)
        if t.mode == "level":
            self.level = t.rest + (self.level - t.rest) * exp(-gap / t.level_ms)
            self.level += t.jump * (1 - self.level)
            out = self.level * self.pool
            self.pool *= 1 - self.level
            return out
        if t.mode == "pool":
            out = self.pool
        else:
            self.fast *= exp(-gap / t.fast_ms)
            self.slow *= exp(-gap / t.slow_ms)
            out = SHARE * (1 + self.fast) + (1 - SHARE) * self.pool if t.mode == "sum" else (1 + self.fast + self.slow) * self.pool
            self.fast += t.fast
            self.slow += t.slow
        self.pool *= 1 - t.use
        return out


def responses(family: str, theta: Sequence[float], gaps: Sequence[float]) -> np.ndarray:
    """Responses to pulses ``gaps`` (ms, not negative) behind each other; the first gap does not matter."""
    if len(gaps) and min(gaps) < 0:
        raise ValueError("a gap cannot be negative")
    synapse = Synapse(terms(family, theta))
    return np.array([synapse.pulse(g) for g in gaps])


def train(family: str, theta: Sequence[float], gap: float, pulses: int) -> np.ndarray:
    """Responses to a train of equal gaps, as multiples of the first."""
    out = responses(family, theta, [gap] * pulses)
    return out / out[0]


def paired_pulse(family: str, theta: Sequence[float], gap: float, pairs: int = PAIRS) -> float:
    """Mean second response over mean first response of ``pairs`` pairs at the recorded rate; one pair is from rest."""
    if not 0 < gap < PAIR_PERIOD_MS:
        raise ValueError(f"a pair's gap lies between 0 and {PAIR_PERIOD_MS} ms")
    out = responses(family, theta, [PAIR_PERIOD_MS - gap, gap] * pairs)
    return float(out[1::2].sum() / out[::2].sum())


def pair_ceiling(probability: Column | float, gap: Column | float, recovery: Column | float) -> Column:
    """Largest ratio of a pair for sites with one vesicle each that release with ``probability`` at rest, whatever facilitates."""
    p, g, r = (x if isinstance(x, Column) else F.lit(float(x)) for x in (probability, gap, recovery))
    return (1 - p * F.exp(-g / r)) / p


def mixed_pair(mean: Column | float, variance: Column | float, gap: Column | float, recovery: Column | float) -> Column:
    """The ratio of a pair without facilitation for sites whose release probabilities vary."""
    m, v, g, r = (x if isinstance(x, Column) else F.lit(float(x)) for x in (mean, variance, gap, recovery))
    return 1 - F.exp(-g / r) * (m + v / m)


def largest_probability(ratio: Column | float, gap: Column | float, recovery: Column | float) -> Column:
    """The largest release probability at rest that a pair's ratio allows."""
    q, g, r = (x if isinstance(x, Column) else F.lit(float(x)) for x in (ratio, gap, recovery))
    return 1 / (q + F.exp(-g / r))


def respond(pulses: DataFrame, settings: dict[str, Sequence[float]]) -> DataFrame:
    """Adds to pulses (key, i, gap) a column for each family of ``settings``: its response, as a multiple of the key's first.

    Pulses are sorted by key and i, and the synapses are carried along each key from batch to batch.
    """
    own = pulses.select("key", "i", F.col("gap").cast("double").alias("gap")).repartition("key").sortWithinPartitions("key", "i")
    schema = f"key {own.schema['key'].dataType.simpleString()}, i {own.schema['i'].dataType.simpleString()}, gap double, " + ", ".join(f"`{f}` double" for f in settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, synapses, first = None, False, [], []
        for batch in batches:
            out: list[list[float]] = [[] for _ in settings]
            for key, gap in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                fresh = not begun or key != now
                if fresh:
                    now, begun, synapses = key, True, [Synapse(terms(f, theta)) for f, theta in settings.items()]
                values = [s.pulse(gap or 0.0) for s in synapses]
                first = values if fresh else first
                for column, value, one in zip(out, values, first, strict=True):
                    column.append(value / one)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, pa.float64()) for x in out]], names=[*batch.schema.names, *settings])

    return own.mapInArrow(run, schema)
