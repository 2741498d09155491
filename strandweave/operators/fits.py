"""Parameter fits.  Candidates are rows, so grids and restarts run in parallel; the best row wins."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandweave.functions.tails import chi_square_upper
from strandweave.operators import plasticity


def geometric_grid(low: float, high: float, steps: int) -> list[float]:
    return [low * (high / low) ** (i / (steps - 1)) for i in range(steps)]


def best(rows: DataFrame, group: list[str], loss: str, parameters: list[str]) -> DataFrame:
    """Per group the parameters of least loss, ties by the parameters themselves."""
    return rows.groupBy(*group).agg(F.min_by(F.struct(loss, *parameters), F.struct(loss, *parameters)).alias("b")).select(*group, "b.*")


def truncated_nb(histogram: DataFrame, group: list[str], steps: int = 40, passes: int = 4) -> DataFrame:
    """Zero-truncated negative binomial by maximum likelihood on a narrowing grid, per group of (value, n) counts.

    Columns: group, dispersion, mean, loglik, boundary (whether either lies at the first grid's edge).
    """
    # The searched ranges.
    limits = ((0.05, 200.0), (0.5, 5000.0))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        k, n = frame["value"].to_numpy(np.float64), frame["n"].to_numpy(np.float64)
        spans = [limits[0], limits[1]]
        top = (-math.inf, 0.0, 0.0)
        for _ in range(passes):
            grids = [geometric_grid(lo, hi, steps) for lo, hi in spans]
            for r in grids[0]:
                base = np.array([math.lgamma(r + x) - math.lgamma(r) - math.lgamma(x + 1) for x in k])
                m = np.array(grids[1])[:, None]
                p = m / (r + m)
                zero = r * np.log1p(-p)
                each = base + zero + k * np.log(p) - np.log(-np.expm1(zero))
                total = each @ n
                at = int(total.argmax())
                top = max(top, (float(total[at]), r, float(grids[1][at])))
            spans = [(max(lim[0], v / (hi / lo) ** 0.125), min(lim[1], v * (hi / lo) ** 0.125)) for (lo, hi), lim, v in zip(spans, limits, top[1:], strict=True)]
        edge = any(math.isclose(v, e, rel_tol=1e-3) for v, lim in zip(top[1:], limits, strict=True) for e in lim)
        return pd.DataFrame([[*frame[group].iloc[0], top[1], top[2], top[0], edge]], columns=[*group, "dispersion", "mean", "loglik", "boundary"])

    kinds = ", ".join(f"`{g}` {histogram.schema[g].dataType.simpleString()}" for g in group)
    return histogram.groupBy(*group).applyInPandas(fit, f"{kinds}, dispersion double, mean double, loglik double, boundary boolean")


def kernel(t: np.ndarray, rise: float, decay: float) -> np.ndarray:
    """Difference of exponentials with peak 1."""
    raw = np.exp(-t / decay) - np.exp(-t / rise)
    peak = rise * decay / (decay - rise) * math.log(decay / rise)
    return raw / (math.exp(-peak / decay) - math.exp(-peak / rise))


def kernel_grid_fit(curves: DataFrame, group: str, rises: list[float], decays: list[float]) -> DataFrame:
    """Per curve set (group, curve, t, y): the rise and decay whose kernel, scaled to each curve by a non-negative
    projection, leaves the least mean Huber loss."""

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        parts = [(c["t"].to_numpy(), c["y"].to_numpy()) for _, c in frame.groupby("curve")]
        for rise in rises:
            for decay in decays:
                if decay <= rise:
                    continue
                losses = []
                for t, y in parts:
                    k = kernel(t, rise, decay)
                    d = np.abs(y - max(0.0, float(y @ k) / float(k @ k)) * k)
                    scale = max(1e-12, float(np.abs(y).max()) * 0.1)
                    losses.append(float(np.where(d <= scale, d * d / 2, scale * (d - scale / 2)).mean()))
                rows.append((float(np.mean(losses)), rise, decay))
        loss, rise, decay = min(rows)
        return pd.DataFrame([[frame[group].iloc[0], rise, decay, loss]], columns=[group, "rise", "decay", "loss"])

    return curves.groupBy(group).applyInPandas(fit, f"`{group}` {curves.schema[group].dataType.simpleString()}, rise double, decay double, loss double")


def two_decay_kernel(t: np.ndarray, onset: float, rise: float, fast: float, slow: float, share: float) -> np.ndarray:
    """One rise and two decays, the fast one with ``share`` of the weight, 0 before the onset, peak 1."""
    x = np.maximum(0.0, t - onset)
    k = np.where(t >= onset, share * np.exp(-x / fast) + (1 - share) * np.exp(-x / slow) - np.exp(-x / rise), 0.0)
    return k / k.max() if k.max() > 0 else k


def huber_mean(d: np.ndarray, delta: float) -> np.ndarray:
    """Mean Huber loss over the last axis."""
    a = np.abs(d)
    return np.where(a <= delta, a * a / 2, delta * (a - delta / 2)).mean(-1)


def two_decay_fit(curves: DataFrame, group: str, onsets: list[float], rises: list[float], fasts: list[float], slows: list[float], shares: list[float], delta: float = 1.0) -> DataFrame:
    """Per curve set (group, curve, t, y; the curves of a set have the same times) the kernel that, scaled to each curve by a non-negative
    projection, leaves the least mean Huber loss: onset, rise, fast, slow, share, half_decay, amplitude (median over the curves) and loss.

    Candidates that do not rise faster than they decay, or whose decays are not in order, are left out; a set with none has no row.
    """
    grid = [(o, r, f, s, w) for o in onsets for r in rises for f in fasts for s in slows for w in shares if r < f < s and 0 < w <= 1]
    kind = curves.schema[group].dataType.simpleString()
    columns = [group, "onset", "rise", "fast", "slow", "share", "half_decay", "amplitude", "loss"]

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        wide = frame.pivot(index="curve", columns="t", values="y")
        t, y = wide.columns.to_numpy(float), wide.to_numpy(float)
        found = []
        for c in grid:
            k = two_decay_kernel(t, *c)
            if k.any():
                amplitude = np.maximum(0.0, y @ k / (k @ k))
                found.append((float(huber_mean(y - amplitude[:, None] * k, delta).mean()), *c, float(np.median(amplitude))))
        if not found:
            return pd.DataFrame(columns=columns).astype({c: float for c in columns[1:]})
        loss, *c, amplitude = min(found)
        k = two_decay_kernel(t, *c)
        top = int(np.argmax(k))
        below = np.flatnonzero(k[top:] <= 0.5)
        half = float(t[top + below[0]] - t[top]) if len(below) else None
        return pd.DataFrame([(frame[group].iloc[0], *c, half, amplitude, loss)], columns=columns).astype({"half_decay": float})

    return curves.groupBy(group).applyInPandas(fit, f"`{group}` {kind}, " + ", ".join(f"{c} double" for c in columns[1:]))


def interval_scores(observed: DataFrame, predicted: DataFrame, at: str, widest: float) -> DataFrame:
    """(at, mean, predicted, inside, residual, underpowered, null_residual, ratio) of observations (at, mean, low, high, se): whether the
    interval holds the prediction, the residuals of the model and of the flat line of inverse-variance mean in errors, whether half of the
    interval is wider than ``widest``, and the ratio of the summed squares of the two."""
    w = 1 / (F.col("se") * F.col("se"))
    flat = observed.agg((F.sum(w * F.col("mean")) / F.sum(w)).alias("_flat"))
    own = observed.join(predicted.select(at, F.col("value").alias("predicted")), at).crossJoin(F.broadcast(flat))
    own = own.withColumn("residual", (F.col("predicted") - F.col("mean")) / F.col("se")).withColumn("null_residual", (F.col("_flat") - F.col("mean")) / F.col("se"))
    both = own.agg((F.sum(F.col("residual") * F.col("residual")) / F.nullif(F.sum(F.col("null_residual") * F.col("null_residual")), F.lit(0.0))).alias("ratio"))
    return own.crossJoin(F.broadcast(both)).select(
        at, "mean", "predicted", F.col("predicted").between(F.col("low"), F.col("high")).alias("inside"), "residual", ((F.col("high") - F.col("low")) / 2 > widest).alias("underpowered"), "null_residual", "ratio",
    )


# Short-term plasticity.  An observation is (gap, pulse, mean, error): the response to a pulse of a train of equal gaps as a
# multiple of the first, or, with pulse 0, the ratio of pairs of pulses under the recorded protocol.


def predicted(family: str, theta: Sequence[float], observed: list[tuple[float, int, float, float]]) -> np.ndarray:
    """The values that a family gives for the observations."""
    most: dict[float, int] = {}
    for gap, pulse, _, _ in observed:
        most[gap] = max(most.get(gap, 0), pulse)
    trains = {gap: plasticity.train(family, theta, gap, n) for gap, n in most.items() if n}
    return np.array([trains[gap][pulse - 1] if pulse else plasticity.paired_pulse(family, theta, gap) for gap, pulse, _, _ in observed])


def simplex(f: Callable[[np.ndarray], float], start: np.ndarray, size: float = 0.5, rounds: int = 1000, tolerance: float = 1e-10) -> tuple[np.ndarray, float]:
    """Downhill simplex search without derivatives."""
    points = [start, *(start + size * e for e in np.eye(len(start)))]
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] < tolerance * (1e-12 + abs(values[0])):
            break
        centre = np.mean(points[:-1], axis=0)
        away = centre - points[-1]
        mirrored = centre + away
        v = f(mirrored)
        if v < values[0]:
            longer = centre + 2 * away
            w = f(longer)
            points[-1], values[-1] = (longer, w) if w < v else (mirrored, v)
        elif v < values[-2]:
            points[-1], values[-1] = mirrored, v
        else:
            inner = centre + (away if v < values[-1] else -away) / 2
            w = f(inner)
            if w < min(v, values[-1]):
                points[-1], values[-1] = inner, w
            else:
                points = [points[0], *((p + points[0]) / 2 for p in points[1:])]
                values = [values[0], *(f(p) for p in points[1:])]
    at = int(np.argmin(values))
    return points[at], values[at]


def _into_box(x: np.ndarray, box: list[tuple[float, float]]) -> np.ndarray:
    lo, hi = np.array(box).T
    return lo + (hi - lo) / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_family(name: str, observed: list[tuple[float, int, float, float]], seed: int, starts: int = 8) -> tuple[float, np.ndarray, bool]:
    """Least weighted squares of trains and pairs together, from stratified starts: (loss, parameters, at an edge)."""
    box = list(plasticity.FAMILIES[name][1].values())
    mean, error = (np.array([o[k] for o in observed]) for k in (2, 3))

    def loss(x: np.ndarray) -> float:
        return float((((mean - predicted(name, _into_box(x, box), observed)) / error) ** 2).sum())

    rng = np.random.default_rng(seed)
    strata = np.stack([rng.permutation(starts) for _ in box], 1)
    tries = (strata + rng.random(strata.shape)) / starts
    found = [simplex(loss, np.log(t / (1 - t))) for t in np.maximum(tries, 1e-9)]
    x, value = min(found, key=lambda r: r[1])
    p = _into_box(x, box)
    edge = any(min(abs(v - lo), abs(hi - v)) < 1e-3 * (hi - lo) for v, (lo, hi) in zip(p, box, strict=True))
    return value, p, edge


def observations(responses: DataFrame, least_error: float = 1e-3) -> DataFrame:
    """(specimen, gap, pulse, mean, error) of responses (specimen, gap, pulse, response): the mean of each later pulse as a multiple of the
    first one's, and its standard error, ``least_error`` at least.  Trains without a first pulse, and pulses with one response, have none."""
    own = responses.groupBy("specimen", "gap", "pulse").agg(F.avg("response").alias("_m"), (F.stddev_samp("response") / F.sqrt(F.count("*"))).alias("_e"))
    first = own.where("pulse = 1 and _m <> 0").select("specimen", "gap", F.col("_m").alias("_first"))
    joined = own.where("pulse > 1 and _e is not null").join(first, ["specimen", "gap"])
    return joined.select("specimen", "gap", F.col("pulse").cast("int").alias("pulse"), (F.col("_m") / F.col("_first")).alias("mean"), F.greatest(F.col("_e") / F.abs("_first"), F.lit(least_error)).alias("error"))


def _jobs(observed: DataFrame, families: list[str], replicates: int | None, run: Callable[[str, int, list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """``run(family, replicate, observations)`` for each specimen, family and replicate, in groups of their own; without a number of
    replicates, one for each observation.  A specimen's observations are as many as its gaps and pulses."""
    kind = observed.schema["specimen"].dataType.simpleString()
    own = observed.select("specimen", F.col("gap").cast("double").alias("gap"), F.col("pulse").cast("int").alias("pulse"), "mean", "error").withColumn("family", F.explode(F.array(*[F.lit(f) for f in families])))
    count = F.lit(replicates) if replicates is not None else F.count("*").over(Window.partitionBy("specimen", "family"))
    own = own.withColumn("_n", count.cast("int")).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    names = ["specimen", *[f.split()[0] for f in schema.split(", ")]]

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["gap", "pulse", "mean"])
        given = [(float(g), int(p), float(m), float(e)) for g, p, m, e in frame[["gap", "pulse", "mean", "error"]].itertuples(index=False)]
        rows = run(frame["family"].iloc[0], int(frame["replicate"].iloc[0]), given)
        return pd.DataFrame([(frame["specimen"].iloc[0], *r) for r in rows], columns=names)

    return own.groupBy("specimen", "family", "replicate").applyInPandas(each, f"specimen {kind}, {schema}")


def fit_families(observed: DataFrame, families: list[str], restarts: int = 4) -> DataFrame:
    """(specimen, family, loss, parameters, at_edge, gof_p, first_use): the best of the restarts for each family, over all observations
    (specimen, gap, pulse, mean, error), trains and pairs (pulse 0) alike; without a degree of freedom there is no ``gof_p``."""

    def run(family: str, seed: int, given: list[tuple]) -> list[tuple]:
        loss, p, edge = fit_family(family, given, seed)
        degrees = len(given) - len(plasticity.FAMILIES[family][1])
        gof = chi_square_upper(loss, degrees) if degrees > 0 else None
        return [(family, loss, p.tolist(), edge, gof, plasticity.terms(family, p).first_use())]

    rows = _jobs(observed, families, restarts, run, "family string, loss double, parameters array<double>, at_edge boolean, gof_p double, first_use double")
    return best(rows, ["specimen", "family"], "loss", ["parameters", "at_edge", "gof_p", "first_use"])


def leave_one_out(observed: DataFrame, families: list[str]) -> DataFrame:
    """(specimen, family, left_out, residual): each observation, in the order of gap and pulse, predicted from the specimen's others, in its errors."""

    def run(family: str, k: int, given: list[tuple]) -> list[tuple]:
        _, p, _ = fit_family(family, given[:k] + given[k + 1 :], k)
        _, _, y, e = given[k]
        return [(family, k, float((y - predicted(family, p, given[k : k + 1])[0]) / e))]

    return _jobs(observed, families, None, run, "family string, left_out int, residual double")


def bootstrap_band(observed: DataFrame, family: str, gap: float, pulses: int, replicates: int = 200) -> DataFrame:
    """(specimen, pulse, low, middle, high): 5, 50 and 95 % of predictions refitted to observations drawn around the given ones."""

    def run(name: str, k: int, given: list[tuple]) -> list[tuple]:
        rng = np.random.default_rng(1000 + k)
        drawn = [(g, n, y + e * rng.standard_normal(), e) for g, n, y, e in given]
        _, p, _ = fit_family(name, drawn, k, starts=4)
        return [(i + 1, float(v)) for i, v in enumerate(plasticity.train(name, p, gap, pulses))]

    rows = _jobs(observed, [family], replicates, run, "pulse int, value double")
    q = F.percentile("value", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return rows.groupBy("specimen", "pulse").agg(q.alias("q")).select("specimen", "pulse", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("low", "middle", "high"))])


def recovery(design: DataFrame, family: str, truth: list[float], replicates: int = 10) -> DataFrame:
    """(specimen, replicate, worst_relative_error) of parameters recovered from observations that the family makes at the design's gaps and pulses, with its errors."""

    def run(name: str, k: int, given: list[tuple]) -> list[tuple]:
        rng = np.random.default_rng(k)
        data = [(g, n, float(v + e * rng.standard_normal()), e) for (g, n, _, e), v in zip(given, predicted(name, truth, given), strict=True)]
        _, p, _ = fit_family(name, data, k)
        return [(k, float(np.max(np.abs(p - truth) / np.abs(truth))))]

    return _jobs(design, [family], replicates, run, "replicate int, worst_relative_error double")


def discrimination(observed: DataFrame, family: str, truth: list[float], rival: str, replicates: int = 200, starts: int = 4) -> DataFrame:
    """(specimen, wins, median_margin, high_margin): how often ``family`` fits data that it made better than ``rival`` does, and by how
    much (median and 95 %) of weighted squares.  The data are drawn around its values with the observations' errors."""

    def run(name: str, k: int, given: list[tuple]) -> list[tuple]:
        rng = np.random.default_rng(k)
        drawn = [(g, n, float(v + e * rng.standard_normal()), e) for (g, n, _, e), v in zip(given, predicted(name, truth, given), strict=True)]
        return [(k, fit_family(rival, drawn, k, starts)[0] - fit_family(name, drawn, k, starts)[0])]

    rows = _jobs(observed, [family], replicates, run, "replicate int, margin double")
    q = F.percentile("margin", F.array(F.lit(0.5), F.lit(0.95)))
    return rows.groupBy("specimen").agg(F.avg((F.col("margin") > 0).cast("double")).alias("wins"), q.alias("q")).select("specimen", "wins", F.get("q", F.lit(0)).alias("median_margin"), F.get("q", F.lit(1)).alias("high_margin"))


def rate_grid_fit(curves: DataFrame, specimen: str, grids: dict[str, list[float]], model: Callable[..., Column]) -> DataFrame:
    """Per specimen of (specimen, x, y): the grid point with the least root mean square error of ``model(x, **parameters)``."""
    spark = curves.sparkSession
    candidates = spark.createDataFrame([(0,)], "_c int")
    for name, values in grids.items():
        candidates = candidates.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    pairs = curves.join(F.broadcast(candidates.drop("_c")))
    d = F.col("y") - model(F.col("x"), **{n: F.col(n) for n in grids})
    return best(pairs.groupBy(specimen, *grids).agg(F.sqrt(F.avg(d * d)).alias("rmse")), [specimen], "rmse", list(grids))


def adaptive_ramp(parameters: DataFrame, slope: float, dt_ms: float, steps: int) -> DataFrame:
    """Spikes of a leaky integrator with an adaptation current on a current ramp, one candidate row (candidate, tau, threshold,
    adapt, adapt_tau) to (candidate, spikes, first_ms); each candidate runs by itself."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            v, w = np.zeros(len(f)), np.zeros(len(f))
            count, first = np.zeros(len(f), np.int64), np.full(len(f), np.nan)
            tau, limit, jump, slow = (f[c].to_numpy() for c in ("tau", "threshold", "adapt", "adapt_tau"))
            for k in range(steps):
                v = v + dt_ms / tau * (slope * k * dt_ms - w - v)
                w = w - dt_ms / slow * w
                fired = v >= limit
                first = np.where(fired & (count == 0), k * dt_ms, first)
                count, v, w = count + fired, np.where(fired, 0.0, v), w + jump * fired
            yield pd.DataFrame({"candidate": f["candidate"], "spikes": count, "first_ms": first})

    return parameters.mapInPandas(run, "candidate bigint, spikes bigint, first_ms double")


def small_network(edges: DataFrame, circuit: str, stimulus: dict[int, list[int]], steps: int, decay: float, threshold: float, delay: int, refractory: int, use: float = 0.0, recovery: float = math.inf) -> DataFrame:
    """(circuit, step, node) spikes of leaky integrators on each small circuit of ``edges`` (circuit, src, dst, weight).

    One circuit is one group, which must fit into a task; ``stimulus`` gives the steps at which a node is made to fire.  A source's spike
    delivers its weights times its resources, of which it uses the share ``use``; they come back with the time constant ``recovery`` (in steps).
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(np.concatenate([frame["src"], frame["dst"]]))
        src, dst, weight = np.searchsorted(nodes, frame["src"]), np.searchsorted(nodes, frame["dst"]), frame["weight"].to_numpy(np.float64)
        forced = np.zeros((steps, len(nodes)), bool)
        for node, at in stimulus.items():
            i = np.searchsorted(nodes, node)
            if i < len(nodes) and nodes[i] == node:
                forced[[s for s in at if s < steps], i] = True
        v, rest = np.zeros(len(nodes)), np.zeros(len(nodes), np.int64)
        arriving = np.zeros((steps + delay + 1, len(nodes)))
        rows, pool = [], np.ones(len(nodes))
        for k in range(steps):
            pool = 1 + (pool - 1) * math.exp(-1 / recovery)
            v = np.where(rest > 0, 0.0, v * decay + arriving[k])
            fired = forced[k] | ((v >= threshold) & (rest <= 0))
            rest = np.where(fired, refractory, rest - 1)
            v = np.where(fired, 0.0, v)
            rows += [(frame[circuit].iloc[0], k, int(n)) for n in nodes[fired]]
            hit = fired[src]
            np.add.at(arriving[k + delay], dst[hit], weight[hit] * pool[src[hit]])
            pool = np.where(fired, pool * (1 - use), pool)
        return pd.DataFrame(rows, columns=[circuit, "step", "node"])

    kind = edges.schema[circuit].dataType.simpleString()
    return edges.groupBy(circuit).applyInPandas(run, f"`{circuit}` {kind}, step int, node bigint")


def stimulus_schedule(nodes: DataFrame, steps: int, probability: float, seed: str = "stim") -> DataFrame:
    """(step, node) of a Bernoulli schedule that any engine draws alike, by md5(step:node:seed)."""
    grid = nodes.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("step").cast("string"), F.col("node").cast("string"), F.lit(seed))), 1, 8), 16, 10).cast("bigint")
    return grid.where(h / F.lit(float(1 << 32)) < probability).select("step", "node")
