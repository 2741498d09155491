"""Features of current-step sweeps: samples (sweep, i, current, voltage), i counting from 0 at a fixed interval ``dt_ms``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandweave.operators import ordered, traces


def charging(samples: DataFrame, start: Column, rest: Column, least_span: float, low: float, high: float, least_r2: float, longest: float, dt_ms: float) -> DataFrame:
    """(sweep, tau_ms, r2, samples, verdict): the time constant by which the voltage of samples (sweep, i, voltage, and those that
    ``start`` and ``rest`` use) goes from ``start`` to ``rest``, by a line through the logarithm of what remains.

    Only samples before the first that reaches ``rest``, with a remaining share between low and high, count.  Rejected, in this order:
    ``span`` (start and rest too close), ``few`` (below 10 samples), ``rising``, ``poor`` (R2 below the floor), ``long`` (more than ``longest`` times the
    span of the samples).
    """
    own = samples.select("sweep", "i", F.col("voltage"), start.cast("double").alias("a"), rest.cast("double").alias("z"))
    own = own.withColumn("left", F.when(F.abs(F.col("z") - F.col("a")) >= least_span, (F.col("z") - F.col("voltage")) / (F.col("z") - F.col("a"))))
    over = Window.partitionBy("sweep").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumn("ended", F.max(F.when(F.col("left") <= 0, F.lit(True))).over(over))
    use = F.col("ended").isNull() & (F.col("left") > low) & (F.col("left") < high)
    x, y = F.when(use, F.col("i") * dt_ms), F.when(use, F.log("left"))
    own = own.withColumn("x", x.cast("double")).withColumn("y", y)
    f = own.groupBy("sweep").agg(
        F.max(F.abs(F.col("z") - F.col("a"))).alias("span"), F.count("x").alias("samples"), F.regr_slope("y", "x").alias("slope"), F.regr_r2("y", "x").alias("r2"), (F.max("x") - F.min("x")).alias("window"),
    )
    why = F.when(~F.coalesce(F.col("span") >= least_span, F.lit(False)), "span").when(F.col("samples") < 10, "few").when(~F.coalesce(F.col("slope") < 0, F.lit(False)), "rising")
    why = why.when(~F.coalesce(F.col("r2") >= least_r2, F.lit(False)), "poor").when(-1 / F.col("slope") > longest * F.col("window"), "long").otherwise("ok")
    f = f.withColumn("verdict", why)
    return f.select("sweep", F.when(F.col("verdict") == "ok", -1 / F.col("slope")).alias("tau_ms"), F.when(~F.col("verdict").isin("span", "few", "rising"), F.col("r2")).alias("r2"), F.when(F.col("verdict") != "span", F.col("samples")).otherwise(0).alias("samples"), "verdict")


def features(samples: DataFrame, dt_ms: float, settle_ms: float = 1.0, steady_ms: float = 5.0, prominence: float = 10.0, width: int = 5, refractory: int = 3, least_span: float = 0.5, low: float = 0.1, high: float = 0.9, least_r2: float = 0.9, longest: float = 1.0) -> DataFrame:
    """One row for each sweep whose current is one square pulse.

    first, last and level of the pulse; baseline (before it, without the settling time) and steady voltage (its last part); spikes within and
    after it, rate_hz, first_spike_ms, least interval; subthreshold; resistance (of subthreshold sweeps, 1000 * mV / level); and the charging time
    constant within the pulse (subthreshold sweeps) and after it (no spikes after), each with its verdict.
    """
    # Samples may be made of few rows, whose size says nothing of theirs: without the hint they would be broadcast.
    merged = lambda df: df.hint("merge")
    pulse = traces.step_window(samples.select(F.col("sweep").alias("key"), "i", F.col("current").alias("value"))).where("valid").select(F.col("key").alias("sweep"), "first", "last", "level")
    own = samples.join(merged(pulse), "sweep")
    settle, steady = max(1, round(settle_ms / dt_ms)), max(1, round(steady_ms / dt_ms))
    inside = F.col("i").between(F.col("first"), F.col("last"))
    base = own.groupBy("sweep", "first", "last", "level").agg(
        F.avg(F.when(F.col("i") < F.col("first") - settle, F.col("voltage"))).alias("baseline"), F.avg(F.when(inside & (F.col("i") > F.col("last") - steady), F.col("voltage"))).alias("steady"),
        F.max(F.when(F.col("i") == F.col("last"), F.col("voltage"))).alias("at_end"),
    )
    found = traces.peaks(samples.select(F.col("sweep").alias("key"), "i", F.col("voltage").alias("value")), prominence, width, refractory).select(F.col("key").alias("sweep"), "i")
    spikes = found.join(merged(pulse), "sweep").where(F.col("i") >= F.col("first"))
    gap = F.when(inside, F.col("i") - F.lag(F.when(inside, F.col("i"))).over(Window.partitionBy("sweep").orderBy("i")))
    per = spikes.withColumn("gap", gap).groupBy("sweep").agg(F.count_if(inside).alias("_in"), F.count_if(~inside).alias("_after"), F.min(F.when(inside, (F.col("i") - F.col("first")) * dt_ms)).alias("first_spike_ms"), (F.min("gap") * dt_ms).alias("least_interval_ms"))
    one = base.join(merged(per), "sweep", "left").withColumn("spikes", F.coalesce("_in", F.lit(0))).withColumn("spikes_after", F.coalesce("_after", F.lit(0)))
    one = one.withColumn("subthreshold", F.col("spikes") == 0).withColumn("rate_hz", F.col("spikes") / ((F.col("last") - F.col("first") + 1) * dt_ms / 1000))
    one = ordered.cut(one.withColumn("resistance", F.when(F.col("subthreshold") & (F.col("level") != 0), 1000 * (F.col("steady") - F.col("baseline")) / F.col("level"))).drop("_in", "_after"))
    near = samples.select("sweep", "i", "voltage").join(merged(one.select("sweep", "first", "last", "baseline", "steady", "at_end", "subthreshold", "spikes_after")), "sweep")
    bounds = (least_span, low, high, least_r2, longest, dt_ms)
    rise = charging(near.where(F.col("subthreshold") & inside), F.col("baseline"), F.col("steady"), *bounds)
    fall = charging(near.where((F.col("spikes_after") == 0) & (F.col("i") > F.col("last"))), F.col("at_end"), F.col("baseline"), *bounds)
    kept = lambda df, p: merged(df).select("sweep", *[F.col(c).alias(f"{p}_{c}") for c in ("tau_ms", "r2", "verdict")])
    joined = one.join(kept(rise, "charge"), "sweep", "left").join(kept(fall, "relax"), "sweep", "left")
    return joined.withColumn("charge_verdict", F.coalesce("charge_verdict", F.lit("spikes"))).withColumn("relax_verdict", F.coalesce("relax_verdict", F.lit("spikes"))).drop("at_end")


def protocol_summary(sweeps: DataFrame, cell: str) -> DataFrame:
    """Per cell: sweeps, median accepted time constant and resistance, the largest silent and the least firing current above it (the bracket
    of the rheobase), and whether rates never fall as the current rises."""
    medians = None
    for value, out in (("charge_tau_ms", "median_tau_ms"), ("resistance", "median_resistance")):
        q = ordered.quantiles(sweeps, [cell], value, (0.5,), out).select(cell, F.get(out, F.lit(0)).alias(out))
        medians = q if medians is None else medians.join(q, cell, "full_outer")
    before = F.max("rate_hz").over(Window.partitionBy(cell).orderBy("level", "rate_hz").rowsBetween(Window.unboundedPreceding, -1))
    rows = sweeps.withColumn("_falls", F.coalesce(F.col("rate_hz") < before, F.lit(False)))
    firing = F.min(F.when(~F.col("subthreshold"), F.col("level"))).over(Window.partitionBy(cell))
    rows = rows.withColumn("_firing", firing)
    silent = F.max(F.when(F.col("subthreshold") & (F.col("_firing").isNull() | (F.col("level") < F.col("_firing"))), F.col("level")))
    own = rows.groupBy(cell).agg(F.count("*").alias("sweeps"), silent.alias("silent_current"), F.max("_firing").alias("firing_current"), (~F.bool_or("_falls")).alias("monotone"))
    return own.join(medians, cell, "left")


# Range (ms) and number of the time constants of a fit without a known asymptote.
TAU_RANGE, TAUS = (0.5, 2000.0), 600


def free_asymptote(samples: DataFrame, dt_ms: float, taus: int = TAUS) -> DataFrame:
    """(sweep, tau_ms, asymptote, amplitude, r2, samples) of voltage = amplitude * exp(-t / tau) + asymptote: least squares for each time
    constant of a geometric grid.  Sweeps of less than 10 samples, and those whose voltage does not vary, have nulls."""
    kind = samples.schema["sweep"].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i")
        t, v = (frame["i"].to_numpy(float) - frame["i"].min()) * dt_ms, frame["voltage"].to_numpy(float)
        n = len(v)
        row: list = [frame["sweep"].iloc[0], None, None, None, None, n]
        if n >= 10 and v.min() < v.max():
            grid = np.geomspace(*TAU_RANGE, taus)
            e = np.exp(-t[None, :] / grid[:, None])
            me, mv = e.mean(1), v.mean()
            see, sev = ((e - me[:, None]) ** 2).sum(1), ((e - me[:, None]) * (v - mv)).sum(1)
            slope = np.divide(sev, see, out=np.zeros(taus), where=see > 1e-300)
            total = float(((v - mv) ** 2).sum())
            best = int(np.argmin(total - slope * sev))
            row[1:5] = [float(grid[best]), float(mv - slope[best] * me[best]), float(slope[best]), float(slope[best] * sev[best] / total) if total > 0 else None]
        return pd.DataFrame([row], columns=["sweep", "tau_ms", "asymptote", "amplitude", "r2", "samples"]).astype({"tau_ms": float, "asymptote": float, "amplitude": float, "r2": float})

    return samples.select("sweep", "i", "voltage").groupBy("sweep").applyInPandas(run, f"sweep {kind}, tau_ms double, asymptote double, amplitude double, r2 double, samples bigint")


def free_features(samples: DataFrame, dt_ms: float, prominence: float = 10.0, width: int = 5, refractory: int = 3) -> DataFrame:
    """Per sweep without a stimulus: samples, seconds, mean and deviation (population) of the voltage, spikes and their rate."""
    own = samples.groupBy("sweep").agg(F.count("*").alias("samples"), F.avg("voltage").alias("mean"), F.stddev_pop("voltage").alias("sd"))
    found = traces.peaks(samples.select(F.col("sweep").alias("key"), "i", F.col("voltage").alias("value")), prominence, width, refractory).groupBy(F.col("key").alias("sweep")).agg(F.count("*").alias("_n"))
    seconds = F.col("samples") * dt_ms / 1000
    spikes = F.coalesce("_n", F.lit(0))
    return own.join(found, "sweep", "left").select("sweep", "samples", seconds.alias("seconds"), "mean", "sd", spikes.alias("spikes"), (spikes / seconds).alias("rate_hz"))


def band_inside(members: DataFrame, at: str, value: str, observed: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(at, low, middle, high, observed, inside): the ensemble's band at each point, and whether the observed value lies in it."""
    band = ordered.quantiles(members, [at], value, (low, 0.5, high)).select(at, *[F.get("q", F.lit(k)).alias(n) for k, n in enumerate(("low", "middle", "high"))])
    return band.join(observed.select(at, F.col(value).alias("observed")), at).withColumn("inside", F.col("observed").between(F.col("low"), F.col("high")))


def holdout(model: DataFrame, cohort: DataFrame, held: DataFrame, at: str) -> DataFrame:
    """One row for the curves (at, value) of a model and of the other animals against a held-out one: rmse of each, their ratio, and the
    onset (first point above 0) and peak of model and held-out curve."""
    pairs = held.select(at, F.col("value").alias("h")).join(model.select(at, F.col("value").alias("m")), at).join(cohort.select(at, F.col("value").alias("c")), at)
    d, e = F.col("m") - F.col("h"), F.col("c") - F.col("h")
    onset = lambda c: F.min(F.when(F.col(c) > 0, F.col(at)))
    one = pairs.agg(F.count("*").alias("points"), F.sqrt(F.avg(d * d)).alias("rmse"), F.sqrt(F.avg(e * e)).alias("cohort_rmse"), onset("m").alias("onset"), onset("h").alias("held_onset"), F.max("m").alias("peak"), F.max("h").alias("held_peak"))
    return one.withColumn("ratio", F.col("rmse") / F.nullif(F.col("cohort_rmse"), F.lit(0.0)))
