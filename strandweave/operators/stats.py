"""Statistics on tables: ranks, correlations, cohort summaries, classification, closed forms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandweave.functions.predicates import finite
from strandweave.functions.tails import t_quantile
from strandweave.operators import ordered
from strandweave.operators.ordered import ranked


def correlation(x: str, y: str) -> Column:
    """Pearson correlation, null for a constant side."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, rho) over rows with both values; rho is null for a constant side."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    with_ranks = ranked(ranked(both, "x", "rx"), "y", "ry")
    return with_ranks.agg(F.count("*").alias("n"), correlation("rx", "ry").alias("rho"))


def sign_counts(df: DataFrame, difference: Column) -> DataFrame:
    d = df.select(difference.alias("d"))
    return d.agg(F.count_if(F.col("d") > 0).alias("positive"), F.count_if(F.col("d") < 0).alias("negative"), F.count_if(F.col("d") == 0).alias("ties"))


def variation(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, n, cv): sample deviation over mean; null below two rows or for a zero mean."""
    out = df.groupBy(*group).agg(F.count(value).alias("n"), F.stddev_samp(value).alias("s"), F.avg(value).alias("m"))
    return out.select(*group, "n", F.when((F.col("n") >= 2) & (F.col("m") != 0), F.col("s") / F.col("m")).alias("cv"))


def _large_t(df: Column) -> Column:
    """Two-sided 5 % t quantile for many degrees of freedom."""
    z = 1.959963984540054
    return F.lit(z) + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df * df) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * df * df * df)


def cohort_summary(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Per group over finite values: n, excluded, mean, sd, se, extremes and 95 % interval (null below n = 2).

    t quantiles come from a table up to n = 60 and from the expansion about the normal one beyond.
    """
    ok = finite(F.col(value))
    v = F.when(ok, F.col(value))
    out = df.groupBy(*group).agg(
        F.count(v).alias("n"), F.count_if(~ok).alias("excluded"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("least"), F.max(v).alias("most")
    )
    small = df.sparkSession.createDataFrame([(n, t_quantile(n - 1)) for n in range(2, 61)], "n bigint, t double")
    out = out.join(F.broadcast(small), "n", "left").withColumn("t", F.coalesce("t", _large_t(F.greatest(F.col("n") - 1, F.lit(1)))))
    se = F.col("sd") / F.sqrt("n")
    enough = F.col("n") >= 2
    half = F.col("t") * se
    return out.select(*group, "n", "excluded", "mean", F.when(enough, F.col("sd")).alias("sd"), F.when(enough, se).alias("se"), F.when(enough, F.col("mean") - half).alias("low"), F.when(enough, F.col("mean") + half).alias("high"), "least", "most")


def pulse_normalised(df: DataFrame, pulse: str, value: str, group: list[str]) -> DataFrame:
    """Per group and pulse: mean and standard error over the first pulse's mean, and the number of finite values."""
    from pyspark.sql.window import Window

    v = F.when(finite(F.col(value)), F.col(value))
    per = df.groupBy(*group, pulse).agg(F.avg(v).alias("_m"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("_se"), F.count(v).alias("n"))
    first = F.first("_m").over(Window.partitionBy(*group).orderBy(pulse))
    return per.withColumn("_f", first).select(*group, pulse, "n", (F.col("_m") / F.col("_f")).alias("mean"), (F.col("_se") / F.col("_f")).alias("se"))


def binary_metrics(df: DataFrame, truth: str, score: str, cut: float = 0.0) -> DataFrame:
    """One row: confusion counts at score > cut, rates, balanced accuracy and AUROC (ties count half)."""
    t, p = F.col(truth) == 1, F.col(score) > cut
    with_ranks = ranked(df.select(truth, score).where(F.col(truth).isNotNull() & F.col(score).isNotNull()), score, "_rank")
    one = with_ranks.agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"), F.sum(F.when(t, F.col("_rank"))).alias("_r")
    )
    pos, neg = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    sens, spec = F.when(pos > 0, F.col("tp") / pos), F.when(neg > 0, F.col("tn") / neg)
    auroc = F.when((pos > 0) & (neg > 0), (F.col("_r") - pos * (pos + 1) / 2) / (pos * neg))
    return one.select("tp", "fp", "fn", "tn", ((F.col("tp") + F.col("tn")) / (pos + neg)).alias("accuracy"), sens.alias("sensitivity"), spec.alias("specificity"), ((sens + spec) / 2).alias("balanced_accuracy"), auroc.alias("auroc"))


def curve_metrics(model: DataFrame, reference: DataFrame, on: str) -> DataFrame:
    """Curves (on, value) on their common points: rmse, mae, Pearson r and the share of positive reference points answered."""
    j = model.select(F.col(on).alias("_on"), F.col("value").alias("m")).join(reference.select(F.col(on).alias("_on"), F.col("value").alias("r")), "_on")
    d = F.col("m") - F.col("r")
    return j.agg(F.count("*").alias("points"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), correlation("m", "r").alias("pearson"), (F.count_if((F.col("r") > 0) & (F.col("m") > 0)) / F.nullif(F.count_if(F.col("r") > 0), F.lit(0))).alias("coverage"))


def control_summary(df: DataFrame, variant: str, value: str) -> DataFrame:
    return df.groupBy(variant).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


def quantiles(df: DataFrame, group: list[str], value: str, at: tuple[float, ...]) -> DataFrame:
    """Exact quantiles with linear interpolation, one column for each."""
    return ordered.quantiles(df, group, value, at, "_q").select(*group, *[F.get("_q", F.lit(i)).alias(f"q{int(round(a * 100))}") for i, a in enumerate(at)])


def log_linear_fit(df: DataFrame, group: list[str], at: Column, remaining: Column, low: float, high: float, least_r2: float) -> DataFrame:
    """Per group the charging time constant of ln(remaining) against time over low < remaining < high.

    Rejected, in this order: ``few`` (below 10 samples), ``rising`` (slope not negative), ``poor`` (R2 below the floor).
    """
    own = df.where((remaining > low) & (remaining < high)).select(*group, at.cast("double").alias("x"), F.log(remaining).alias("y"))
    f = own.groupBy(*group).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))
    why = F.when(F.col("n") < 10, "few").when(~F.coalesce(F.col("slope") < 0, F.lit(False)), "rising").when(F.col("r2") < least_r2, "poor").otherwise("ok")
    return f.withColumn("verdict", why).withColumn("tau", F.when(F.col("verdict") == "ok", -1 / F.col("slope")))


def waveform_features(df: DataFrame, group: list[str], t: str, v: str, onset: float) -> DataFrame:
    """Per group: baseline before the onset, peak above it, its time, and the time after the peak to fall to 1/e."""
    base = df.groupBy(*group).agg(F.avg(F.when(F.col(t) < onset, F.col(v))).alias("baseline"))
    own = df.join(base, group).withColumn("_a", F.col(v) - F.col("baseline"))
    top = own.where(F.col(t) >= onset).groupBy(*group, "baseline").agg(F.max("_a").alias("peak"), F.max_by(t, F.struct("_a", -F.col(t))).alias("peak_time"))
    fall = own.drop("baseline").join(top, group).where((F.col(t) > F.col("peak_time")) & (F.col("_a") <= F.col("peak") / math.e)).groupBy(*group).agg(F.min(t).alias("_f"))
    return top.join(fall, group, "left").select(*group, "baseline", "peak", "peak_time", (F.col("_f") - F.col("peak_time")).alias("decay"))


def weighted_null(df: DataFrame, group: list[str], value: str, se: str) -> DataFrame:
    """Inverse-variance mean of each group, its chi-square over the rows, and rows within 1.96 errors."""
    w = 1 / (F.col(se) * F.col(se))
    m = df.groupBy(*group).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("mean"))
    d = (F.col(value) - F.col("mean")) / F.col(se)
    return df.join(m, group).groupBy(*group, "mean").agg(F.count("*").alias("n"), F.sum(d * d).alias("chi2"), F.count_if(F.abs(d) <= 1.96).alias("inside"))


def unthin(q_observed: Column, keep: float) -> Column:
    """Binomial un-thinning: q * p / (1 - q * (1 - p))."""
    return q_observed * keep / (1 - q_observed * (1 - keep))


def corrected(df: DataFrame, keep: float) -> DataFrame:
    """Corrections of labels (label, q, r, possible, total): un-thinned q, predicted completeness, floor and exact mean."""
    q = unthin(F.col("q"), keep)
    return df.select("label", q.alias("q_true"), ((1 - F.pow("q", "r")) / (1 - F.pow(q, F.col("r")))).alias("predicted"), (1 - F.pow("q", "r")).alias("floor"), (F.col("total") / (keep * F.col("possible"))).alias("exact_mean"))


def paired_pulse_ratio(u: Column, gap: Column, tau: Column) -> Column:
    """Ratio of the second to the first response of a depressing synapse from rest."""
    return 1 - u * F.exp(-gap / tau)


def train_resource(u: Column, gap: Column, tau: Column, pulses: int) -> Column:
    """Resources before each pulse of a train, R <- 1 - (1 - R (1 - U)) c, as an array from 1."""
    c = F.exp(-gap / tau)
    steps = F.sequence(F.lit(2), F.lit(pulses)) if pulses > 1 else F.array()
    return F.aggregate(steps, F.array(F.lit(1.0)), lambda acc, _: F.array_append(acc, 1 - (1 - F.element_at(acc, -1) * (1 - u)) * c))


def train_steady_state(u: Column, gap: Column, tau: Column) -> Column:
    c = F.exp(-gap / tau)
    return (1 - c) / (1 - (1 - u) * c)


def lif_rate(current: Column, resistance: float, threshold_mv: float, tau_ms: float, refractory_ms: float) -> Column:
    """Steady-state firing rate (Hz) of a leaky integrator, 0 at or below rheobase."""
    drive = current * resistance
    return F.when(drive > threshold_mv, 1000.0 / (refractory_ms + tau_ms * F.log(drive / (drive - threshold_mv)))).otherwise(0.0)


def grouped_curves(df: DataFrame, specimen: str, x: str, y: str) -> DataFrame:
    """(specimen, curve) with values in order of x; ``shared`` tells whether all specimens have one grid."""
    lists = df.groupBy(specimen).agg(F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))).alias("p"))
    grids = lists.select(F.transform("p", lambda s: s["x"]).alias("g")).distinct().agg((F.count("*") == 1).alias("shared"))
    return lists.join(F.broadcast(grids)).select(specimen, F.transform("p", lambda s: s["y"]).alias("curve"), "shared")


def sensitivity(df: DataFrame, value: str, others: list[str], factors: tuple[float, ...], registered: float) -> DataFrame:
    """(factor, median, rho_<other>..., invariant): ``value`` times registered / factor for each factor: its median, and its rank
    correlation with the other columns, which such a rescaling must not move."""
    rows = []
    for f in factors:
        own = df.withColumn("_v", F.col(value) * (registered / f))
        row = ordered.quantiles(own, [], "_v", (0.5,)).select(F.lit(float(f)).alias("factor"), F.get("q", F.lit(0)).alias("median"))
        for o in others:
            row = row.join(F.broadcast(spearman(own, "_v", o).select(F.col("rho").alias(f"rho_{o}"))))
        rows.append(row)
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    steady = F.lit(True)
    for o in others:
        steady = steady & F.coalesce(F.max(f"rho_{o}") - F.min(f"rho_{o}") <= 1e-9, F.lit(True))
    out = ordered.cut(out)  # a row for each factor
    return out.join(F.broadcast(out.agg(steady.alias("invariant"))), F.lit(True))
