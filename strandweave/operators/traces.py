"""Ordered analytics on traces: one row per sample (key, i, t_us, value), i counting from 0 within a key.

Windows are partitioned by key, so keys run in parallel.  What carries a state along a key (peaks, the exponential
filter, sustained runs, unwrapped angles) or needs a bounded neighbourhood (trailing means) is spread over tasks within a key too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandweave.operators import scan

#: Samples of one key to a task where only a bounded neighbourhood counts.
BLOCK = 1 << 18


def by_key(key: str = "key", order: str = "i") -> Window:
    return Window.partitionBy(key).orderBy(order)


def numbered(rows: DataFrame, key: str, order: list[str], **columns: Column) -> DataFrame:
    """Samples (key, i, ...) in the given order."""
    i = (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("bigint")
    return rows.select(F.col(key).alias("key"), i.alias("i"), *[c.alias(n) for n, c in columns.items()])


def trailing_min(value: Column, width: int, current: bool, w: Window | None = None) -> Column:
    """Least of the last ``width`` samples, with or without the current one."""
    w = by_key() if w is None else w
    return F.min(value).over(w.rowsBetween(-(width - 1), 0) if current else w.rowsBetween(-width, -1))


def with_halo(rows: DataFrame, place: Column, block: int, before: int, after: int) -> DataFrame:
    """``rows`` dealt into blocks of ``block`` along ``place``, with those up to ``before`` in front of a block and ``after`` behind
    it once more: ``_block``, and ``_own`` for the block that a row belongs to.  A row without a place is in block null."""
    home = F.floor(place / block)
    each = F.sequence(F.floor((place - after) / block), F.floor((place + before) / block))
    dealt = rows.withColumn("_home", home).withColumn("_block", F.explode(F.coalesce(each, F.array(F.lit(None).cast("bigint")))))
    return dealt.withColumn("_own", F.col("_block").eqNullSafe(F.col("_home"))).drop("_home")


def is_peak(value: Column, w: Window | None = None) -> Column:
    """v[i] >= v[i-1] and v[i] > v[i+1]: of a plateau the last sample; never the first or last of a trace."""
    w = by_key() if w is None else w
    return F.coalesce((value >= F.lag(value).over(w)) & (value > F.lead(value).over(w)), F.lit(False))


def peaks(trace: DataFrame, prominence: float, width: int, refractory: int, least: float | None = None) -> DataFrame:
    """(key, i, value) of peaks that rise ``prominence`` above the ``width`` samples before them and lie more
    than ``refractory`` samples behind the last accepted one.

    Candidates are found in blocks of one key, and accepted by a scan along it, so a long trace is spread over tasks.
    A null sample is no peak, and neither are its neighbours.
    """
    near = with_halo(trace.select("key", "i", "value"), F.col("i"), BLOCK, max(width, 1), 1)
    w = Window.partitionBy("key", "_block").orderBy("i")
    rise = F.col("value") - trailing_min(F.col("value"), width, False, w)
    found = near.withColumn("_ok", is_peak(F.col("value"), w) & (rise >= prominence)).where("_ok and _own")
    found = found.where(F.col("value") >= least) if least is not None else found
    i, value = (trace.schema[c].dataType.simpleString() for c in ("i", "value"))
    return scan.along(found.select("key", "i", "value"), "i", scan.Refractory(refractory), f"i {i}, value {value}")


def intervals(events: DataFrame, at: str = "t_us") -> DataFrame:
    """Events with ``interval``, the time since the one before (null for the first)."""
    return events.withColumn("interval", F.col(at) - F.lag(at).over(Window.partitionBy("key").orderBy(at)))


def adaptation(events: DataFrame, at: str = "t_us") -> DataFrame:
    """Per key: first, last and least interval; mean of the last third over that of the first, and their index.

    Below four intervals ratio and index are null.
    """
    x = intervals(events, at).where("interval is not null")
    w = Window.partitionBy("key")
    x = x.withColumn("_r", F.row_number().over(w.orderBy(at))).withColumn("_n", F.count("*").over(w))
    third = F.greatest(F.lit(1), F.floor(F.col("_n") / 3))
    early, late = F.avg(F.when(F.col("_r") <= F.col("_t"), F.col("interval"))), F.avg(F.when(F.col("_r") > F.col("_n") - F.col("_t"), F.col("interval")))
    out = x.withColumn("_t", third).groupBy("key").agg(
        F.count("*").alias("n_intervals"), F.min_by("interval", "_r").alias("first_interval"), F.max_by("interval", "_r").alias("last_interval"), F.min("interval").alias("least_interval"), early.alias("_e"), late.alias("_l")
    )
    enough = F.col("n_intervals") >= 4
    return out.select("key", "n_intervals", "first_interval", "last_interval", "least_interval", F.when(enough & (F.col("_e") != 0), F.col("_l") / F.col("_e")).alias("ratio"), F.when(enough & (F.col("_l") + F.col("_e") != 0), (F.col("_l") - F.col("_e")) / (F.col("_l") + F.col("_e"))).alias("index"))


def trailing_rate(count: Column, samples: int, sample_ms: float) -> Column:
    """Events a second over the last ``samples`` samples, fewer at the start."""
    w = by_key().rowsBetween(-(samples - 1), 0)
    return F.sum(count).over(w) * 1000.0 / (F.count(count).over(w) * sample_ms)


def padded_mean(value: Column, left: int, right: int) -> Column:
    """Mean of ``left`` samples before to ``right`` after, the edge values standing for what is missing."""
    w, all_of = by_key(), Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inside = F.sum(value).over(w.rowsBetween(-left, right))
    before = F.greatest(F.lit(0), left - F.col("i"))
    after = F.greatest(F.lit(0), F.col("i") + right - (F.count("*").over(Window.partitionBy("key")) - 1))
    return (inside + before * F.first(value).over(all_of) + after * F.last(value).over(all_of)) / (left + right + 1)


def symmetric_mean(value: Column, width: int) -> Column:
    return padded_mean(value, width // 2, width // 2)


def exact_mean(value: Column, width: int) -> Column:
    return padded_mean(value, width // 2, width - 1 - width // 2)


def unwrap(trace: DataFrame, angle: str, out: str) -> DataFrame:
    """(key, i, ``out``): the angle (radians) without jumps, the first one plus the sum of differences wrapped to half a turn each way.

    A null angle gives null and is passed over.
    """
    own = trace.select("key", "i", F.col(angle).cast("double").alias("angle"))
    return scan.along(own, "i", scan.Unwrapped(out), f"i {own.schema['i'].dataType.simpleString()}, angle double, {out} double").select("key", "i", out)


def true_blocks(trace: DataFrame, holds: Column) -> DataFrame:
    """(key, first, last, samples) of each contiguous stretch where the condition holds."""
    own = trace.withColumn("_ok", F.coalesce(holds, F.lit(False)))
    island = F.col("i") - F.row_number().over(Window.partitionBy("key", "_ok").orderBy("i"))
    return own.withColumn("_g", island).where("_ok").groupBy("key", "_g").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count("*").alias("samples")).drop("_g")


def first_true_block(trace: DataFrame, holds: Column) -> DataFrame:
    return true_blocks(trace, holds).groupBy("key").agg(F.min("first").alias("first"), F.min_by("last", "first").alias("last"))


def longest_sustained(trace: DataFrame, holds: Column) -> DataFrame:
    """(key, sustained_us): each holding sample adds the time since the sample before it; the first adds none.

    A condition that is null does not hold; samples without a time are left out.
    """
    own = trace.where("t_us is not null").select("key", "i", F.col("t_us").cast("bigint").alias("t_us"), F.coalesce(holds, F.lit(False)).alias("ok"))
    return scan.along(own, "i", scan.Sustained(), "sustained_us bigint").groupBy("key").agg(F.max("sustained_us").alias("sustained_us"))


def step_window(trace: DataFrame) -> DataFrame:
    """(key, first, last, level, valid) of the one square pulse: non-zero samples must be contiguous and of one level."""
    on = trace.where("value <> 0").groupBy("key").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count("*").alias("n"), F.count_distinct("value").alias("levels"), F.max("value").alias("level"))
    return on.select("key", "first", "last", "level", ((F.col("last") - F.col("first") + 1 == F.col("n")) & (F.col("levels") == 1)).alias("valid"))


def monotone(trace: DataFrame, column: str, strictly: bool = False, falling: bool = False) -> DataFrame:
    before = F.lag(column).over(by_key())
    x, y = (before, F.col(column)) if falling else (F.col(column), before)
    step = trace.withColumn("_ok", F.coalesce(x > y if strictly else x >= y, F.lit(True)))
    return step.groupBy("key").agg(F.bool_and("_ok").alias("monotone"))


def gradient(value: Column, at: Column) -> Column:
    """Central difference, one-sided at the ends; null for a single sample."""
    w = by_key()
    v0, v1, t0, t1 = F.lag(value).over(w), F.lead(value).over(w), F.lag(at).over(w), F.lead(at).over(w)
    return (F.coalesce(v1, value) - F.coalesce(v0, value)) / F.nullif((F.coalesce(t1, at) - F.coalesce(t0, at)).cast("double"), F.lit(0.0))


def first_crossing(trace: DataFrame, events: DataFrame, slope: float, span: int) -> DataFrame:
    """(key, i, at, threshold_value): per event the first sample in [i - span, i] whose slope reaches the criterion.

    ``trace`` has a column ``slope``.  Samples are dealt into blocks of ``span`` so that the interval join is an equi-join.
    """
    s = trace.where(F.col("slope") >= slope).select("key", F.col("i").alias("at"), F.col("value").alias("v")).withColumn("_b", F.floor(F.col("at") / (span + 1)))
    e = events.select("key", "i").withColumn("_b", F.explode(F.array(F.floor(F.col("i") / (span + 1)), F.floor(F.col("i") / (span + 1)) - 1)))
    return e.join(s, ["key", "_b"]).where((F.col("at") <= F.col("i")) & (F.col("at") >= F.col("i") - span)).groupBy("key", "i").agg(F.min("at").alias("at"), F.min_by("v", "at").alias("threshold_value"))


def masked_median(trace: DataFrame, events: DataFrame, halfwidth: int) -> DataFrame:
    """(key, median, samples) of samples farther than ``halfwidth`` from every event."""
    near = events.select("key", F.explode(F.sequence(F.col("i") - halfwidth, F.col("i") + halfwidth)).alias("i")).distinct()
    return trace.join(near, ["key", "i"], "left_anti").groupBy("key").agg(F.median("value").alias("median"), F.count("*").alias("samples"))


def event_amplitudes(trace: DataFrame, events: DataFrame, width: int) -> DataFrame:
    """(key, median_amplitude): event value minus the least of the last ``width`` samples with it."""
    based = trace.withColumn("_low", trailing_min(F.col("value"), width, current=True))
    return based.join(events.select("key", "i"), ["key", "i"], "left_semi").groupBy("key").agg(F.median(F.col("value") - F.col("_low")).alias("median_amplitude"), F.count("*").alias("events"))


def contains_in_order(rows: DataFrame, key: str, order: list[str], state: str, wanted: list[str]) -> DataFrame:
    """(key, contained): whether the states occur in this order, others between them allowed."""
    lists = rows.where(F.col(state).isin(*wanted)).groupBy(F.col(key).alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(state).alias("_s")))), lambda x: x["_s"]).alias("s"))
    array = F.array(*[F.lit(x) for x in wanted])
    done = F.aggregate("s", F.lit(0), lambda n, x: F.when(x == F.get(array, n), n + 1).otherwise(n))
    return rows.select(F.col(key).alias("key")).distinct().join(lists.withColumn("_n", done), "key", "left").select("key", (F.coalesce("_n", F.lit(0)) == len(wanted)).alias("contained"))


def decayed_sum(value: Column, span: int, decay: float) -> Column:
    """Sum over k < span of value k samples ago times decay ** k."""
    recent = F.collect_list(value).over(by_key().rowsBetween(-(span - 1), 0))
    return F.aggregate(recent, F.lit(0.0), lambda acc, x: acc * decay + x)


def exponential_filter(trace: DataFrame, value: Column, a: float, out: str) -> DataFrame:
    """(key, i, ``out``): r[i] = r[i-1] * a + x[i] * (1 - a), from 0.

    A null sample changes nothing: r keeps its value, 0 before the first sample.  A NaN stays in r.
    """
    own = trace.select("key", "i", value.cast("double").alias("x"))
    return scan.along(own, "i", scan.Affine(a, "i", out), f"i {own.schema['i'].dataType.simpleString()}, {out} double")


def time_means(trace: DataFrame, value: Column, width_us: int, out: str) -> DataFrame:
    """``trace`` with ``out``, the mean over the last ``width_us`` with the current sample and those of its time.

    A key is dealt into stretches of at least ``width_us``, each with what it looks back to.
    """
    near = with_halo(trace.withColumn("_value", value), F.col("t_us"), max(1, width_us) * 8, width_us, 0)
    mean = F.avg("_value").over(Window.partitionBy("key", "_block").orderBy("t_us").rangeBetween(-width_us, 0))
    return near.withColumn(out, mean).where("_own").drop("_value", "_block", "_own")


def baseline_thresholds(trace: DataFrame, width_us: int, k_on: float, k_off: float, floor: float) -> DataFrame:
    """(key, trigger, release): mean plus k deviations (population, at least ``floor``) of the first ``width_us``."""
    start = F.min("t_us").over(Window.partitionBy("key"))
    early = trace.withColumn("_s", start).where(F.col("t_us") - F.col("_s") <= width_us)
    base = early.groupBy("key").agg(F.avg("value").alias("_m"), F.greatest(F.stddev_pop("value"), F.lit(floor)).alias("_d"))
    return base.select("key", (F.col("_m") + k_on * F.col("_d")).alias("trigger"), (F.col("_m") + k_off * F.col("_d")).alias("release"))


def as_of(queries: DataFrame, trace: DataFrame) -> DataFrame:
    """(key, q_us, i): the first sample at or after each moment, the last one beyond the end.

    Both sides go through one sort by key and time.
    """
    both = trace.select("key", F.col("t_us").alias("_t"), F.lit(1).alias("_k"), "i").unionByName(queries.select("key", F.col("q_us").alias("_t"), F.lit(0).alias("_k"), F.lit(None).cast("bigint").alias("i")))
    ahead = F.first("i", ignorenulls=True).over(Window.partitionBy("key").orderBy("_t", "_k").rowsBetween(0, Window.unboundedFollowing))
    final = F.max("i").over(Window.partitionBy("key"))
    return both.withColumn("_a", F.coalesce(ahead, final)).where("_k = 0 and _a is not null").select("key", F.col("_t").alias("q_us"), F.col("_a").alias("i"))


def within(samples: DataFrame, epochs: DataFrame, width_us: int) -> DataFrame:
    """Samples joined to the epochs (key, epoch, lo, hi) that hold them; epochs are spread over time blocks to join by equality."""
    e = epochs.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / width_us), F.floor(F.col("hi") / width_us))))
    return samples.withColumn("_b", F.floor(F.col("t_us") / width_us)).join(e, ["key", "_b"]).where(F.col("t_us").between(F.col("lo"), F.col("hi"))).drop("_b")


def aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, rank, left_us, right_us, difference): the n-th event of one side beside the n-th of the other."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy("t_us"))
    a = left.select("key", rank.alias("rank"), F.col("t_us").alias("left_us"))
    b = right.select("key", rank.alias("rank"), F.col("t_us").alias("right_us"))
    return a.join(b, ["key", "rank"], "full_outer").withColumn("difference", F.abs(F.col("left_us") - F.col("right_us")))


def reduced(trace: DataFrame, x: str, y: str, quiet_us: int) -> DataFrame:
    """One row per key: samples, peak, first and last value, displacement (whole and up to ``quiet_us`` after the start)."""
    start = F.min("t_us").over(Window.partitionBy("key"))
    own = trace.withColumn("_quiet", F.col("t_us") - start <= quiet_us).withColumn("_p", F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))
    quiet = F.when(F.col("_quiet"), F.col("t_us"))
    out = own.groupBy("key").agg(
        F.count("*").alias("samples"), F.max("value").alias("peak"), F.min_by("value", "t_us").alias("first_value"), F.max_by("value", "t_us").alias("last_value"),
        F.min_by("_p", "t_us").alias("_a"), F.max_by("_p", "t_us").alias("_z"), F.max_by("_p", quiet).alias("_q"),
    )
    gap = lambda p, q: F.hypot(F.col(f"{q}.x") - F.col(f"{p}.x"), F.col(f"{q}.y") - F.col(f"{p}.y"))
    return out.select("key", "samples", "peak", "first_value", "last_value", gap("_a", "_z").alias("displacement"), gap("_a", "_q").alias("quiet_displacement"))


def counter_rates(counters: DataFrame, window_s: float) -> DataFrame:
    """Per (pool, t): members, events, mean rate, active fraction and largest rate, from cumulative counts (pool, node, t, total).

    ``backward`` counts counters that fell, which is an error of the source.
    """
    d = F.col("total") - F.lag("total").over(Window.partitionBy("pool", "node").orderBy("t"))
    own = counters.withColumn("_d", F.coalesce(d, F.col("total")))
    return own.groupBy("pool", "t").agg(
        F.count("*").alias("bodies"), F.sum("_d").cast("bigint").alias("events"), (F.sum("_d") / F.count("*") / window_s).alias("mean_rate"),
        (F.count_if(F.col("_d") != 0) / F.count("*")).alias("active_fraction"), (F.max("_d") / window_s).alias("max_rate"), F.count_if(F.col("_d") < 0).alias("backward"),
    )


def event_rates(ids: DataFrame, events: DataFrame, seconds: float) -> DataFrame:
    """(key, rate) with 0 for ids without events."""
    counts = events.groupBy("key").agg(F.count("*").alias("_n"))
    return ids.select("key").distinct().join(counts, "key", "left").select("key", (F.coalesce("_n", F.lit(0)) / seconds).alias("rate"))


def trial_rates(trials: DataFrame, ids: DataFrame, events: DataFrame, seconds: float) -> DataFrame:
    """(key, mean_rate, sd_rate) over all trials, those without events counting 0; population deviation."""
    counts = events.groupBy("key", "trial").agg(F.count("*").alias("_n"))
    # Trials without events add nothing but their number, so ids and trials need not be crossed.
    number = trials.select("trial").distinct()
    known = counts.join(number, "trial", "left_semi").groupBy("key").agg(F.sum("_n").alias("_s"), F.sum(F.col("_n") * F.col("_n")).alias("_q"))
    n = number.count()
    own = ids.select("key").distinct().join(known, "key", "left")
    mean, square = F.coalesce("_s", F.lit(0)) / F.lit(n), F.coalesce("_q", F.lit(0)) / F.lit(n)
    return own.select("key", (mean / seconds).alias("mean_rate"), (F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))) / seconds).alias("sd_rate"))


def raster(points: DataFrame, x: Column, y: Column, width: int, height: int, weight: Column, halo: float = 0.5) -> DataFrame:
    """(ix, iy, total): rounded to pixels, those outside left out; each point also gives ``halo`` of its weight to its four neighbours."""
    own = points.select(F.bround(x).cast("int").alias("x0"), F.bround(y).cast("int").alias("y0"), weight.cast("double").alias("w"))
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(k).alias("k")) for dx, dy, k in ((0, 0, 1.0), (1, 0, halo), (-1, 0, halo), (0, 1, halo), (0, -1, halo))])
    spread = own.select("x0", "y0", "w", F.explode(offsets).alias("o")).select((F.col("x0") + F.col("o.dx")).alias("ix"), (F.col("y0") + F.col("o.dy")).alias("iy"), (F.col("w") * F.col("o.k")).alias("v"))
    return spread.where(F.col("ix").between(0, width - 1) & F.col("iy").between(0, height - 1)).groupBy("ix", "iy").agg(F.sum("v").alias("total"))


def sign_agreement(rows: DataFrame, active: Column, cue: Column, response: Column) -> DataFrame:
    """(rows, mean_response, agreement): over active rows, the share whose response has the cue's sign."""
    own = rows.where(active)
    return own.agg(F.count("*").alias("rows"), F.avg(response).alias("mean_response"), F.avg((F.signum(cue) == F.signum(response)).cast("double")).alias("agreement"))


def quantised_delay(delay_us: Column, coupling_us: int) -> Column:
    return F.when(delay_us <= 0, F.lit(0)).otherwise(F.ceil(delay_us / coupling_us) * coupling_us).cast("bigint")
