"""Ordered analytics on ``events``: each user's values in time are one trace."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.operators import traces as W
from strandweave.plans._registry import query, table

_TR = """
tr AS MATERIALIZED (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, epoch_us(ts) AS t_us, value, event_id, event_type FROM events),
lm AS MATERIALIZED (SELECT *, lag(value) OVER k AS pv, lead(value) OVER k AS nv, min(value) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS low FROM tr WINDOW k AS (PARTITION BY key ORDER BY i)),
cand AS MATERIALIZED (SELECT key, i, value FROM lm WHERE value >= pv AND value > nv AND value - low >= 10),
pk AS (SELECT key, min(i) AS i FROM cand GROUP BY key UNION ALL SELECT p.key, (SELECT min(c.i) FROM cand c WHERE c.key = p.key AND c.i - p.i > 3) FROM pk p WHERE p.i IS NOT NULL),
peaks AS MATERIALIZED (SELECT pk.key, pk.i, cand.value FROM pk JOIN cand ON cand.key = pk.key AND cand.i = pk.i)"""
_ISI = "isi AS (SELECT key, t_us - lag(t_us) OVER (PARTITION BY key ORDER BY t_us) AS interval, t_us FROM tr)"


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    return W.numbered(events, "user_id", ["ts", "event_id"], t_us=F.unix_micros("ts"), value=F.col("value"), event_id=F.col("event_id"), event_type=F.col("event_type"))


def _peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.peaks(trace(spark, sf_dir), 10.0, 5, 3)


@query(f"WITH RECURSIVE {_TR} SELECT key, i, low FROM lm")
def sliding_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:  # W01
    return trace(spark, sf_dir).select("key", "i", W.trailing_min(F.col("value"), 5, current=False).alias("low"))


@query(f"WITH RECURSIVE {_TR} SELECT key, i, value FROM lm WHERE value >= pv AND value > nv")
def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:  # W02
    return trace(spark, sf_dir).withColumn("p", W.is_peak(F.col("value"))).where("p").select("key", "i", "value")


@query(f"WITH RECURSIVE {_TR} SELECT key, i, value FROM peaks")
def spike_detect(spark: SparkSession, sf_dir: str) -> DataFrame:  # W03
    return _peaks(spark, sf_dir)


@query(f"WITH RECURSIVE {_TR}, {_ISI} SELECT key, t_us, interval FROM isi")
def isi(spark: SparkSession, sf_dir: str) -> DataFrame:  # W04
    return W.intervals(trace(spark, sf_dir)).select("key", "t_us", "interval")


@query(f"""WITH RECURSIVE {_TR}, {_ISI}, x AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t_us) AS r, count(*) OVER (PARTITION BY key) AS n FROM isi WHERE interval IS NOT NULL),
g AS (SELECT key, count(*) AS n_intervals, arg_min(interval, r) AS first_interval, arg_max(interval, r) AS last_interval, min(interval) AS least_interval,
avg(interval) FILTER (WHERE r <= greatest(1, n // 3)) AS e, avg(interval) FILTER (WHERE r > n - greatest(1, n // 3)) AS l FROM x GROUP BY key)
SELECT key, n_intervals, first_interval, last_interval, least_interval, CASE WHEN n_intervals >= 4 THEN round(l / e, 9) END AS ratio, CASE WHEN n_intervals >= 4 THEN round((l - e) / (l + e), 9) END AS index FROM g""")
def adaptation(spark: SparkSession, sf_dir: str) -> DataFrame:  # W05 W06
    return W.adaptation(trace(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("ratio", "index")})


@query(f"WITH RECURSIVE {_TR}, {_ISI} SELECT key, min(interval) AS least_interval FROM isi GROUP BY key")
def min_isi(spark: SparkSession, sf_dir: str) -> DataFrame:  # W06
    return W.intervals(trace(spark, sf_dir)).groupBy("key").agg(F.min("interval").alias("least_interval"))


@query(f"WITH RECURSIVE {_TR} SELECT key, i, round(sum((value > 20)::INTEGER) OVER w * 1000.0::DOUBLE / (count(*) OVER w * 15), 9) AS rate FROM tr WINDOW w AS (PARTITION BY key ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)")
def trailing_rate(spark: SparkSession, sf_dir: str) -> DataFrame:  # W07
    return trace(spark, sf_dir).select("key", "i", F.round(W.trailing_rate((F.col("value") > 20).cast("int"), 8, 15.0), 9).alias("rate"))


_PAD = """(sum(value) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN {l} PRECEDING AND {r} FOLLOWING) + greatest(0, {l} - i) * first(value) OVER f
 + greatest(0, i + {r} - (count(*) OVER (PARTITION BY key) - 1)) * last(value) OVER f) / {n}"""


@query(f"""WITH RECURSIVE {_TR} SELECT key, i, round({_PAD.format(l=2, r=2, n=5)}, 6) AS symmetric, round({_PAD.format(l=2, r=1, n=4)}, 6) AS exact
FROM tr WINDOW f AS (PARTITION BY key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def moving_average_edge(spark: SparkSession, sf_dir: str) -> DataFrame:  # W08
    v = F.col("value")
    return trace(spark, sf_dir).select("key", "i", F.round(W.symmetric_mean(v, 4), 6).alias("symmetric"), F.round(W.exact_mean(v, 4), 6).alias("exact"))


@query(f"""WITH RECURSIVE {_TR}, a AS (SELECT key, i, value - 2 * pi() * floor((value + pi()) / (2 * pi())) AS angle FROM tr),
d AS (SELECT *, angle - lag(angle) OVER (PARTITION BY key ORDER BY i) AS d FROM a)
SELECT key, i, round(first(angle) OVER k + sum(coalesce(d - 2 * pi() * floor((d + pi()) / (2 * pi())), 0)) OVER k, 6) AS unwrapped FROM d WINDOW k AS (PARTITION BY key ORDER BY i)""")
def angle_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:  # W09
    angle = F.col("value") - 2 * math.pi * F.floor((F.col("value") + math.pi) / (2 * math.pi))
    return W.unwrap(trace(spark, sf_dir).withColumn("angle", angle), "angle", "unwrapped").select("key", "i", F.round("unwrapped", 6).alias("unwrapped"))


_ISLAND = "isl AS (SELECT *, i - row_number() OVER (PARTITION BY key, value >= 15 ORDER BY i) AS g, t_us - lag(t_us) OVER (PARTITION BY key ORDER BY i) AS dt FROM tr)"


@query(f"WITH RECURSIVE {_TR}, {_ISLAND}, b AS (SELECT key, min(i) AS first, max(i) AS last FROM isl WHERE value >= 15 GROUP BY key, g) SELECT key, min(first) AS first, arg_min(last, first) AS last FROM b GROUP BY key")
def first_true_block(spark: SparkSession, sf_dir: str) -> DataFrame:  # W10
    return W.first_true_block(trace(spark, sf_dir), F.col("value") >= 15)


@query(f"WITH RECURSIVE {_TR} SELECT key, min(i) AS first, max(i) AS last, max(lv) AS level, max(i) - min(i) + 1 = count(*) AND count(DISTINCT lv) = 1 AS valid FROM (SELECT key, i, CASE WHEN i BETWEEN 10 AND 20 + key % 3 THEN 5.0::DOUBLE WHEN i = 30 AND key % 5 = 0 THEN 5.0 ELSE 0 END AS lv FROM tr) WHERE lv <> 0 GROUP BY key")
def step_window(spark: SparkSession, sf_dir: str) -> DataFrame:  # W11
    level = F.when(F.col("i").between(10, 20 + F.col("key") % 3), 5.0).when((F.col("i") == 30) & (F.col("key") % 5 == 0), 5.0).otherwise(0.0)
    return W.step_window(trace(spark, sf_dir).withColumn("value", level))


@query(f"WITH RECURSIVE {_TR}, {_ISLAND}, s AS (SELECT key, value >= 15 AS ok, g, sum(coalesce(dt, 0)) AS s FROM isl GROUP BY ALL) SELECT key, coalesce(max(s) FILTER (WHERE ok), 0)::BIGINT AS sustained_us FROM s GROUP BY key")
def longest_sustained(spark: SparkSession, sf_dir: str) -> DataFrame:  # W12
    return W.longest_sustained(trace(spark, sf_dir), F.col("value") >= 15)


@query(f"WITH RECURSIVE {_TR} SELECT key, bool_and(coalesce(t_us > p, true)) AS monotone FROM (SELECT key, t_us, lag(t_us) OVER (PARTITION BY key ORDER BY i) AS p FROM tr) GROUP BY key")
def strictly_increasing_time(spark: SparkSession, sf_dir: str) -> DataFrame:  # W13 P06
    return W.monotone(trace(spark, sf_dir), "t_us", strictly=True)


_GR = "gr AS (SELECT *, (coalesce(nv, value) - coalesce(pv, value)) / nullif((coalesce(lead(t_us) OVER k, t_us) - coalesce(lag(t_us) OVER k, t_us))::DOUBLE, 0) * 1e9 AS slope FROM lm WINDOW k AS (PARTITION BY key ORDER BY i))"


@query(f"WITH RECURSIVE {_TR}, {_GR} SELECT key, i, round(slope, 6) AS slope FROM gr")
def gradient(spark: SparkSession, sf_dir: str) -> DataFrame:  # W14
    return trace(spark, sf_dir).select("key", "i", F.round(W.gradient(F.col("value"), F.col("t_us")) * 1e9, 6).alias("slope"))


@query(f"""WITH RECURSIVE {_TR}, {_GR} SELECT p.key, p.i, min(g.i) AS at, arg_min(g.value, g.i) AS threshold_value FROM peaks p JOIN gr g ON g.key = p.key AND g.i BETWEEN p.i - 4 AND p.i AND g.slope >= 1 GROUP BY ALL""")
def threshold_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:  # W15
    own = trace(spark, sf_dir).withColumn("slope", W.gradient(F.col("value"), F.col("t_us")) * 1e9)
    return W.first_crossing(own, _peaks(spark, sf_dir), 1.0, 4)


@query(f"WITH RECURSIVE {_TR} SELECT key, round(median(value), 9) AS median, count(*) AS samples FROM tr WHERE NOT EXISTS (SELECT 1 FROM peaks p WHERE p.key = tr.key AND abs(p.i - tr.i) <= 2) GROUP BY key")
def masked_median(spark: SparkSession, sf_dir: str) -> DataFrame:  # W16
    return W.masked_median(trace(spark, sf_dir), _peaks(spark, sf_dir), 2).withColumn("median", F.round("median", 9))


@query(f"""WITH RECURSIVE {_TR}, a AS (SELECT key, i, value - min(value) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS amp FROM tr)
SELECT a.key, round(median(amp), 9) AS median_amplitude, count(*) AS events FROM a JOIN peaks p ON p.key = a.key AND p.i = a.i GROUP BY a.key""")
def event_amplitude(spark: SparkSession, sf_dir: str) -> DataFrame:  # W17
    return W.event_amplitudes(trace(spark, sf_dir), _peaks(spark, sf_dir), 6).withColumn("median_amplitude", F.round("median_amplitude", 9))


@query("SELECT user_id AS key, regexp_matches(coalesce(string_agg(event_type, ',' ORDER BY ts, event_id), ''), 'signup.*error.*purchase.*signup.*purchase.*purchase.*error.*error.*signup') AS contained FROM events GROUP BY user_id")
def ordered_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:  # W18
    wanted = ["signup", "error", "purchase", "signup", "purchase", "purchase", "error", "error", "signup"]
    return W.contains_in_order(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", wanted)


@query(f"""WITH RECURSIVE {_TR} SELECT key, i, round({' + '.join(f'coalesce(lag((value > 20)::INTEGER, {k}) OVER k, 0) * {0.8**k!r}::DOUBLE' for k in range(6))}, 9) AS glow FROM tr WINDOW k AS (PARTITION BY key ORDER BY i)""")
def decayed_sum(spark: SparkSession, sf_dir: str) -> DataFrame:  # W19
    return trace(spark, sf_dir).select("key", "i", F.round(W.decayed_sum((F.col("value") > 20).cast("double"), 6, 0.8), 9).alias("glow"))


@query(f"""WITH RECURSIVE {_TR} SELECT key, i, round(sum(ln(3.5 + value)) OVER k, 6) AS log_product, round(sum(ln((3.5 + i) / (i + 1))) OVER k, 6) AS log_binomial
FROM tr WHERE value >= 0 WINDOW k AS (PARTITION BY key ORDER BY i)""")
def cumulative_product_table(spark: SparkSession, sf_dir: str) -> DataFrame:  # W20
    own, upto = trace(spark, sf_dir).where("value >= 0"), W.by_key()
    total = lambda x: F.round(F.sum(x).over(upto), 6)
    return own.select("key", "i", total(F.ln(3.5 + F.col("value"))).alias("log_product"), total(F.ln((3.5 + F.col("i")) / (F.col("i") + 1))).alias("log_binomial"))


@query(f"""WITH RECURSIVE {_TR}, q AS (SELECT *, min(t_us) OVER (PARTITION BY key) AS s FROM tr),
g AS (SELECT key, count(*) AS samples, max(value) AS peak, arg_min(value, t_us) AS first_value, arg_max(value, t_us) AS last_value,
arg_min(value, t_us) AS ax, arg_min(event_id % 100, t_us) AS ay, arg_max(value, t_us) AS zx, arg_max(event_id % 100, t_us) AS zy,
arg_max(value, t_us) FILTER (WHERE t_us - s <= 86400000000) AS qx, arg_max(event_id % 100, t_us) FILTER (WHERE t_us - s <= 86400000000) AS qy FROM q GROUP BY key)
SELECT key, samples, peak, first_value, last_value, round(sqrt((zx - ax) ** 2 + (zy - ay) ** 2), 6) AS displacement, round(sqrt((qx - ax) ** 2 + (qy - ay) ** 2), 6) AS quiet_displacement FROM g""")
def trace_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:  # A25 W21 W22
    own = trace(spark, sf_dir).withColumn("x", F.col("value")).withColumn("y", F.col("event_id") % 100)
    return W.reduced(own, "x", "y", 86_400_000_000).withColumns({c: F.round(c, 6) for c in ("displacement", "quiet_displacement")})


@query(f"""WITH RECURSIVE {_TR}, r AS (SELECT key, count(*) AS rows, avg(value) AS mean, stddev_samp(value) / sqrt(count(*)) AS se FROM tr GROUP BY key), s AS (SELECT key, mean, se, lead(mean) OVER (ORDER BY key) AS nm, lead(se) OVER (ORDER BY key) AS ns FROM r)
SELECT count(*) AS steps, count(*) FILTER (WHERE nm >= mean OR abs(nm - mean) <= 1.96 * (se + ns)) AS agreeing FROM s WHERE nm IS NOT NULL""")
def adjacent_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:  # W23
    from strandweave.operators.ordered import with_next

    r = trace(spark, sf_dir).groupBy("key").agg(F.struct(F.avg("value").alias("m"), (F.stddev_samp("value") / F.sqrt(F.count("*"))).alias("s")).alias("own"))
    s = with_next(r, ["key"], "own", "next").where("next is not null")
    close = F.abs(F.col("next.m") - F.col("own.m")) <= 1.96 * (F.col("own.s") + F.col("next.s"))
    return s.agg(F.count("*").alias("steps"), F.count_if((F.col("next.m") >= F.col("own.m")) | close).alias("agreeing"))


@query(f"""WITH RECURSIVE {_TR}, f AS (SELECT key, i, value * (1 - 0.7::DOUBLE) AS r FROM tr WHERE i = 0 UNION ALL SELECT tr.key, tr.i, f.r * 0.7::DOUBLE + tr.value * (1 - 0.7::DOUBLE) FROM f JOIN tr ON tr.key = f.key AND tr.i = f.i + 1)
SELECT key, i, round(r, 6) AS filtered FROM f""")
def exp_filter(spark: SparkSession, sf_dir: str) -> DataFrame:  # W24 SM06
    return W.exponential_filter(trace(spark, sf_dir), F.col("value"), 0.7, "filtered").withColumn("filtered", F.round("filtered", 6))


@query(f"WITH RECURSIVE {_TR} SELECT key, i, round(avg(value) OVER (PARTITION BY key ORDER BY t_us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW), 6) AS mean FROM tr")
def windowed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:  # W25
    return W.time_means(trace(spark, sf_dir), F.col("value"), 86_400_000_000, "mean").select("key", "i", F.round("mean", 6).alias("mean"))


@query(f"""WITH RECURSIVE {_TR}, b AS (SELECT key, avg(value) AS m, greatest(stddev_pop(value), 0.5) AS d FROM (SELECT *, min(t_us) OVER (PARTITION BY key) AS s FROM tr) WHERE t_us - s <= 172800000000 GROUP BY key)
SELECT key, round(m + 3 * d, 6) AS "trigger", round(m + 1.5 * d, 6) AS release FROM b""")
def baseline_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:  # W26
    return W.baseline_thresholds(trace(spark, sf_dir), 172_800_000_000, 3.0, 1.5, 0.5).withColumns({c: F.round(c, 6) for c in ("trigger", "release")})


@query(f"""WITH RECURSIVE {_TR}, q AS (SELECT key, min(t_us) - 5 + x * 3600000000 * 50 AS q_us FROM tr, range(0, 20) r(x) GROUP BY key, x), fin AS (SELECT key, max(i) AS last FROM tr GROUP BY key)
SELECT q.key, q.q_us, coalesce((SELECT min(i) FROM tr WHERE tr.key = q.key AND tr.t_us >= q.q_us), last) AS i FROM q JOIN fin USING (key)""")
def asof_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:  # J18
    own = trace(spark, sf_dir)
    q = own.groupBy("key").agg(F.min("t_us").alias("s")).select("key", F.explode(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda x: F.col("s") - 5 + x.cast("bigint") * (3_600_000_000 * 50))).alias("q_us"))
    return W.as_of(q, own)


@query(f"""WITH RECURSIVE {_TR}, e AS (SELECT key, x AS epoch, min(t_us) + x * 400000000000 AS lo, min(t_us) + x * 400000000000 + 90000000000 AS hi FROM tr, range(0, 6) r(x) GROUP BY key, x)
SELECT e.key, epoch, count(*) AS samples, min(t_us) AS first_us FROM e JOIN tr ON tr.key = e.key AND t_us BETWEEN lo AND hi GROUP BY ALL""")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:  # J19 W21
    own = trace(spark, sf_dir)
    e = own.groupBy("key").agg(F.min("t_us").alias("s")).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))))
    e = e.select("key", "epoch", (F.col("s") + F.col("epoch") * 400_000_000_000).alias("lo"), (F.col("s") + F.col("epoch") * 400_000_000_000 + 90_000_000_000).alias("hi"))
    return W.within(own, e, 90_000_000_000).groupBy("key", "epoch").agg(F.count("*").alias("samples"), F.min("t_us").alias("first_us"))


@query(f"""WITH RECURSIVE {_TR}, a AS (SELECT key, t_us, row_number() OVER (PARTITION BY key ORDER BY t_us) AS rank FROM tr WHERE event_type = 'click'), b AS (SELECT key, t_us, row_number() OVER (PARTITION BY key ORDER BY t_us) AS rank FROM tr WHERE event_type = 'view')
SELECT key, rank, a.t_us AS left_us, b.t_us AS right_us, abs(a.t_us - b.t_us) AS difference FROM a FULL OUTER JOIN b USING (key, rank)""")
def backend_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:  # J20
    own = trace(spark, sf_dir)
    out = W.aligned(own.where("event_type = 'click'"), own.where("event_type = 'view'"))
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@query("""WITH c AS (SELECT user_id AS node, user_id % 4 AS pool, dayofyear(ts) AS t, count(*) AS n FROM events GROUP BY ALL), g AS (SELECT node, pool, t, sum(n) OVER (PARTITION BY node ORDER BY t) AS total, n FROM c)
SELECT pool, t, count(*) AS bodies, sum(n)::BIGINT AS events, round(sum(n) / count(*) / 0.5, 9) AS mean_rate, round(count(*) FILTER (WHERE n <> 0) / count(*), 9) AS active_fraction, round(max(n) / 0.5, 9) AS max_rate, 0::BIGINT AS backward FROM g GROUP BY pool, t""")
def population_activity(spark: SparkSession, sf_dir: str) -> DataFrame:  # A19 SM05
    from pyspark.sql.window import Window

    c = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("node"), (F.col("user_id") % 4).alias("pool"), F.dayofyear("ts").cast("bigint").alias("t")).agg(F.count("*").alias("n"))
    counters = c.select("node", "pool", "t", F.sum("n").over(Window.partitionBy("node").orderBy("t")).alias("total"))
    return W.counter_rates(counters, 0.5).withColumns({x: F.round(x, 9) for x in ("mean_rate", "active_fraction", "max_rate")})


@query("SELECT c_custkey AS key, round(count(event_id) / 30.0, 9) AS rate FROM customer LEFT JOIN events ON user_id = c_custkey AND event_type = 'error' GROUP BY ALL")
def windowed_rates(spark: SparkSession, sf_dir: str) -> DataFrame:  # A18
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    events = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("key"))
    return W.event_rates(ids, events, 30.0).withColumn("rate", F.round("rate", 9))


@query("""WITH n AS (SELECT user_id AS key, event_id % 12 AS trial, count(*) AS n FROM events GROUP BY ALL), k AS (SELECT DISTINCT user_id AS key FROM events), t AS (SELECT DISTINCT event_id % 12 AS trial FROM events)
SELECT key, round(avg(coalesce(n, 0) / 2.0), 9) AS mean_rate, round(stddev_pop(coalesce(n, 0) / 2.0), 9) AS sd_rate FROM k CROSS JOIN t LEFT JOIN n USING (key, trial) GROUP BY key""")
def trial_rates(spark: SparkSession, sf_dir: str) -> DataFrame:  # A17
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), (F.col("event_id") % 12).alias("trial"))
    return W.trial_rates(e.select("trial"), e, e, 2.0).withColumns({c: F.round(c, 9) for c in ("mean_rate", "sd_rate")})


@query("""WITH p AS (SELECT round_even(value / 3, 0)::INTEGER AS x, round_even(event_id % 97 / 4.0, 0)::INTEGER AS y FROM events), o(dx, dy, k) AS (VALUES (0, 0, 1.0), (1, 0, 0.5), (-1, 0, 0.5), (0, 1, 0.5), (0, -1, 0.5))
SELECT x + dx AS ix, y + dy AS iy, round(sum(k)::DOUBLE, 6) AS total FROM p, o WHERE x + dx BETWEEN 0 AND 19 AND y + dy BETWEEN 0 AND 19 GROUP BY ALL""")
def raster_bins(spark: SparkSession, sf_dir: str) -> DataFrame:  # A28
    out = W.raster(table(spark, sf_dir, "events"), F.col("value") / 3, (F.col("event_id") % 97) / 4.0, 20, 20, F.lit(1.0))
    return out.withColumn("total", F.round("total", 6))


@query("SELECT count(*) AS rows, round(avg(value - 20), 9) AS mean_response, round(avg((sign(event_id % 3 - 1) = sign(value - 20))::INTEGER), 9) AS agreement FROM events WHERE event_type = 'click'")
def cue_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:  # A26
    out = W.sign_agreement(table(spark, sf_dir, "events"), F.col("event_type") == "click", F.col("event_id") % 3 - 1, F.col("value") - 20)
    return out.withColumns({c: F.round(c, 9) for c in ("mean_response", "agreement")})


@query("SELECT epoch_us(date_trunc('day', ts)) AS t_us, max(value) AS most, round(median(value), 9) AS median, min(value) AS least, round(avg(value), 9) AS mean FROM events GROUP BY ALL")
def distance_series(spark: SparkSession, sf_dir: str) -> DataFrame:  # A27
    day = F.unix_micros(F.date_trunc("day", F.col("ts").cast("timestamp")))
    return table(spark, sf_dir, "events").groupBy(day.alias("t_us")).agg(F.max("value").alias("most"), F.round(F.median("value"), 9).alias("median"), F.min("value").alias("least"), F.round(F.avg("value"), 9).alias("mean"))


@query("SELECT event_id, (CASE WHEN event_id % 5000 - 100 <= 0 THEN 0 ELSE ceil((event_id % 5000 - 100) / 1500) * 1500 END)::BIGINT AS delay_us FROM events")
def quantised_delays(spark: SparkSession, sf_dir: str) -> DataFrame:  # SM02
    return table(spark, sf_dir, "events").select("event_id", W.quantised_delay(F.col("event_id") % 5000 - 100, 1500).alias("delay_us"))
