"""Streams over ``events`` and fits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.operators import fits, plasticity
from strandweave.operators.ordered import cut
from strandweave.plans._registry import query, table
from strandweave.plans.graph_queries import _E, bipartite, user_graph
from strandweave.streaming import controllers
from strandweave.streaming import operators as S


def _folder(spark: SparkSession) -> str:
    cut(spark.range(1))  # makes sure that the shared folder is set
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.[p]arquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir).select(F.col("user_id").alias("key"), F.unix_micros("ts").alias("t_us"), "value")


@query("SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:  # SM05
    counts = S.tumbling_counts(_stream(spark, sf_dir).withColumn("kind", F.col("event_type")), "1 day", "1 hour")
    folder = _folder(spark)
    writer = counts.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{folder}/state")
    writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out")).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(F.unix_micros("start").alias("start_us"), "kind", "n")


_TR = "tr AS MATERIALIZED (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, epoch_us(ts) AS t_us, value FROM events)"


@query(f"""WITH RECURSIVE {_TR}, f AS (SELECT key, i, t_us, value * (1 - 0.7::DOUBLE) AS r FROM tr WHERE i = 0
UNION ALL SELECT tr.key, tr.i, tr.t_us, f.r * 0.7::DOUBLE + tr.value * (1 - 0.7::DOUBLE) FROM f JOIN tr ON tr.key = f.key AND tr.i = f.i + 1) SELECT key, t_us, round(r, 6) AS filtered FROM f""")
def stream_exp_filter(spark: SparkSession, sf_dir: str) -> DataFrame:  # SM06
    out = S.run_once(S.exponential_filter(_samples(spark, sf_dir), 0.7), spark, _folder(spark))
    return out.withColumn("filtered", F.round("filtered", 6))


@query(f"WITH {_TR} SELECT key, (SELECT min(b.t_us) FROM tr b WHERE b.key = a.key AND b.t_us >= a.t_us + 90000000000) AS t_us, a.t_us AS source_us, value FROM tr a WHERE EXISTS (SELECT 1 FROM tr b WHERE b.key = a.key AND b.t_us >= a.t_us + 90000000000)")
def stream_delay_queue(spark: SparkSession, sf_dir: str) -> DataFrame:  # SM01
    return S.run_once(S.delay_queue(_samples(spark, sf_dir), 90_000_000_000), spark, _folder(spark))


@query(f"""WITH RECURSIVE {_TR}, s AS (SELECT *, min(t_us) OVER (PARTITION BY key) AS start FROM tr),
f(key, i, t_us, state, held, fired) AS (SELECT key, -1::BIGINT, NULL::BIGINT, 'QUIESCENT', 0, -1::BIGINT FROM s GROUP BY key
UNION ALL SELECT n.key, n.i, n.t_us, CASE WHEN n.w = 'WATCHING' AND n.value > 12 AND n.h + 1 >= 3 THEN 'ACTING' ELSE n.w END, CASE WHEN n.w = 'WATCHING' THEN CASE WHEN n.value > 12 THEN n.h + 1 ELSE 0 END ELSE n.h END,
 CASE WHEN n.w = 'WATCHING' AND n.value > 12 AND n.h + 1 >= 3 THEN n.t_us ELSE n.fired END
 FROM (SELECT s.key, s.i, s.t_us, s.value, f.held AS h, f.fired, CASE WHEN f.state = 'QUIESCENT' AND s.t_us - s.start >= 200000000000 THEN 'WATCHING' WHEN f.state = 'ACTING' AND s.t_us - f.fired >= 300000000000 THEN 'SPENT' ELSE f.state END AS w
       FROM f JOIN s ON s.key = f.key AND s.i = f.i + 1) n)
SELECT key, t_us, state FROM f WHERE i >= 0""")
def stream_hold_state(spark: SparkSession, sf_dir: str) -> DataFrame:  # SM07
    return S.run_once(S.hold_then_fire(_samples(spark, sf_dir), 12.0, 200_000_000_000, 3, 300_000_000_000, 1), spark, _folder(spark))


@query("""WITH x AS (SELECT user_id AS key, event_id * 7919 % 10007 AS seq, epoch_us(ts) AS t_us FROM events)
SELECT key, seq, t_us, before_us FROM (SELECT *, max(t_us) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_us FROM x) WHERE t_us < before_us""")
def late_rows_audit(spark: SparkSession, sf_dir: str) -> DataFrame:  # SM04
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), (F.col("event_id") * 7919 % 10007).alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"))
    return S.backward_rows(rows)


@query("SELECT epoch_us(ts) AS t_us, c_custkey AS node, round(value * 0.5, 9) AS rate FROM events JOIN customer ON c_nationkey = CASE event_type WHEN 'click' THEN 3 WHEN 'view' THEN 5 END WHERE c_custkey % 7 <> 0 AND value * 0.5 > 0")
def sensory_bus(spark: SparkSession, sf_dir: str) -> DataFrame:  # SM10 SM11
    channel = F.when(F.col("event_type") == "click", 3).when(F.col("event_type") == "view", 5)
    samples = table(spark, sf_dir, "events").select(channel.alias("channel"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), "value")
    bindings = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("channel"), F.col("c_custkey").alias("node"), F.lit(0.5).alias("gain"), (F.col("c_custkey") % 7 != 0).alias("enabled"))
    return S.channel_drive(samples, bindings, 9)


def _frames(events: DataFrame) -> DataFrame:
    u = F.col("user_id")
    own = events.groupBy("user_id").agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"), F.collect_list("event_type").alias("ids"), F.count("*").alias("n"))
    return own.select((F.col("t") - F.when(u == 3, F.lit(9_000_000_000_000_000)).otherwise(0)).alias("t_us"), "ids", F.array_repeat(F.lit(1.0), (F.col("n") - F.when(u % 11 == 0, 1).otherwise(0)).cast("int")).alias("values"), F.when(u % 13 == 0, "").otherwise("Hz").alias("units"), F.array(F.lit("A1")).alias("assumptions"))


@query("""WITH f AS (SELECT min(epoch_us(ts)) - CASE WHEN user_id = 3 THEN 9000000000000000 ELSE 0 END AS t_us, list(event_type) AS ids, count(*) - CASE WHEN user_id % 11 = 0 THEN 1 ELSE 0 END AS n, CASE WHEN user_id % 13 = 0 THEN '' ELSE 'Hz' END AS units FROM events GROUP BY user_id)
SELECT t_us, fault FROM (SELECT t_us, unnest(list_filter([CASE WHEN t_us < 0 THEN 'time' END, CASE WHEN len(ids) <> n THEN 'length' END, CASE WHEN len(list_distinct(ids)) <> len(ids) THEN 'repeated' END, CASE WHEN units = '' THEN 'units' END], lambda x: x IS NOT NULL)) AS fault FROM f)""")
def frame_contract(spark: SparkSession, sf_dir: str) -> DataFrame:  # SM13
    return S.frame_faults(_frames(table(spark, sf_dir, "events")))


# Fits


@query()
def truncated_nb_grid(spark: SparkSession, sf_dir: str) -> DataFrame:  # ST09
    h = bipartite(spark, sf_dir).withColumn("label", F.col("src") % 5).groupBy("label", F.col("weight").alias("value")).agg(F.count("*").alias("n"))
    return fits.truncated_nb(h, ["label"])


_KERNELS = """d AS (SELECT s_suppkey % 5 AS g, s_suppkey AS curve, t::DOUBLE AS t, (1 + s_suppkey % 25) * (exp(-t / (8.0::DOUBLE + 4 * (s_suppkey % 5))) - exp(-t / (1.0::DOUBLE + s_suppkey % 5))) AS y FROM supplier, range(0, 61) r(t)),
k AS (SELECT rise::DOUBLE AS rise, decay::DOUBLE AS decay, rise * decay / (decay - rise)::DOUBLE * ln(decay / rise::DOUBLE) AS top FROM (SELECT unnest([1, 2, 3, 4, 5]) AS rise), (SELECT unnest([6, 8, 12, 16, 20, 24]) AS decay)),
v AS (SELECT g, curve, rise, decay, y, (exp(-t / decay) - exp(-t / rise)) / (exp(-top / decay) - exp(-top / rise)) AS k FROM d, k),
a AS (SELECT g, curve, rise, decay, greatest(0, sum(y * k) / sum(k * k)) AS a, greatest(1e-12, max(abs(y)) * 0.1) AS s FROM v GROUP BY ALL),
l AS (SELECT g, curve, rise, decay, avg(CASE WHEN abs(y - a * k) <= s THEN (y - a * k) ** 2 / 2 ELSE s * (abs(y - a * k) - s / 2) END) AS l FROM v JOIN a USING (g, curve, rise, decay) GROUP BY ALL),
m AS (SELECT g, rise, decay, avg(l) AS l FROM l GROUP BY ALL)"""


@query(f"WITH {_KERNELS} SELECT g, arg_min(rise, l) AS rise, arg_min(decay, l) AS decay, round(min(l), 9) AS loss FROM m GROUP BY g")
def kernel_grid_fit(spark: SparkSession, sf_dir: str) -> DataFrame:  # ST12
    t = F.explode(F.sequence(F.lit(0), F.lit(60))).alias("t")
    rows = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 5).alias("g"), F.col("s_suppkey").alias("curve"), t)
    rise, decay = 1.0 + F.col("g"), 8.0 + 4 * F.col("g")
    rows = rows.select("g", "curve", F.col("t").cast("double").alias("t"), ((1 + F.col("curve") % 25) * (F.exp(-F.col("t") / decay) - F.exp(-F.col("t") / rise))).alias("y"))
    return fits.kernel_grid_fit(rows, "g", [1.0, 2.0, 3.0, 4.0, 5.0], [6.0, 8.0, 12.0, 16.0, 20.0, 24.0]).withColumn("loss", F.round("loss", 9))


_TRAINS = """q AS (SELECT l_returnflag AS specimen, CASE l_suppkey % 3 WHEN 0 THEN 20.0 WHEN 1 THEN 50.0 ELSE 200.0 END::DOUBLE AS gap, l_linenumber AS pulse, avg(l_quantity) AS m, stddev_samp(l_quantity) / sqrt(count(*)) AS e FROM lineitem GROUP BY ALL),
one AS (SELECT specimen, gap, m AS first FROM q WHERE pulse = 1)"""


def _trains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses to the pulses of trains, of the lines of each flag: a third of the suppliers has each gap, the line's number is the pulse."""
    gap = F.element_at(F.array(F.lit(20.0), F.lit(50.0), F.lit(200.0)), (F.col("l_suppkey") % 3 + 1).cast("int"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("specimen"), gap.alias("gap"), F.col("l_linenumber").alias("pulse"), F.col("l_quantity").alias("response"))
    return fits.observations(lines)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios of pairs, of the first two lines, by four gaps."""
    gap = F.element_at(F.array(F.lit(10.0), F.lit(30.0), F.lit(100.0), F.lit(300.0)), (F.col("l_partkey") % 4 + 1).cast("int"))
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").select(F.col("l_returnflag").alias("specimen"), gap.alias("gap"), F.col("l_linenumber").alias("pulse"), F.col("l_quantity").alias("response"))
    return fits.observations(lines).withColumn("pulse", F.lit(0))


@query(f"WITH {_TRAINS} SELECT q.specimen, q.gap, pulse::INTEGER AS pulse, round(m / first, 9) AS mean, round(greatest(e / first, 1e-3), 9) AS error FROM q JOIN one ON one.specimen = q.specimen AND one.gap = q.gap WHERE pulse > 1")
def train_observations(spark: SparkSession, sf_dir: str) -> DataFrame:  # ST20
    """What the family fits are given."""
    return _trains(spark, sf_dir).withColumn("mean", F.round("mean", 9)).withColumn("error", F.round("error", 9))


@query()
def family_fit(spark: SparkSession, sf_dir: str) -> DataFrame:  # ST20
    return fits.fit_families(_trains(spark, sf_dir), list(plasticity.FAMILIES), 2)


@query()
def joint_fit(spark: SparkSession, sf_dir: str) -> DataFrame:  # ST23
    both = _trains(spark, sf_dir).unionByName(_pairs(spark, sf_dir))
    return fits.fit_families(both, ["depression", "facilitation_depression", "two_time_facilitation"], 2)


@query()
def family_discrimination(spark: SparkSession, sf_dir: str) -> DataFrame:  # ST21
    return fits.discrimination(_trains(spark, sf_dir), "depression", [0.4, 150.0], "published_depression", 20)


#: A setting of each family.
THETA = {
    "depression": (0.4, 150.0), "facilitation_depression": (0.2, 0.3, 60.0, 400.0), "tied_facilitation": (0.3, 60.0, 400.0), "parallel_pools": (0.8, 50.0, 0.4, 300.0),
    "published_depression": (0.15, 80.0), "two_time_facilitation": (1.5, 0.4, 120.0, 0.3), "two_time_facilitation_free": (1.5, 12.0, 0.4, 120.0, 0.3),
}


def _trains_sql() -> str:
    """All families side by side, a pulse a step of the recursion."""
    first, later, read = [], [], []
    for k, (family, theta) in enumerate(THETA.items()):
        t = plasticity.terms(family, theta)
        relaxed = lambda c, rest, tau: f"({rest} + ({c}{k} - {rest}) * exp(-p.gap / {tau}))"  # noqa: B023, E731
        pool = {True: "1.0::DOUBLE", False: relaxed("pool", 1.0, t.pool_ms)}
        level, fast, slow = relaxed("level", t.rest, t.level_ms), relaxed("fast", 0.0, t.fast_ms), relaxed("slow", 0.0, t.slow_ms)
        for start, out in ((True, first), (False, later)):
            at = f"({t.rest}::DOUBLE + {t.jump} * (1 - {t.rest}))" if start else f"({level} + {t.jump} * (1 - {level}))"
            f, s = ("0.0::DOUBLE", "0.0::DOUBLE") if start else (fast, slow)
            value = {"pool": pool[start], "level": f"{at} * {pool[start]}", "sum": f"{plasticity.SHARE} * (1 + {f}) + {1 - plasticity.SHARE} * {pool[start]}", "product": f"(1 + {f} + {s}) * {pool[start]}"}[t.mode]
            used = at if t.mode == "level" else str(t.use)
            out += [f"{at} AS level{k}, {f} + {t.fast} AS fast{k}, {s} + {t.slow} AS slow{k}, {pool[start]} * (1 - {used}) AS pool{k}, {value} AS r{k}, " + (f"{value} AS one{k}" if start else f"one{k}")]
        read += [f"round(r{k} / one{k}, 9) AS {family}"]
    return f"""WITH RECURSIVE p AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, 5 + value % 95 AS gap FROM events),
s AS (SELECT p.key, p.i, {', '.join(first)} FROM p WHERE i = 0 UNION ALL SELECT p.key, p.i, {', '.join(later)} FROM s JOIN p ON p.key = s.key AND p.i = s.i + 1)
SELECT key, i, {', '.join(read)} FROM s"""


@query(_trains_sql())
def plasticity_trains(spark: SparkSession, sf_dir: str) -> DataFrame:  # ST19
    from strandweave.plans.trace_queries import trace

    pulses = trace(spark, sf_dir).select("key", "i", (5 + F.col("value") % 95).alias("gap"))
    return plasticity.respond(pulses, THETA).select("key", "i", *[F.round(f, 9).alias(f) for f in THETA])


@query()
def family_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:  # ST21
    return fits.leave_one_out(_trains(spark, sf_dir), ["depression"])


@query()
def bootstrap_band(spark: SparkSession, sf_dir: str) -> DataFrame:  # ST21
    return fits.bootstrap_band(_trains(spark, sf_dir), "depression", 100.0, 5, 60)


@query("""WITH c AS (SELECT l_returnflag AS specimen, l_linenumber::DOUBLE AS x, round(avg(l_quantity), 6) AS y FROM lineitem GROUP BY ALL), g AS (SELECT a, b FROM (SELECT unnest([20.0, 24.0, 25.0, 26.0]::DOUBLE[]) AS a), (SELECT unnest([-0.5, 0.0, 0.5]::DOUBLE[]) AS b)),
s AS (SELECT specimen, a, b, sqrt(avg((y - (a + b * x)) ** 2)) AS rmse FROM c, g GROUP BY ALL) SELECT specimen, round(min(rmse), 6) AS rmse, arg_min(a, rmse) AS a, arg_min(b, rmse) AS b FROM s GROUP BY specimen""")
def rate_grid_fit(spark: SparkSession, sf_dir: str) -> DataFrame:  # ST18
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("specimen"), F.col("l_linenumber").cast("double").alias("x")).agg(F.round(F.avg("l_quantity"), 6).alias("y"))
    out = fits.rate_grid_fit(c, "specimen", {"a": [20.0, 24.0, 25.0, 26.0], "b": [-0.5, 0.0, 0.5]}, lambda x, a, b: a + b * x)
    return out.withColumn("rmse", F.round("rmse", 6))


@query("""WITH RECURSIVE s AS (SELECT p_partkey AS candidate, 5.0::DOUBLE + p_size AS tau, p_size / 20.0::DOUBLE AS jump, 0 AS k, 0.0::DOUBLE AS v, 0.0::DOUBLE AS w, 0::BIGINT AS n, NULL::DOUBLE AS first FROM part
UNION ALL SELECT candidate, tau, jump, k + 1, CASE WHEN x >= 10 THEN 0 ELSE x END, y + CASE WHEN x >= 10 THEN jump ELSE 0 END, n + (x >= 10)::INTEGER, CASE WHEN x >= 10 AND n = 0 THEN k * 0.5::DOUBLE ELSE first END
FROM (SELECT *, v + 0.5::DOUBLE / tau * (0.2::DOUBLE * k * 0.5::DOUBLE - w - v) AS x, w - 0.5::DOUBLE / 80.0::DOUBLE * w AS y FROM s WHERE k < 400)) SELECT candidate, n AS spikes, first AS first_ms FROM s WHERE k = 400""")
def adaptive_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:  # ST16
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("candidate"), (5.0 + F.col("p_size")).alias("tau"), F.lit(10.0).alias("threshold"), (F.col("p_size") / 20).alias("adapt"), F.lit(80.0).alias("adapt_tau"))
    return fits.adaptive_ramp(p, 0.2, 0.5, 400)


@query(f"""WITH RECURSIVE {_E}, n AS MATERIALIZED (SELECT src AS node FROM e UNION SELECT dst FROM e),
s AS (SELECT node, -1 AS step, 0.0::DOUBLE AS v, 0::BIGINT AS rest, false AS fired, false AS before FROM n
UNION ALL SELECT node, step, CASE WHEN f THEN 0 ELSE x END, CASE WHEN f THEN 3 ELSE rest - 1 END, f, fired FROM (
  SELECT *, (node = 0 AND step IN (0, 20)) OR (node = 5 AND step = 3) OR (x >= 2 AND rest <= 0) AS f FROM (
    SELECT s.node, s.step + 1 AS step, CASE WHEN s.rest > 0 THEN 0 ELSE s.v * 0.8::DOUBLE + coalesce(a.w, 0) END AS x, s.rest, s.fired
    FROM s LEFT JOIN (SELECT e.dst, sum(e.weight)::DOUBLE AS w FROM s z JOIN e ON e.src = z.node WHERE z.before GROUP BY e.dst) a ON a.dst = s.node WHERE s.step < 59)))
SELECT 0 AS circuit, step::INTEGER AS step, node FROM s WHERE fired""")
def small_network(spark: SparkSession, sf_dir: str) -> DataFrame:  # SM14
    edges = user_graph(spark, sf_dir).withColumn("circuit", F.lit(0))
    return fits.small_network(edges, "circuit", {0: [0, 20], 5: [3]}, 60, 0.8, 2.0, 2, 3)


@query(f"WITH {_E}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT step::INTEGER AS step, node FROM n, range(0, 40) t(step) WHERE ('0x' || md5(step || ':' || node || ':stim')[1:8])::BIGINT / 4294967296.0::DOUBLE < 0.1")
def stimulus_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:  # SM15
    from strandweave.operators.graph import nodes_of

    return fits.stimulus_schedule(nodes_of(user_graph(spark, sf_dir)), 40, 0.1)


# Controllers: along each user's events, error and purchase are the signals of grooming and feeding, view and click those of the two sides.

_STEPS = """st AS MATERIALIZED (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 10 AS t_us,
  CASE event_type WHEN 'error' THEN value ELSE 0 END AS groom, CASE event_type WHEN 'purchase' THEN value ELSE 0 END AS feed, CASE event_type WHEN 'view' THEN value ELSE 6 END AS "left", CASE event_type WHEN 'click' THEN value ELSE 5 END AS "right" FROM events)"""
_ARBITER = """CASE WHEN {s} <> 'GROOM' AND x.groom >= 20 THEN 'GROOM' WHEN {s} = 'GROOM' THEN CASE WHEN x.groom > 2 THEN 'GROOM' ELSE 'RESUME' END
  WHEN {s} = 'RESUME' THEN CASE WHEN x.t_us - {since} < 30 THEN 'RESUME' ELSE 'SEEK' END WHEN {s} = 'FEED' THEN CASE WHEN x.feed > 4 THEN 'FEED' ELSE 'SEEK' END WHEN x.feed >= 10 THEN 'FEED' ELSE 'SEEK' END"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandweave.plans.trace_queries import trace

    kind = F.col("event_type")
    given = [("groom", "error", 0.0), ("feed", "purchase", 0.0), ("left", "view", 6.0), ("right", "click", 5.0)]
    signals = F.create_map(*[x for name, event, rest in given for x in (F.lit(name), F.when(kind == event, F.col("value")).otherwise(rest))])
    return trace(spark, sf_dir).select("key", (F.col("i") * 10).alias("t_us"), signals.alias("signals"))


@query(f"""WITH RECURSIVE {_STEPS}, a AS (SELECT key, i, t_us, new AS state, new <> 'SEEK' AS changed, CASE WHEN new <> 'SEEK' THEN t_us ELSE 0 END AS since FROM (SELECT *, {_ARBITER.format(s="'SEEK'", since='0')} AS new FROM st x) WHERE i = 0
UNION ALL SELECT key, i, t_us, new, new <> state, CASE WHEN new <> state THEN t_us ELSE since END FROM (SELECT x.key, x.i, x.t_us, a.state, a.since, {_ARBITER.format(s='a.state', since='a.since')} AS new FROM a JOIN st x ON x.key = a.key AND x.i = a.i + 1))
SELECT key, t_us, state, changed FROM a""")
def arbiter_states(spark: SparkSession, sf_dir: str) -> DataFrame:  # SM08
    return controllers.Arbiter((20.0, 2.0), (10.0, 4.0), 30).run(_steps(spark, sf_dir))


_MOVES = """CASE WHEN {s} = 'QUIESCENT' THEN CASE WHEN x.t_us >= 40 THEN 'WATCHING' ELSE 'QUIESCENT' END
  WHEN {s} = 'WATCHING' AND (x."left" + x."right") / 2 >= 5.5 AND {above} IS NOT NULL AND x.t_us - {above} >= 20 THEN 'MOVING' ELSE {s} END AS new,
  CASE WHEN {s} <> 'WATCHING' THEN {above} WHEN (x."left" + x."right") / 2 < 5.5 THEN NULL ELSE coalesce({above}, x.t_us) END AS up"""


@query(f"""WITH RECURSIVE {_STEPS}, a AS (SELECT key, i, t_us, new AS state, up AS above, "left", "right" FROM (SELECT *, {_MOVES.format(s="'QUIESCENT'", above='NULL::BIGINT')} FROM st x) WHERE i = 0
UNION ALL SELECT key, i, t_us, new, up, "left", "right" FROM (SELECT x.key, x.i, x.t_us, x."left", x."right", {_MOVES.format(s='a.state', above='a.above')} FROM a JOIN st x ON x.key = a.key AND x.i = a.i + 1))
SELECT key, t_us, state, round(CASE WHEN state = 'MOVING' THEN ("left" + "right") / 2 / (("left" + "right") / 2 + 30) ELSE 0 END, 9) AS forward, round(CASE WHEN state = 'MOVING' THEN greatest(-1, least(1, 0.5 * ("left" - "right") / 8)) ELSE 0 END, 9) AS turn FROM a""")
def steering_commands(spark: SparkSession, sf_dir: str) -> DataFrame:  # SM09
    out = controllers.Steering(40, 5.5, 20, 30.0, 0.5, 8.0).run(_steps(spark, sf_dir))
    return out.withColumn("forward", F.round("forward", 9)).withColumn("turn", F.round("turn", 9))


@query()
def two_decay_fit(spark: SparkSession, sf_dir: str) -> DataFrame:  # ST12
    t = F.explode(F.sequence(F.lit(0), F.lit(120))).alias("t")
    rows = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 5).alias("g"), F.col("s_suppkey").alias("curve"), t)
    x, fast, slow = F.greatest(F.col("t") - 20, F.lit(0)), 6.0 + F.col("g"), 40.0 + 10 * F.col("g")
    y = (1 + F.col("curve") % 25) * F.when(F.col("t") >= 20, 0.7 * F.exp(-x / fast) + 0.3 * F.exp(-x / slow) - F.exp(-x / 1.5)).otherwise(0.0)
    return fits.two_decay_fit(rows.select("g", "curve", F.col("t").cast("double").alias("t"), y.alias("y")), "g", [18.0, 20.0, 22.0], [1.0, 1.5, 2.0], [5.0, 6.0, 7.0, 8.0, 9.0, 10.0], [30.0, 40.0, 50.0, 60.0, 70.0, 80.0], [0.5, 0.7, 0.9])


@query("""WITH o AS (SELECT l_linenumber AS x, avg(l_quantity) AS mean, stddev_samp(l_quantity) / sqrt(count(*)) AS se FROM lineitem GROUP BY ALL), f AS (SELECT *, 25 + 0.02 * x AS predicted, (SELECT sum(mean / se ** 2) / sum(1 / se ** 2) FROM o) AS flat FROM o)
SELECT x, round(mean, 9) AS mean, round(predicted, 9) AS predicted, abs(predicted - mean) <= 1.96 * se AS inside, round((predicted - mean) / se, 6) AS residual, 1.96 * se > 0.3 AS underpowered, round((flat - mean) / se, 6) AS null_residual,
       round((SELECT sum(((predicted - mean) / se) ** 2) / sum(((flat - mean) / se) ** 2) FROM f), 6) AS ratio FROM f""")
def interval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:  # ST22
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("x")).agg(F.avg("l_quantity").alias("mean"), (F.stddev_samp("l_quantity") / F.sqrt(F.count("*"))).alias("se"))
    observed = own.withColumn("low", F.col("mean") - 1.96 * F.col("se")).withColumn("high", F.col("mean") + 1.96 * F.col("se"))
    out = fits.interval_scores(observed, own.select("x", (25 + 0.02 * F.col("x")).alias("value")), "x", 0.3)
    return out.select("x", F.round("mean", 9).alias("mean"), F.round("predicted", 9).alias("predicted"), "inside", F.round("residual", 6).alias("residual"), "underpowered", F.round("null_residual", 6).alias("null_residual"), F.round("ratio", 6).alias("ratio"))
