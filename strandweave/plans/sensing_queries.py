"""Sensory channels, commands, run records, declared populations, parameter registries and current-step sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions import predicates as P
from strandweave.operators import contacts, graph, integrity, populations, sensing, stats, sweeps
from strandweave.plans._registry import ORACLES, QUERIES, query, table
from strandweave.plans.graph_queries import _E, user_graph
from strandweave.plans.trace_queries import _TR, trace

#: (channel, sensor, delay_us, threshold, half, most, gain, enabled)
BINDINGS = [
    ("antenna", "view", 0, 5.0, 10.0, 80.0, 1.0, True), ("leg", "click", 15000, 0.0, 20.0, 120.0, 0.5, True), ("palp", "error", 45000, 10.0, 5.0, 60.0, 2.0, True),
    ("wing", "signup", 30000, 2.0, 8.0, 90.0, 1.5, False), ("eye", "purchase", 60000, 1.0, 30.0, 150.0, 1.0, True), ("mute", "nothing", 0, 0.0, 1.0, 10.0, 1.0, True),
]
_COUPLING = 15000
_BOUND = ", ".join(f"('{c}', '{s}', {d}, {t}::DOUBLE, {h}::DOUBLE, {m}::DOUBLE, {g}::DOUBLE, {str(e).lower()})" for c, s, d, t, h, m, g, e in BINDINGS)
_BUS = f"""s AS (SELECT (event_id // 4) * {_COUPLING} AS t_us, event_type AS sensor, max(value) AS value FROM events GROUP BY ALL), t AS (SELECT DISTINCT t_us FROM s),
b(channel, sensor, delay_us, threshold, half, most, gain, enabled) AS (VALUES {_BOUND}),
q AS (SELECT t.t_us, b.*, coalesce(s.value, 0) AS quantity FROM t CROSS JOIN b LEFT JOIN s ON s.sensor = b.sensor AND s.t_us = t.t_us - b.delay_us),
r AS (SELECT t_us, channel, quantity, CASE WHEN enabled AND quantity > threshold THEN most * (quantity - threshold) / (quantity - threshold + half) * gain ELSE 0 END AS rate FROM q)"""


def _bound(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BINDINGS, "channel string, sensor string, delay_us long, threshold double, half double, most double, gain double, enabled boolean")


def _world(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy((F.floor(F.col("event_id") / 4) * _COUPLING).cast("bigint").alias("t_us"), F.col("event_type").alias("sensor")).agg(F.max("value").alias("value"))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(b[0]) for b in BINDINGS])
    return table(spark, sf_dir, "nation").select(F.get(names, F.col("n_nationkey") % len(BINDINGS)).alias("channel"), F.col("n_nationkey").alias("node"))


@query(f"WITH {_BUS} SELECT t_us, channel, quantity, round(rate, 9) AS rate FROM r")
def sensory_channels(spark: SparkSession, sf_dir: str) -> DataFrame:  # SM10 SM11
    sensing.check_bindings(_bound(spark), _members(spark, sf_dir), _COUPLING)
    return sensing.channel_frames(_world(spark, sf_dir), _bound(spark)).withColumn("rate", F.round("rate", 9))


@query(f"""WITH {_BUS}, m AS (SELECT list_extract([{', '.join(repr(b[0]) for b in BINDINGS)}], (n_nationkey % {len(BINDINGS)})::INTEGER + 1) AS channel, n_nationkey AS node FROM nation),
d AS (SELECT t_us, count(*) AS nodes, sum(rate) AS total FROM r JOIN m USING (channel) WHERE rate > 0 GROUP BY t_us),
l AS (SELECT t_us, coalesce(string_agg(channel, ',' ORDER BY channel) FILTER (WHERE rate > 0), '') AS active, coalesce(string_agg(channel, ',' ORDER BY channel) FILTER (WHERE NOT rate > 0), '') AS silent FROM r GROUP BY t_us)
SELECT t_us, active, silent, coalesce(nodes, 0)::BIGINT AS nodes, round(coalesce(total, 0), 6) AS total FROM l LEFT JOIN d USING (t_us)""")
def sensory_frames(spark: SparkSession, sf_dir: str) -> DataFrame:  # SM10 SM11
    driven, lists = sensing.bus_frames(_world(spark, sf_dir), _bound(spark), _members(spark, sf_dir), _COUPLING)
    per = driven.groupBy("t_us").agg(F.count("*").alias("nodes"), F.sum("rate").alias("total"))
    text = [F.array_join(c, ",").alias(c) for c in ("active", "silent")]
    return lists.join(per, "t_us", "left").select("t_us", *text, F.coalesce("nodes", F.lit(0)).alias("nodes"), F.round(F.coalesce("total", F.lit(0.0)), 6).alias("total"))


@query(f"WITH {_TR} SELECT key, i * 15000 AS t_us, event_type AS command, coalesce(lag(event_type) OVER (PARTITION BY key ORDER BY i), 'rest') AS applied FROM tr")
def scheduled_commands(spark: SparkSession, sf_dir: str) -> DataFrame:  # SM03 SM12
    steps = trace(spark, sf_dir).select("key", (F.col("i") * _COUPLING).alias("t_us"), (F.col("i") * _COUPLING).alias("body_us"), F.col("event_type").alias("command"))
    return sensing.scheduled(steps, _COUPLING, F.lit("rest")).drop("body_us")


@query(f"WITH {_TR}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t_us DESC, event_id DESC) AS r FROM tr) SELECT key, t_us, event_id FROM n WHERE r <= 20")
def retained_events(spark: SparkSession, sf_dir: str) -> DataFrame:  # SM12
    return sensing.retained(trace(spark, sf_dir).select("key", "t_us", "event_id"), 20)


@query(f"""WITH {_TR}, w AS (SELECT key, i AS seq, i * 1000 - CASE WHEN event_id % 97 = 0 THEN 2000 ELSE 0 END AS t_us, event_type AS state, event_type, event_id FROM tr),
r AS (SELECT *, t_us + CASE WHEN event_id % 51 = 0 THEN 1 ELSE 0 END AS body_us, CASE WHEN event_id % 77 <> 0 THEN t_us END AS neural_us, max(t_us) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM w),
c AS (SELECT key, seq, t_us + CASE WHEN event_id % 30 = 0 THEN 500 ELSE 0 END AS t_us, CASE WHEN event_id % 7 = 0 THEN 'other' ELSE state END AS state FROM w WHERE event_type IN ('click', 'error')),
s AS (SELECT key, t_us, arg_max(state, seq) AS recorded FROM w GROUP BY ALL),
f AS (SELECT key, 'order' AS fault FROM r WHERE t_us <= last UNION ALL SELECT key, 'clock' FROM r WHERE body_us IS DISTINCT FROM t_us UNION ALL SELECT key, 'clock' FROM r WHERE neural_us IS DISTINCT FROM t_us
  UNION ALL SELECT c.key, CASE WHEN s.key IS NULL THEN 'unrecorded' ELSE 'state' END FROM c LEFT JOIN s ON s.key = c.key AND s.t_us = c.t_us WHERE s.recorded IS DISTINCT FROM c.state
  UNION ALL SELECT key, 'sequence' FROM c a GROUP BY key HAVING NOT bool_or(state = 'click' AND EXISTS (SELECT 1 FROM c x WHERE x.key = a.key AND x.seq > a.seq AND x.state = 'error')))
SELECT key, fault, count(*) AS n FROM f GROUP BY ALL""")
def run_validation(spark: SparkSession, sf_dir: str) -> DataFrame:  # P06 W13 W18 J23
    e = F.col("event_id")
    rows = trace(spark, sf_dir).select("key", F.col("i").alias("seq"), (F.col("i") * 1000 - F.when(e % 97 == 0, 2000).otherwise(0)).alias("t_us"), F.col("event_type").alias("state"), "event_id")
    runs = rows.withColumn("body_us", F.col("t_us") + F.when(e % 51 == 0, 1).otherwise(0)).withColumn("neural_us", F.when(e % 77 != 0, F.col("t_us")))
    claims = rows.where(F.col("state").isin("click", "error")).select("key", "seq", (F.col("t_us") + F.when(e % 30 == 0, 500).otherwise(0)).alias("t_us"), F.when(e % 7 == 0, "other").otherwise(F.col("state")).alias("state"))
    return sensing.run_faults(runs, claims, ["click", "error"], ["body_us", "neural_us"])


#: Criteria as aggregates, in words that both engines read.
_CRITERIA = {
    "enough": "count(*) >= 100", "mean_size": "avg(o_totalprice) BETWEEN 245000 AND 253000", "open_share": "avg(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) < 0.34", "no_free": "min(o_totalprice) > 0",
}


@query("WITH a AS (SELECT o_orderpriority, " + ", ".join(f"coalesce({sql}, false) AS {n}" for n, sql in _CRITERIA.items()) + " FROM orders GROUP BY ALL) " + " UNION ALL ".join(
    f"SELECT o_orderpriority, '{n}' AS criterion, {n} AS passed, {' AND '.join(_CRITERIA)} AS accepted FROM a" for n in _CRITERIA))
def acceptance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:  # P10 ST24
    return sensing.accepted(table(spark, sf_dir, "orders"), "o_orderpriority", {n: F.expr(c) for n, c in _CRITERIA.items()})


@query("WITH " + ", ".join(f"q{k} AS ({ORACLES[n]})" for k, n in enumerate(("threshold_sensitivity", "structural_review", "canary_lookup", "edge_constraints"))) + """
SELECT 'universes' AS leg, bool_and(monotone) AS passed FROM q0 UNION ALL SELECT 'comparisons', bool_and(passed) FROM q1
UNION ALL SELECT 'canaries', bool_and(passed) FROM q2 UNION ALL SELECT 'constraints', bool_and(null_ids + negative_ids + null_weights + nonpositive_weights + overflow_weights = 0) FROM q3""")
def release_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:  # P09 P07
    legs = {"universes": ("threshold_sensitivity", "monotone"), "comparisons": ("structural_review", "passed"), "canaries": ("canary_lookup", "passed"), "constraints": ("edge_constraints", "null_ids + negative_ids + null_weights + nonpositive_weights + overflow_weights = 0")}
    rows = None
    for leg, (name, test) in legs.items():
        row = QUERIES[name](spark, sf_dir).agg(F.bool_and(F.expr(test)).alias("passed")).select(F.lit(leg).alias("leg"), "passed")
        rows = row if rows is None else rows.unionByName(row)
    return rows


_CONTACT = {
    "packed_id_bijection": "SELECT count(*) FROM (SELECT *, (l_quantity::BIGINT << 42) | (l_orderkey << 21) | l_linenumber AS key FROM lineitem) WHERE (key >> 42) <> l_quantity::BIGINT OR ((key >> 21) & 2097151) <> l_orderkey OR (key & 2097151) <> l_linenumber",
    "point_id_uniqueness": "SELECT count(*) - count(DISTINCT (l_orderkey << 21) | l_linenumber) FROM lineitem",
    "pre_endpoint_resolution": "SELECT count(*) FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = l.l_linestatus)",
    "post_endpoint_resolution": "SELECT count(*) FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey)",
    "pair_reconciliation": "SELECT count(*) FROM (SELECT l_suppkey, l_partkey, count(*) AS w FROM lineitem GROUP BY ALL) a FULL OUTER JOIN (SELECT l_suppkey, l_partkey, count(*) AS w FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL) b USING (l_suppkey, l_partkey) WHERE a.w IS DISTINCT FROM b.w",
    "attribute_resolution": "SELECT count(*) FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE o.o_orderkey IS NULL OR NOT (l_discount BETWEEN 0 AND 1) OR NOT (l_tax BETWEEN 0 AND 1)",
}


@query("WITH c AS (" + " UNION ALL ".join(f"SELECT '{n}' AS check_name, ({sql})::BIGINT AS observed" for n, sql in _CONTACT.items()) + """),
d AS (SELECT * FROM c UNION ALL SELECT 'endpoint_resolution', sum(observed)::BIGINT FROM c WHERE check_name LIKE '%endpoint_resolution')
SELECT check_name, observed, 0::BIGINT AS expected, observed = 0 AS passed FROM d
UNION ALL SELECT 'polyadic_fanout', count(*)::BIGINT, 1::BIGINT, count(*) >= 1 FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)""")
def contact_audit_full(spark: SparkSession, sf_dir: str) -> DataFrame:  # P05
    rows, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    count = lambda df: df.agg(F.count("*").alias("observed"))
    z, y, x = F.col("l_quantity").cast("bigint"), F.col("l_orderkey"), F.col("l_linenumber")
    packed = rows.select(z.alias("z"), y.alias("y"), x.alias("x"), P.packed_bits(z, y, x).alias("key"))
    a, b, c = P.unpacked(F.col("key"))
    pre = contacts.unmatched(rows, orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("l_linestatus")), ["l_orderkey", "l_linestatus"])
    post = contacts.unmatched(rows, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey")), ["l_partkey"])
    pairs = contacts.reconcile(graph.aggregated(rows, "l_suppkey", "l_partkey"), graph.aggregated(rows.where("l_returnflag <> 'R'"), "l_suppkey", "l_partkey"), ["src", "dst"])
    attributes = rows.join(orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left").where(F.col("o_orderkey").isNull() | P.outside_unit(["l_discount", "l_tax"]))
    checks = contacts.audit([
        ("packed_id_bijection", count(packed.where((a != F.col("z")) | (b != F.col("y")) | (c != F.col("x")))), 0), ("point_id_uniqueness", contacts.duplicates(rows, P.packed_bits(F.lit(0), y, x)), 0),
        ("pre_endpoint_resolution", count(pre), 0), ("post_endpoint_resolution", count(post), 0), ("endpoint_resolution", count(pre.select("l_orderkey").unionByName(post.select("l_orderkey"))), 0),
        ("pair_reconciliation", count(pairs), 0), ("attribute_resolution", count(attributes), 0),
    ])
    fan = contacts.fanout_profile(rows, ["l_orderkey"]).select(F.lit("polyadic_fanout").alias("check_name"), F.col("polyadic_sites").alias("observed"), F.lit(1).cast("bigint").alias("expected"), (F.col("polyadic_sites") >= 1).alias("passed"))
    return checks.unionByName(fan)


# Populations and registries

_SIDE = "CASE WHEN c_custkey % 5 < 2 THEN 'L' WHEN c_custkey % 5 < 4 THEN 'R' ELSE 'U' END"


@query(f"""WITH c AS (SELECT c_custkey, c_mktsegment AS m, {_SIDE} AS side FROM customer)
SELECT 'entry' AS role, 'auto_left' AS name, c_custkey, side <> 'L' AS unknown_side FROM c WHERE m = 'AUTOMOBILE' AND side IN ('L', 'U')
UNION ALL SELECT 'entry', 'auto_right', c_custkey, side <> 'R' FROM c WHERE m = 'AUTOMOBILE' AND side IN ('R', 'U')
UNION ALL SELECT 'readout', 'builders', c_custkey, false FROM c WHERE m = 'BUILDING' UNION ALL SELECT 'monitor', 'all_left', c_custkey, side <> 'L' FROM c WHERE side IN ('L', 'U')""")
def declared_populations(spark: SparkSession, sf_dir: str) -> DataFrame:  # L04 L05
    rows = table(spark, sf_dir, "customer").withColumn("side", F.expr(_SIDE))
    auto = F.col("c_mktsegment") == "AUTOMOBILE"
    return populations.declared(rows, [
        {"role": "entry", "name": "auto_left", "where": auto, "side_column": "side", "side": "L"}, {"role": "entry", "name": "auto_right", "where": auto, "side_column": "side", "side": "R"},
        {"role": "readout", "name": "builders", "where": F.col("c_mktsegment") == "BUILDING"}, {"role": "monitor", "name": "all_left", "where": F.lit(True), "side_column": "side", "side": "L"},
    ], "c_custkey")


@query("""WITH v AS (SELECT year(o_orderdate) AS t, o_custkey AS node, sum(o_totalprice) AS value FROM orders GROUP BY ALL), n AS (SELECT c_mktsegment AS g, count(*) AS n FROM customer GROUP BY ALL),
s AS (SELECT t, c_mktsegment AS g, sum(value) AS s FROM v JOIN customer ON c_custkey = node GROUP BY ALL)
SELECT t, g AS "group", round(CASE WHEN g = 'MACHINERY' THEN 0 ELSE coalesce(s, 0) / n END, 4) AS value FROM (SELECT DISTINCT t FROM v) CROSS JOIN n LEFT JOIN s USING (t, g)""")
def group_mean_readout(spark: SparkSession, sf_dir: str) -> DataFrame:  # L09
    values = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("bigint").alias("t"), F.col("o_custkey").alias("node")).agg(F.sum("o_totalprice").alias("value"))
    members = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("group"), F.col("c_custkey").alias("node"))
    return populations.group_means(members, values, ("MACHINERY",)).withColumn("value", F.round("value", 4))


@query("""WITH u AS (SELECT c_custkey AS node FROM customer WHERE c_mktsegment <> 'MACHINERY' UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'), r AS (SELECT sha256(node::VARCHAR) AS d FROM u),
g AS (SELECT d[1:2] AS g, count(*) AS n, sha256(string_agg(d, '' ORDER BY d)) AS h FROM r GROUP BY ALL) SELECT sum(n)::BIGINT AS rows, sha256(string_agg(h, '' ORDER BY g)) AS digest FROM g""")
def entry_union_digest(spark: SparkSession, sf_dir: str) -> DataFrame:  # U06
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), "c_mktsegment")
    return integrity.logical_digest(populations.entry_union(nodes.where("c_mktsegment <> 'MACHINERY'"), nodes.where("c_mktsegment = 'MACHINERY'")), ["node"], 2)


_RECORDS = [("AUTOMOBILE", "p1", True), ("BUILDING", "p2", False), ("MACHINERY", "p1", True)]
_REG = f"""r(type, set_id, measured) AS (VALUES {', '.join(f"('{t}', '{s}', {str(m).lower()})" for t, s, m in _RECORDS)}),
j AS (SELECT c_custkey AS node, c_mktsegment AS type, coalesce(set_id, 'fallback') AS set_id, coalesce(measured, false) AS measured, set_id IS NULL AS is_default FROM customer LEFT JOIN r ON type = c_mktsegment)"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("type"))
    return populations.with_records(nodes, spark.createDataFrame(_RECORDS, "type string, set_id string, measured boolean"), {"set_id": "fallback", "measured": False})


@query(f"WITH {_REG} SELECT node, type, set_id, measured, is_default FROM j")
def record_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:  # J11
    return _resolved(spark, sf_dir)


@query(f"""WITH {_REG} SELECT set_id AS "set", count(*) AS nodes, round(count(*) / (SELECT count(*) FROM j), 9) AS fraction, max(measured) AS measured, count(*) FILTER (WHERE is_default) AS fallback FROM j GROUP BY set_id""")
def parameter_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:  # A14
    return populations.coverage(_resolved(spark, sf_dir), "set_id", F.col("measured")).withColumn("fraction", F.round("fraction", 9))


_SIGN = "n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), g AS (SELECT node, CASE node % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END AS sign FROM n)"


def _signs(edges: DataFrame) -> DataFrame:
    k = F.col("node") % 3
    return graph.nodes_of(edges).withColumn("sign", F.when(k == 0, 0).when(k == 1, 1).otherwise(-1))


@query(f"""WITH {_E}, {_SIGN}, o AS (SELECT src AS node, count(*) AS e, sum(weight) AS w FROM e GROUP BY ALL), m AS (SELECT node % 7 AS channel, node, sign <> 0 AS live, coalesce(e, 0) AS e, coalesce(w, 0) AS w FROM g LEFT JOIN o USING (node))
SELECT channel, count(*) AS bodies, count(*) FILTER (WHERE live) AS live_bodies, coalesce(sum(e) FILTER (WHERE live), 0)::BIGINT AS live_edges, coalesce(sum(w) FILTER (WHERE live), 0)::BIGINT AS live_contacts,
       coalesce(sum(e) FILTER (WHERE NOT live), 0)::BIGINT AS dead_edges, round(count(*) FILTER (WHERE live) / count(*), 9) AS live_fraction, coalesce(sum(e) FILTER (WHERE live), 0) > 0 AS drivable FROM m GROUP BY channel""")
def live_edge_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:  # A15
    edges = user_graph(spark, sf_dir)
    members = graph.nodes_of(edges).select((F.col("node") % 7).alias("channel"), "node")
    return populations.live_edges(members, edges, _signs(edges)).withColumn("live_fraction", F.round("live_fraction", 9))


@query(f"WITH {_E}, {_SIGN} SELECT src, dst, round(weight * sign * (1 + dst % 3 * 0.25) * 0.275, 9) AS value FROM e JOIN g ON node = src")
def functional_weights(spark: SparkSession, sf_dir: str) -> DataFrame:  # G14
    edges = user_graph(spark, sf_dir).withColumn("m", 1 + F.col("dst") % 3 * 0.25)
    return graph.functional_weights(edges, _signs(edges), 0.275, "m").withColumn("value", F.round("value", 9))


@query("""WITH f(factor) AS (VALUES (0.7::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE)), v AS (SELECT factor, p_retailprice * (0.8::DOUBLE / factor) AS v, p_size AS s FROM part, f),
k AS (SELECT factor, v, rank() OVER (PARTITION BY factor ORDER BY v) + (count(*) OVER (PARTITION BY factor, v) - 1) / 2.0 AS a, rank() OVER (PARTITION BY factor ORDER BY s) + (count(*) OVER (PARTITION BY factor, s) - 1) / 2.0 AS b FROM v),
r AS (SELECT factor, median(v) AS median, corr(a, b) AS rho FROM k GROUP BY factor)
SELECT factor, round(median, 6) AS median, round(rho, 9) AS rho_p_size, (SELECT max(rho) - min(rho) <= 1e-9 FROM r) AS invariant FROM r""")
def sensitivity_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:  # ST11
    out = stats.sensitivity(table(spark, sf_dir, "part").select("p_retailprice", "p_size"), "p_retailprice", ["p_size"], (0.7, 0.8, 0.9), 0.8)
    return out.withColumn("median", F.round("median", 6)).withColumn("rho_p_size", F.round("rho_p_size", 9))


@query("SELECT p_brand AS label, l_orderkey AS x, l_linenumber AS y, l_quantity AS z FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 25")
def labelled_points(spark: SparkSession, sf_dir: str) -> DataFrame:  # P3-3
    labels = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("label"))
    points = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_orderkey").alias("x"), F.col("l_linenumber").alias("y"), F.col("l_quantity").alias("z"))
    return points.join(labels, "l_partkey").drop("l_partkey")


@query("""SELECT event_type AS class, count(*) AS n, count(DISTINCT user_id) AS units, round(quantile_cont(value, 0.25), 6) AS q25, round(median(value), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, min(value) AS least, max(value) AS most FROM events GROUP BY ALL""")
def class_amplitudes(spark: SparkSession, sf_dir: str) -> DataFrame:  # A30
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", "class")
    q = stats.quantiles(e, ["class"], "value", (0.25, 0.5, 0.75))
    own = e.groupBy("class").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("units"), F.min("value").alias("least"), F.max("value").alias("most"))
    return own.join(q, "class").select("class", "n", "units", *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")], "least", "most")


# Current steps: each supplier is a sweep, 25 of them a cell; at 0.5 ms a pulse from sample 60 to 219 charges the membrane, and strong ones fire.

_SWEEP = """m AS (SELECT s_suppkey AS sweep, s_suppkey // 25 AS cell, s_suppkey % 25 * 4.0::DOUBLE - 20 AS level, 6.0::DOUBLE + s_suppkey % 5 AS tau FROM supplier), i AS (SELECT unnest(range(0, 400)) AS i),
p AS (SELECT sweep, cell, tau, i, CASE WHEN i BETWEEN 60 AND 219 THEN level ELSE 0 END AS current, level,
  -60 + 0.2 * level * (CASE WHEN i < 60 THEN 0 WHEN i <= 219 THEN 1 - exp(-(i - 60) * 0.5 / tau) ELSE (1 - exp(-159 * 0.5 / tau)) * exp(-(i - 219) * 0.5 / tau) END)
  + CASE WHEN level > 30 AND i BETWEEN 70 AND 219 AND (i - 70) % (60 - level / 2)::BIGINT = 0 THEN 50 ELSE 0 END AS voltage FROM m, i)"""


def _sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sweep"), F.floor(F.col("s_suppkey") / 25).alias("cell"), (F.col("s_suppkey") % 25 * 4.0 - 20).alias("level"), (6.0 + F.col("s_suppkey") % 5).alias("tau"))
    p = m.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(399).cast("bigint"))))
    i, tau = F.col("i"), F.col("tau")
    share = F.when(i < 60, 0.0).when(i <= 219, 1 - F.exp(-(i - 60) * 0.5 / tau)).otherwise((1 - F.exp(-159 * 0.5 / tau)) * F.exp(-(i - 219) * 0.5 / tau))
    spike = F.when((F.col("level") > 30) & i.between(70, 219) & ((i - 70) % F.bround(60 - F.col("level") / 2).cast("bigint") == 0), 50.0).otherwise(0.0)
    return p.select("sweep", "cell", "i", F.when(i.between(60, 219), F.col("level")).otherwise(0.0).alias("current"), (-60 + 0.2 * F.col("level") * share + spike).alias("voltage"))


_FEAT = f"""{_SWEEP}, w AS (SELECT sweep, cell, min(level) AS level, avg(voltage) FILTER (WHERE i < 58) AS baseline, avg(voltage) FILTER (WHERE i BETWEEN 210 AND 219) AS steady, max(voltage) FILTER (WHERE i = 219) AS at_end FROM p WHERE level <> 0 GROUP BY ALL),
lm AS (SELECT *, lag(voltage) OVER k AS pv, lead(voltage) OVER k AS nv, min(voltage) OVER (PARTITION BY sweep ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS low FROM p WINDOW k AS (PARTITION BY sweep ORDER BY i)),
sp AS (SELECT sweep, i, i - lag(i) OVER (PARTITION BY sweep ORDER BY i) AS gap FROM lm WHERE voltage >= pv AND voltage > nv AND voltage - low >= 10 AND i BETWEEN 60 AND 219),
ct AS (SELECT sweep, count(*) AS spikes, min(i - 60) * 0.5 AS first_spike_ms, min(gap) * 0.5 AS least_interval_ms FROM sp GROUP BY ALL),
f AS (SELECT w.*, coalesce(spikes, 0) AS spikes, first_spike_ms, least_interval_ms, coalesce(spikes, 0) = 0 AS subthreshold FROM w LEFT JOIN ct USING (sweep)),
rise AS (SELECT p.sweep, p.i, (steady - voltage) / (steady - baseline) AS q FROM p JOIN f ON f.sweep = p.sweep WHERE subthreshold AND i BETWEEN 60 AND 219 AND abs(steady - baseline) >= 0.5),
fall AS (SELECT p.sweep, p.i, (baseline - voltage) / (baseline - at_end) AS q FROM p JOIN f ON f.sweep = p.sweep WHERE i > 219 AND abs(baseline - at_end) >= 0.5),
fits AS (SELECT kind, sweep, count(*) AS n, regr_slope(ln(q), i * 0.5) AS slope, regr_r2(ln(q), i * 0.5) AS r2, (max(i) - min(i)) * 0.5 AS span
  FROM (SELECT *, max((q <= 0)::INTEGER) OVER (PARTITION BY kind, sweep ORDER BY i) AS ended FROM (SELECT 'rise' AS kind, * FROM rise UNION ALL SELECT 'fall', * FROM fall)) WHERE ended = 0 AND q > 0.1 AND q < 0.9 GROUP BY ALL),
v AS (SELECT *, CASE WHEN n < 10 THEN 'few' WHEN NOT slope < 0 THEN 'rising' WHEN r2 < 0.9 THEN 'poor' WHEN -1 / slope > span THEN 'long' ELSE 'ok' END AS verdict FROM fits),
z AS (SELECT f.sweep, cell, level, baseline, steady, spikes, subthreshold, spikes / 0.08 AS rate_hz, first_spike_ms, least_interval_ms, CASE WHEN subthreshold THEN 1000 * (steady - baseline) / level END AS resistance,
  CASE WHEN NOT subthreshold THEN 'spikes' WHEN abs(steady - baseline) < 0.5 THEN 'span' ELSE coalesce(a.verdict, 'few') END AS charge_verdict, CASE WHEN a.verdict = 'ok' THEN -1 / a.slope END AS charge_tau_ms,
  CASE WHEN abs(baseline - at_end) < 0.5 THEN 'span' ELSE coalesce(b.verdict, 'few') END AS relax_verdict, CASE WHEN b.verdict = 'ok' THEN -1 / b.slope END AS relax_tau_ms
  FROM f LEFT JOIN v a ON a.sweep = f.sweep AND a.kind = 'rise' LEFT JOIN v b ON b.sweep = f.sweep AND b.kind = 'fall')"""
_ROUNDED = ("baseline", "steady", "rate_hz", "resistance", "charge_tau_ms", "relax_tau_ms")


@query(f"WITH {_FEAT} SELECT sweep, level, spikes, subthreshold, first_spike_ms, least_interval_ms, charge_verdict, relax_verdict, {', '.join(f'round({c}, 6) AS {c}' for c in _ROUNDED)} FROM z")
def step_features(spark: SparkSession, sf_dir: str) -> DataFrame:  # ST15 ST14
    out = sweeps.features(_sweeps(spark, sf_dir), 0.5)
    return out.select("sweep", "level", "spikes", "subthreshold", "first_spike_ms", "least_interval_ms", "charge_verdict", "relax_verdict", *[F.round(c, 6).alias(c) for c in _ROUNDED])


@query(f"""WITH {_FEAT}, x AS (SELECT *, min(level) FILTER (WHERE NOT subthreshold) OVER (PARTITION BY cell) AS firing, rate_hz < max(rate_hz) OVER (PARTITION BY cell ORDER BY level, rate_hz ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS falls FROM z)
SELECT cell, count(*) AS sweeps, max(level) FILTER (WHERE subthreshold AND (firing IS NULL OR level < firing)) AS silent_current, max(firing) AS firing_current, NOT bool_or(coalesce(falls, false)) AS monotone,
       round(median(charge_tau_ms), 6) AS median_tau_ms, round(median(resistance), 6) AS median_resistance FROM x GROUP BY cell""")
def step_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:  # A29
    samples = _sweeps(spark, sf_dir)
    cells = samples.select("sweep", "cell").distinct().hint("merge")
    out = sweeps.protocol_summary(sweeps.features(samples, 0.5).join(cells, "sweep"), "cell")
    return out.withColumn("median_tau_ms", F.round("median_tau_ms", 6)).withColumn("median_resistance", F.round("median_resistance", 6))


@query(f"WITH {_SWEEP} SELECT sweep, count(*) AS samples, 0.2::DOUBLE AS seconds, round(avg(voltage), 6) AS mean, round(stddev_pop(voltage), 6) AS sd FROM p GROUP BY ALL")
def free_sweep_features(spark: SparkSession, sf_dir: str) -> DataFrame:  # ST15
    out = sweeps.free_features(_sweeps(spark, sf_dir), 0.5)
    return out.select("sweep", "samples", "seconds", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query(f"""WITH {_SWEEP}, t AS (SELECT sweep, (i - 220) * 0.5 AS t, voltage FROM p WHERE i >= 220), g AS (SELECT 0.5 * pow(4000, k / 599.0::DOUBLE) AS tau FROM range(0, 600) r(k)),
f AS (SELECT sweep, tau, regr_slope(voltage, exp(-t / tau)) AS slope, regr_intercept(voltage, exp(-t / tau)) AS intercept, regr_r2(voltage, exp(-t / tau)) AS r2, count(*) AS samples FROM t, g GROUP BY ALL)
SELECT f.sweep, CASE WHEN lo < hi THEN round(arg_max(tau, r2), 6) END AS tau_ms, CASE WHEN lo < hi THEN round(arg_max(intercept, r2), 6) END AS asymptote, CASE WHEN lo < hi THEN round(arg_max(slope, r2), 6) END AS amplitude, max(samples) AS samples
FROM f JOIN (SELECT sweep, min(voltage) AS lo, max(voltage) AS hi FROM t GROUP BY sweep) w ON w.sweep = f.sweep GROUP BY f.sweep, lo, hi""")
def free_asymptote_fit(spark: SparkSession, sf_dir: str) -> DataFrame:  # ST14
    tails = _sweeps(spark, sf_dir).where("i >= 220")
    out = sweeps.free_asymptote(tails, 0.5)
    return out.select("sweep", *[F.round(c, 6).alias(c) for c in ("tau_ms", "asymptote", "amplitude")], "samples")


@query("""WITH m AS (SELECT l_linenumber AS x, l_suppkey AS s, avg(l_quantity) AS value FROM lineitem GROUP BY ALL), o AS (SELECT l_linenumber AS x, avg(l_quantity) AS value FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT x, round(quantile_cont(m.value, 0.05), 9) AS low, round(median(m.value), 9) AS middle, round(quantile_cont(m.value, 0.95), 9) AS high, round(max(o.value), 9) AS observed,
       max(o.value) BETWEEN quantile_cont(m.value, 0.05) AND quantile_cont(m.value, 0.95) AS inside FROM m JOIN o USING (x) GROUP BY x""")
def ensemble_band(spark: SparkSession, sf_dir: str) -> DataFrame:  # ST18
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("x"), "l_suppkey", "l_returnflag", "l_quantity")
    members = lines.groupBy("x", "l_suppkey").agg(F.avg("l_quantity").alias("value"))
    observed = lines.where("l_returnflag = 'R'").groupBy("x").agg(F.avg("l_quantity").alias("value"))
    return sweeps.band_inside(members, "x", "value", observed).select("x", *[F.round(c, 9).alias(c) for c in ("low", "middle", "high", "observed")], "inside")


@query("""WITH c AS (SELECT l_linenumber AS x, avg(l_quantity) FILTER (WHERE l_returnflag = 'R') - 25 AS h, avg(l_quantity) FILTER (WHERE l_returnflag <> 'R') - 25 AS c, 0.1 * l_linenumber AS m FROM lineitem GROUP BY ALL)
SELECT count(*) AS points, round(sqrt(avg((m - h) ** 2)), 9) AS rmse, round(sqrt(avg((c - h) ** 2)), 9) AS cohort_rmse, min(x) FILTER (WHERE m > 0) AS onset, min(x) FILTER (WHERE h > 0) AS held_onset,
       round(max(m), 9) AS peak, round(max(h), 9) AS held_peak, round(sqrt(avg((m - h) ** 2)) / sqrt(avg((c - h) ** 2)), 6) AS ratio FROM c""")
def holdout_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:  # ST18
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("x"), "l_returnflag", "l_quantity")
    curve = lambda where: lines.where(where).groupBy("x").agg((F.avg("l_quantity") - 25).alias("value"))
    model = lines.select("x").distinct().withColumn("value", 0.1 * F.col("x"))
    out = sweeps.holdout(model, curve("l_returnflag <> 'R'"), curve("l_returnflag = 'R'"), "x")
    return out.select("points", "onset", "held_onset", *[F.round(c, 9).alias(c) for c in ("rmse", "cohort_rmse", "peak", "held_peak")], F.round("ratio", 6).alias("ratio"))
