"""Edge algebra, paths, flow and controls.

The homogeneous graph joins each event's user to the user of the next event; the
bipartite one joins suppliers to parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions.predicates import selectivity
from strandweave.operators import graph, populations, reach
from strandweave.operators.ordered import cut, with_next
from strandweave.plans._registry import query, table

_E = """
e AS MATERIALIZED (
  SELECT src, dst, count(*)::BIGINT AS weight FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events)
  WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL
)"""
_B = "b AS MATERIALIZED (SELECT l_suppkey AS src, l_partkey + 1000000 AS dst, count(*)::BIGINT AS weight FROM lineitem GROUP BY ALL)"
_LABEL = """
lab AS MATERIALIZED (
  SELECT user_id AS node, arg_min(event_type, struct_pack(a := -n, b := event_type)) AS label
  FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id
), nt AS MATERIALIZED (
  SELECT node, CASE label WHEN 'purchase' THEN 'acetylcholine' WHEN 'view' THEN 'dopamine' WHEN 'error' THEN 'gaba' ELSE NULL END AS label FROM lab
)"""


def user_graph(spark: SparkSession, sf_dir: str, least: int = 1) -> DataFrame:
    rows = with_next(table(spark, sf_dir, "events").select("ts", "event_id", "user_id"), ["ts", "event_id"], "user_id", "next")
    edges = graph.aggregated(rows.where("next IS NOT NULL AND next <> user_id"), "user_id", "next")
    return cut(edges.where(F.col("weight") >= least))


def bipartite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") + 1000000).alias("part"))
    return cut(graph.aggregated(rows, "l_suppkey", "part"))


def user_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("node"), "event_type").agg(F.count("*").alias("n"))
    return n.groupBy("node").agg(F.min_by("event_type", F.struct(-F.col("n"), F.col("event_type"))).alias("label"))


def transmitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = {"purchase": "acetylcholine", "view": "dopamine", "error": "gaba"}
    label = F.lit(None).cast("string")
    for k, v in of.items():
        label = F.when(F.col("label") == k, v).otherwise(label)
    return user_labels(spark, sf_dir).select("node", label.alias("label"))


def _users(spark: SparkSession, *ids: int) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "node bigint")


@query(f"""WITH {_E}
SELECT node, count(*) FILTER (WHERE o) AS out_degree, coalesce(sum(weight) FILTER (WHERE o), 0)::BIGINT AS out_weight,
       count(*) FILTER (WHERE NOT o) AS in_degree, coalesce(sum(weight) FILTER (WHERE NOT o), 0)::BIGINT AS in_weight
FROM (SELECT src AS node, true AS o, weight FROM e UNION ALL SELECT dst, false, weight FROM e) GROUP BY node""")
def degree_profile(spark: SparkSession, sf_dir: str) -> DataFrame:  # A07
    return graph.degrees(user_graph(spark, sf_dir))


@query(f"""WITH {_E}, d AS (SELECT src AS node, sum(weight)::BIGINT AS value FROM e GROUP BY ALL),
q AS (SELECT quantile_cont(value, [0, 0.25, 0.5, 0.75, 1]) AS q FROM d)
SELECT node, value, greatest(least(len(list_filter(q, lambda x: x <= value)) - 1, 3), 0)::INTEGER AS bin FROM d, q""")
def degree_bins(spark: SparkSession, sf_dir: str) -> DataFrame:  # L08
    d = user_graph(spark, sf_dir).groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("value"))
    return populations.quantile_bins(d, "node", "value", 4)


@query(f"""WITH {_B}
SELECT s_nationkey AS src_type, p_type AS dst_type, count(*) AS edges, sum(weight)::BIGINT AS contacts,
       round(CASE WHEN s_nationkey = 3 THEN 0.5 / 2.0 ELSE 1.0 END, 9) AS multiplier
FROM b JOIN supplier ON s_suppkey = src JOIN part ON p_partkey + 1000000 = dst GROUP BY ALL""")
def type_pair_weights(spark: SparkSession, sf_dir: str) -> DataFrame:  # J08 J09
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("label"))
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1000000).alias("node"), F.col("p_type").alias("label"))
    scales = table(spark, sf_dir, "part").select(F.lit(3).alias("src_type"), F.col("p_type").alias("dst_type"), F.lit(0.5).alias("scale")).distinct()
    pairs = graph.scaled(graph.type_pairs(bipartite(spark, sf_dir), s, p), scales, 2.0)
    return pairs.groupBy("src_type", "dst_type", F.round("multiplier", 9).alias("multiplier")).agg(F.count("*").alias("edges"), F.sum("weight").cast("bigint").alias("contacts"))


def _sign_sql(rest: str) -> str:
    return f"""WITH {_E}, {_LABEL},
sg AS (SELECT node, CASE WHEN label IN ('acetylcholine', 'dopamine') THEN 1 WHEN label = 'gaba' THEN -1 ELSE {rest} END AS sign FROM nt)
SELECT src, dst, weight, (weight * sign)::BIGINT AS signed FROM e JOIN sg ON node = src"""


def _signed(policy: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:  # G12 J10 G14
        sign = graph.signs(transmitters(spark, sf_dir), policy)
        return user_graph(spark, sf_dir).join(sign.select(F.col("node").alias("src"), "sign"), "src").select("src", "dst", "weight", (F.col("weight") * F.col("sign")).cast("bigint").alias("signed"))

    return run


for _policy, _rest in (("zero", "0"), ("excitatory", "1"), ("inhibitory", "-1"), ("seeded", "CASE WHEN ('0x' || md5(node || ':sign')[1])::INTEGER % 2 = 0 THEN 1 ELSE -1 END")):
    query(_sign_sql(_rest), name=f"edge_signs_{_policy}")(_signed(_policy))

_SG = f"{_E}, {_LABEL}, sg AS (SELECT node, CASE WHEN label IN ('acetylcholine', 'dopamine') THEN 1 WHEN label = 'gaba' THEN -1 ELSE 0 END AS sign FROM nt)"


@query(f"""WITH {_SG}, s AS (
  SELECT dst AS node, sum(CASE WHEN sign > 0 THEN weight ELSE 0 END)::BIGINT AS excitatory, sum(CASE WHEN sign < 0 THEN weight ELSE 0 END)::BIGINT AS inhibitory
  FROM e JOIN sg ON node = src GROUP BY dst)
SELECT *, excitatory - inhibitory AS net, CASE WHEN excitatory > inhibitory THEN 'excitatory' WHEN excitatory < inhibitory THEN 'inhibitory' ELSE 'balanced' END AS label FROM s""")
def signed_composition(spark: SparkSession, sf_dir: str) -> DataFrame:  # A12
    return graph.signed_composition(user_graph(spark, sf_dir), graph.signs(transmitters(spark, sf_dir)))


@query(f"""WITH {_SG}, n AS (SELECT user_id AS node, count(*) AS n FROM events WHERE event_type = 'click' AND value > 20 GROUP BY ALL),
d AS (SELECT dst, weight, sign, coalesce(n, 0) AS n, weight * sign * coalesce(n, 0) AS d FROM e JOIN sg ON sg.node = src LEFT JOIN n ON n.node = src),
g AS (SELECT dst AS node, sum(CASE WHEN d > 0 THEN d ELSE 0 END)::BIGINT AS plus, sum(CASE WHEN d < 0 THEN d ELSE 0 END)::BIGINT AS minus,
      count(*) FILTER (WHERE n > 0) AS active_sources, count(*) AS sources, sum(weight * sign)::BIGINT AS static_net FROM d GROUP BY dst)
SELECT *, sign(plus + minus) = sign(static_net) AS agrees FROM g""")
def delivered_drive(spark: SparkSession, sf_dir: str) -> DataFrame:  # A13
    counts = table(spark, sf_dir, "events").where("event_type = 'click' AND value > 20").groupBy(F.col("user_id").alias("node")).agg(F.count("*").alias("n"))
    return graph.delivered_drive(user_graph(spark, sf_dir), graph.signs(transmitters(spark, sf_dir)), counts)


def _cohorts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), (F.col("s_nationkey") % 5).alias("label"))
    return s, table(spark, sf_dir, "part").select((F.col("p_partkey") + 1000000).alias("node"), (F.col("p_size") % 5).alias("label"))


_COHORT = f"""{_B},
pres AS (SELECT src AS node FROM b UNION SELECT dst FROM b),
s AS (SELECT s_suppkey AS node, s_nationkey % 5 AS label FROM supplier WHERE s_suppkey IN (SELECT node FROM pres)),
p AS (SELECT p_partkey + 1000000 AS node, p_size % 5 AS label FROM part WHERE p_partkey + 1000000 IN (SELECT node FROM pres)),
fw AS (SELECT s.label, src, dst, weight FROM b JOIN s ON s.node = src JOIN p ON p.node = dst AND p.label = s.label)"""


@query(f"""WITH {_COHORT}, f AS (SELECT label, count(*) AS realised, sum(weight)::BIGINT AS contacts, median(weight) AS median_contacts, count(DISTINCT dst) AS reached FROM fw GROUP BY label),
c AS (SELECT * FROM (SELECT label, count(*) AS sources FROM s GROUP BY label) FULL OUTER JOIN (SELECT label, count(*) AS targets FROM p GROUP BY label) USING (label))
SELECT c.label, sources, targets, sources * targets AS possible, coalesce(realised, 0) AS realised, coalesce(contacts, 0)::BIGINT AS contacts, median_contacts, 0::BIGINT AS reverse_pairs,
       targets - coalesce(reached, 0) AS orphans, round(coalesce(realised, 0) / (sources * targets), 9) AS completeness FROM c LEFT JOIN f ON f.label = c.label""")
def bipartite_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:  # G06 J14 A10 J06 J12
    return graph.pair_completeness(bipartite(spark, sf_dir), *_cohorts(spark, sf_dir)).withColumn("completeness", F.round("completeness", 9))


@query(f"WITH {_COHORT} SELECT node, label FROM p WHERE node NOT IN (SELECT dst FROM fw)")
def orphan_targets(spark: SparkSession, sf_dir: str) -> DataFrame:  # G07
    return graph.orphans(bipartite(spark, sf_dir), *_cohorts(spark, sf_dir))


@query(f"""WITH {_B}, sd AS (SELECT s_suppkey AS node, CASE WHEN s_suppkey % 2 = 0 THEN 'L' ELSE 'R' END AS side FROM supplier),
n AS (SELECT count(*) FILTER (WHERE side = 'L') AS l, count(*) FILTER (WHERE side = 'R') AS r FROM sd),
g AS (SELECT dst AS node, count(*) FILTER (WHERE side = 'L') AS pairs_l, count(*) FILTER (WHERE side = 'R') AS pairs_r,
      coalesce(sum(weight) FILTER (WHERE side = 'L'), 0)::BIGINT AS contacts_l, coalesce(sum(weight) FILTER (WHERE side = 'R'), 0)::BIGINT AS contacts_r FROM b JOIN sd ON sd.node = src GROUP BY dst)
SELECT g.*, round(contacts_l / nullif(pairs_l, 0), 9) AS mean_l, round(contacts_r / nullif(pairs_r, 0), 9) AS mean_r, round(pairs_l / l, 9) AS complete_l, round(pairs_r / r, 9) AS complete_r,
       round(log2((contacts_l / nullif(pairs_l, 0)) / (contacts_r / nullif(pairs_r, 0))), 9) AS log2_ratio FROM g, n""")
def bilateral_profile(spark: SparkSession, sf_dir: str) -> DataFrame:  # A11
    sides = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.when(F.col("s_suppkey") % 2 == 0, "L").otherwise("R").alias("side"))
    out = graph.sided_profile(bipartite(spark, sf_dir), sides)
    return out.withColumns({c: F.round(c, 9) for c in ("mean_l", "mean_r", "complete_l", "complete_r", "log2_ratio")})


def _labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p = _cohorts(spark, sf_dir)
    return graph.type_pairs(bipartite(spark, sf_dir), s, p).where("src_type = dst_type").select("dst", F.col("dst_type").alias("label"), "weight")


_PROFILE = "SELECT dst, label, count(*) AS sources, sum(weight)::BIGINT AS total, min(weight) AS least, median(weight) AS median, max(weight) AS most FROM fw GROUP BY dst, label"


@query(f"WITH {_COHORT} {_PROFILE}")
def convergence_profile(spark: SparkSession, sf_dir: str) -> DataFrame:  # A08
    return graph.convergence_profile(_labelled_pairs(spark, sf_dir))


@query(f"WITH {_COHORT}, pr AS ({_PROFILE}) SELECT label, count(*) AS targets, round(avg(sources), 9) AS mean_sources, median(median) AS median_of_medians, round(avg(total), 9) AS mean_total FROM pr GROUP BY label")
def two_level_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:  # A09
    out = graph.rollup(graph.convergence_profile(_labelled_pairs(spark, sf_dir)))
    return out.withColumns({c: F.round(c, 9) for c in ("mean_sources", "mean_total")})


@query(f"WITH {_E}, m AS (SELECT user_id AS node FROM events GROUP BY ALL HAVING min(event_id) % 3 = 0) SELECT src, dst, weight FROM e WHERE src IN (SELECT node FROM m) AND dst IN (SELECT node FROM m)")
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:  # J05 G05
    nodes = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("node")).agg(F.min("event_id").alias("f")).where("f % 3 = 0").select("node")
    return graph.induced(user_graph(spark, sf_dir), nodes)


_HOP = f"""{_E}, {_LABEL},
seed AS MATERIALIZED (SELECT node FROM lab WHERE label = 'click'), readout AS MATERIALIZED (SELECT node FROM lab WHERE label = 'view'), present AS MATERIALIZED (SELECT src AS node FROM e UNION SELECT dst FROM e),
walk(node, hop) AS (SELECT node, 0 FROM seed WHERE node IN (SELECT node FROM present) UNION SELECT dst, hop + 1 FROM walk JOIN e ON src = node WHERE hop < 4),
f AS MATERIALIZED (SELECT node, min(hop)::INTEGER AS hop FROM walk GROUP BY node),
back(node, hop) AS (SELECT node, 0 FROM readout WHERE node IN (SELECT node FROM present) UNION SELECT src, hop + 1 FROM back JOIN e ON dst = node WHERE hop < 4),
r AS MATERIALIZED (SELECT node, min(hop)::INTEGER AS hop FROM back GROUP BY node)"""


def _ends(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Inputs and readouts by label: all users whose commonest event is a click, and all whose commonest is a view."""
    labels = cut(user_labels(spark, sf_dir))
    return labels.where("label = 'click'").select("node"), labels.where("label = 'view'").select("node")


@query(f"WITH RECURSIVE {_HOP} SELECT node, hop FROM f")
def hop_distance(spark: SparkSession, sf_dir: str) -> DataFrame:  # G02 U02 U03
    return graph.hops(user_graph(spark, sf_dir), _ends(spark, sf_dir)[0], 4)


@query(f"""WITH RECURSIVE {_HOP}, dep AS (SELECT min(hop) AS d FROM f WHERE hop > 0 AND node IN (SELECT node FROM readout)),
bk(node, hop) AS (SELECT node, hop FROM f, dep WHERE hop = d AND node IN (SELECT node FROM readout) UNION SELECT f.node, f.hop FROM bk JOIN e ON e.dst = bk.node JOIN f ON f.node = e.src AND f.hop = bk.hop - 1)
SELECT node, hop FROM bk""")
def shortest_path_circuit(spark: SparkSession, sf_dir: str) -> DataFrame:  # G01
    return graph.shortest_path_circuit(user_graph(spark, sf_dir), *_ends(spark, sf_dir), 4)


@query(f"WITH RECURSIVE {_HOP} SELECT f.node, f.hop AS forward, r.hop AS backward FROM f JOIN r USING (node) WHERE f.hop + r.hop <= 4")
def bounded_path(spark: SparkSession, sf_dir: str) -> DataFrame:  # G03
    return graph.bounded_path_circuit(user_graph(spark, sf_dir), *_ends(spark, sf_dir), 4)


@query(f"""WITH RECURSIVE {_HOP}, dn(node, hop) AS (SELECT node, hop FROM r WHERE node IN (SELECT node FROM seed) UNION SELECT r.node, r.hop FROM dn JOIN e ON e.src = dn.node JOIN r ON r.node = e.dst AND r.hop = dn.hop - 1)
SELECT node FROM dn UNION SELECT node FROM readout""")
def population_path_union(spark: SparkSession, sf_dir: str) -> DataFrame:  # G04
    return graph.population_path_union(user_graph(spark, sf_dir), *_ends(spark, sf_dir), 4)


@query(f"""WITH {_E}, {_LABEL}, k AS (SELECT DISTINCT dst AS node FROM e WHERE src IN (SELECT node FROM lab WHERE label = 'click')), p AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
SELECT node, CASE WHEN node IN (SELECT node FROM k) THEN 'kept' WHEN node IN (SELECT node FROM p) THEN 'pathless' ELSE 'unavailable' END AS status FROM lab""")
def endpoint_status(spark: SparkSession, sf_dir: str) -> DataFrame:  # G05 J06
    """Every user against what the inputs reach in one step."""
    edges = user_graph(spark, sf_dir)
    kept = edges.join(_ends(spark, sf_dir)[0].withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node"))
    return graph.endpoint_status(user_labels(spark, sf_dir).select("node"), edges, kept)


@query(f"""WITH RECURSIVE {_HOP}, g AS (SELECT count(*) AS links FROM e WHERE src IN (SELECT node FROM seed) AND dst IN (SELECT node FROM readout)),
k AS (SELECT DISTINCT src AS node FROM e WHERE src IN (SELECT node FROM seed) AND dst IN (SELECT node FROM readout) UNION SELECT dst FROM e WHERE src IN (SELECT node FROM seed) AND dst IN (SELECT node FROM readout))
SELECT 0::BIGINT AS only_bounded, 0::BIGINT AS only_shortest, (SELECT count(*) FROM k) AS bounded, (SELECT count(*) FROM k) AS shortest""")
def bounded_equals_shortest_k1(spark: SparkSession, sf_dir: str) -> DataFrame:  # U07
    edges = user_graph(spark, sf_dir)
    a, b = _ends(spark, sf_dir)
    bounded, shortest = graph.bounded_path_circuit(edges, a, b, 1).select("node"), graph.shortest_path_circuit(edges, a, b, 1).select("node")
    sides = bounded.withColumn("b", F.lit(1)).unionByName(shortest.withColumn("b", F.lit(0))).groupBy("node").agg(F.count_if(F.col("b") == 1).alias("b"), F.count_if(F.col("b") == 0).alias("s"))
    return sides.agg(F.count_if(F.col("b") > F.col("s")).alias("only_bounded"), F.count_if(F.col("s") > F.col("b")).alias("only_shortest"), F.sum("b").alias("bounded"), F.sum("s").alias("shortest"))


_CHANNELS = f"""{_E}, ch AS MATERIALIZED (SELECT user_id AS node, min(event_id) % 100 AS "set" FROM events GROUP BY ALL),
present AS MATERIALIZED (SELECT src AS node FROM e UNION SELECT dst FROM e),
walk("set", node, hop) AS (SELECT "set", node, 0 FROM ch WHERE node IN (SELECT node FROM present) UNION SELECT "set", dst, hop + 1 FROM walk JOIN e ON src = node WHERE hop < 3),
f AS MATERIALIZED (SELECT "set", node, min(hop)::INTEGER AS hop FROM walk GROUP BY ALL)"""


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred seed sets, in two batches of 64: each user is in one."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("node")).agg((F.min("event_id") % 100).alias("set"))


@query(f'WITH RECURSIVE {_CHANNELS} SELECT "set", hop, count(*) AS nodes, sum(node)::BIGINT AS node_sum FROM f GROUP BY ALL')
def channel_hops(spark: SparkSession, sf_dir: str) -> DataFrame:  # G02
    found = reach.hops(user_graph(spark, sf_dir), _channels(spark, sf_dir), 3)
    return found.groupBy("set", "hop").agg(F.count("*").alias("nodes"), F.sum("node").cast("bigint").alias("node_sum"))


@query(f"""WITH RECURSIVE {_CHANNELS}, {_LABEL},
back(node, hop) AS (SELECT node, 0 FROM lab WHERE label = 'view' AND node IN (SELECT node FROM present) UNION SELECT src, hop + 1 FROM back JOIN e ON dst = node WHERE hop < 3),
r AS MATERIALIZED (SELECT node, min(hop)::INTEGER AS hop FROM back GROUP BY node)
SELECT "set", f.node, f.hop AS forward, r.hop AS backward FROM f JOIN r USING (node) WHERE f.hop + r.hop <= 2""")
def channel_bounded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:  # G03 G04
    edges = user_graph(spark, sf_dir)
    return reach.bounded_paths(edges, _channels(spark, sf_dir), _ends(spark, sf_dir)[1], 2)


@query(f"""WITH {_E}, k AS MATERIALIZED (SELECT user_id AS node FROM events GROUP BY ALL HAVING min(event_id) % 3 = 0),
r AS (SELECT sha256(concat_ws('|', src::VARCHAR, dst::VARCHAR, weight::VARCHAR)) AS d, 1 AS edge FROM e WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k)
UNION ALL SELECT sha256(concat_ws('|', node::VARCHAR, node::VARCHAR, '\\N')), 0 FROM k),
g AS (SELECT d[1:2] AS g, sha256(string_agg(d, '' ORDER BY d)) AS h, sum(edge) AS edges, count(*) AS n FROM r GROUP BY ALL)
SELECT (sum(n) - sum(edges))::BIGINT AS nodes, sum(edges)::BIGINT AS edges, sha256(string_agg(h, '' ORDER BY g)) AS digest FROM g""")
def circuit_identity(spark: SparkSession, sf_dir: str) -> DataFrame:  # G05
    nodes = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("node")).agg(F.min("event_id").alias("f")).where("f % 3 = 0").select("node")
    return graph.identity(user_graph(spark, sf_dir), nodes)


_FLOW = f"""{_E}, i AS (SELECT dst, sum(weight) AS w FROM e GROUP BY dst), sh AS MATERIALIZED (SELECT src, e.dst, weight / greatest(w, 1) AS share FROM e JOIN i ON i.dst = e.dst),
lab2 AS (SELECT user_id AS node, min(event_id) % 4 AS g FROM events GROUP BY ALL),
s0 AS (SELECT node, 1.0::DOUBLE / count(*) OVER () AS mass FROM lab2 WHERE g = 0),
s1 AS (SELECT dst AS node, sum(share * mass) AS mass FROM sh JOIN s0 ON node = src GROUP BY dst),
s2 AS (SELECT dst AS node, sum(share * mass) AS mass FROM sh JOIN s1 ON node = src GROUP BY dst),
s3 AS (SELECT dst AS node, sum(share * mass) AS mass FROM sh JOIN s2 ON node = src GROUP BY dst)"""


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("node")).agg((F.min("event_id") % 4).alias("group"))


@query(f"""WITH {_FLOW}, a AS (SELECT 1 AS hop, * FROM s1 UNION ALL SELECT 2, * FROM s2 UNION ALL SELECT 3, * FROM s3)
SELECT 0 AS draw, g AS "group", hop, round(sum(mass) / (SELECT count(*) FROM lab2 x WHERE x.g = lab2.g), 9) AS arrival FROM a JOIN lab2 USING (node) GROUP BY g, hop""")
def flow_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:  # G08
    groups = _groups(spark, sf_dir)
    sources = groups.where("group = 0").select(F.lit(0).alias("draw"), "node")
    return graph.propagate(user_graph(spark, sf_dir), sources, groups, 3).withColumn("arrival", F.round("arrival", 9))


@query(f"""WITH {_FLOW} SELECT g AS "group", coalesce(sum(weight) FILTER (WHERE src IN (SELECT node FROM s0)), 0)::BIGINT AS contacts,
round(coalesce(sum(weight) FILTER (WHERE src IN (SELECT node FROM s0)), 0) / sum(weight), 9) AS share FROM e JOIN lab2 ON node = dst GROUP BY g""")
def direct_share(spark: SparkSession, sf_dir: str) -> DataFrame:  # G08
    groups = _groups(spark, sf_dir)
    return graph.direct_share(user_graph(spark, sf_dir), groups.where("group = 0"), groups).withColumn("share", F.round("share", 9))


@query(f"""WITH {_FLOW}, d AS (SELECT src AS node, sum(weight)::BIGINT AS value FROM e GROUP BY ALL), q AS (SELECT quantile_cont(value, [0, 0.25, 0.5, 0.75, 1]) AS q FROM d),
bn AS (SELECT node, greatest(least(len(list_filter(q, lambda x: x <= value)) - 1, 3), 0) AS bin FROM d, q),
want AS (SELECT bin, count(*) AS w FROM bn WHERE node IN (SELECT node FROM s0) GROUP BY bin),
dr AS (SELECT draw, node FROM (SELECT draw, node, w, row_number() OVER (PARTITION BY draw, bin ORDER BY md5(draw || ':' || node || ':null'), node) AS r FROM bn JOIN want USING (bin), range(1, 21) t(draw)) WHERE r <= w),
ds AS (SELECT draw, count(*) AS n FROM dr GROUP BY draw),
d1 AS (SELECT draw, dst AS node, sum(share / n) AS mass FROM sh JOIN dr ON node = src JOIN ds USING (draw) GROUP BY draw, dst),
nl AS (SELECT draw, g, sum(mass) / (SELECT count(*) FROM lab2 x WHERE x.g = lab2.g) AS arrival FROM d1 JOIN lab2 USING (node) GROUP BY draw, g),
ob AS (SELECT g, sum(mass) / (SELECT count(*) FROM lab2 x WHERE x.g = lab2.g) AS arrival FROM s1 JOIN lab2 USING (node) GROUP BY g)
SELECT nl.g AS "group", round(ob.arrival, 9) AS observed, round(median(nl.arrival), 9) AS null_median, round(ob.arrival / median(nl.arrival), 6) AS ratio,
       100.0::DOUBLE * avg((nl.arrival < ob.arrival)::INTEGER) AS percentile FROM nl JOIN ob ON ob.g = nl.g GROUP BY nl.g, ob.arrival""")
def matched_null_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:  # G09 O06
    edges, groups = user_graph(spark, sf_dir), _groups(spark, sf_dir)
    sources = groups.where("group = 0").select("node")
    d = edges.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("value"))
    draws = graph.matched_draws(populations.quantile_bins(d, "node", "value", 4), sources, 20)
    null = graph.propagate(edges, draws, groups, 1)
    observed = graph.propagate(edges, sources.withColumn("draw", F.lit(0)), groups, 1)
    out = graph.null_ratio(observed.select("group", "arrival"), null.select("group", "arrival"), ["group"], "arrival")
    return out.select("group", F.round("observed", 9).alias("observed"), F.round("null_median", 9).alias("null_median"), F.round("ratio", 6).alias("ratio"), "percentile")


@query(f"""WITH {_FLOW}, d AS (SELECT src AS node, sum(weight)::BIGINT AS value FROM e GROUP BY ALL), q AS (SELECT quantile_cont(value, [0, 0.25, 0.5, 0.75, 1]) AS q FROM d),
bn AS (SELECT node, greatest(least(len(list_filter(q, lambda x: x <= value)) - 1, 3), 0) AS bin FROM d, q), want AS (SELECT bin, count(*) AS n FROM bn WHERE node IN (SELECT node FROM s0) GROUP BY bin)
SELECT draw::INTEGER AS draw, bin::INTEGER AS bin, n AS drawn, n AS nodes FROM want, range(1, 51) t(draw)""")
def skip_draw_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:  # G09 O06
    """Sizes and different nodes of fifty matched draws, which are random and so have no SQL of their own."""
    edges, groups = user_graph(spark, sf_dir), _groups(spark, sf_dir)
    d = edges.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("value"))
    draws = graph.skip_draws(populations.quantile_bins(d, "node", "value", 4), groups.where("group = 0").select("node"), 50)
    return draws.groupBy("draw", F.col("bin").cast("int").alias("bin")).agg(F.count("*").alias("drawn"), F.count_distinct("node").alias("nodes"))


@query(f"""WITH {_FLOW}, a AS (SELECT g, sum(mass) / (SELECT count(*) FROM lab2 x WHERE x.g = lab2.g) AS arrival FROM s2 JOIN lab2 USING (node) GROUP BY g)
SELECT count(*) AS channels, round(max(arrival) / median(arrival), 9) AS dispersion FROM a HAVING count(*) >= 2""")
def dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:  # G10
    groups = _groups(spark, sf_dir)
    flow = graph.propagate(user_graph(spark, sf_dir), groups.where("group = 0").select(F.lit(0).alias("draw"), "node"), groups, 2).where("hop = 2")
    return flow.agg(F.count("*").alias("channels"), F.round(F.max("arrival") / F.median("arrival"), 9).alias("dispersion")).where("channels >= 2")


@query(f"""WITH {_B}, g AS (SELECT p_type, sum(weight) FILTER (WHERE src % 2 = 0) AS l, sum(weight) FILTER (WHERE src % 2 = 1) AS r FROM b JOIN part ON p_partkey + 1000000 = dst GROUP BY ALL)
SELECT p_type AS label, round(CASE WHEN coalesce(l, 0) + coalesce(r, 0) > 0 THEN (coalesce(l, 0) - coalesce(r, 0)) / (coalesce(l, 0) + coalesce(r, 0)) ELSE 0 END, 9) AS laterality FROM g""")
def laterality_index(spark: SparkSession, sf_dir: str) -> DataFrame:  # G10 ST24
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1000000).alias("dst"), F.col("p_type").alias("label"))
    sided = bipartite(spark, sf_dir).join(p, "dst").withColumn("side", F.when(F.col("src") % 2 == 0, "L").otherwise("R"))
    sides = sided.groupBy("label").pivot("side", ["L", "R"]).agg(F.sum("weight"))
    return sides.fillna(0).select("label", F.round(selectivity(F.col("L"), F.col("R")), 9).alias("laterality"))


@query(f"WITH {_E} SELECT src, dst, (SELECT greatest(round_even(median(weight), 0), 1)::BIGINT FROM e) AS weight FROM e")
def control_graph_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:  # G11
    return graph.uniform_weights(user_graph(spark, sf_dir))


@query(f"WITH {_E} SELECT * FROM e WHERE weight > 1")
def control_graph_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:  # G11 F09
    return graph.dropout(user_graph(spark, sf_dir), 1)


@query(f"WITH {_E} SELECT * FROM e WHERE src NOT IN (0, 5, 9)")
def control_graph_silenced(spark: SparkSession, sf_dir: str) -> DataFrame:  # G11 F09
    return graph.silenced(user_graph(spark, sf_dir), _users(spark, 0, 5, 9))


@query(f"""WITH {_E}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), {_LABEL}, ty AS (SELECT n.node, CASE WHEN label = 'click' THEN 'node:' || n.node ELSE label END AS label FROM n JOIN lab USING (node)),
w AS (SELECT a.label AS la, b.label AS lb, greatest(round_even(avg(weight), 0), 1)::BIGINT AS weight FROM e JOIN ty a ON a.node = src JOIN ty b ON b.node = dst GROUP BY ALL)
SELECT a.node AS src, b.node AS dst, weight FROM w JOIN ty a ON a.label = la JOIN ty b ON b.label = lb WHERE a.node <> b.node""")
def control_graph_type_only(spark: SparkSession, sf_dir: str) -> DataFrame:  # G11 J15
    labels = user_labels(spark, sf_dir).withColumn("label", F.when(F.col("label") != "click", F.col("label")))
    return graph.type_only(user_graph(spark, sf_dir), labels)


def _permuted(column: str, seed: str) -> str:
    own = "src, weight" if column == "dst" else "src, dst"
    same = lambda c: f"NOT EXISTS (SELECT 1 FROM gaps GROUP BY {c} HAVING sum(gap) <> 0)"
    rows = " UNION ALL ".join(f"SELECT '{name}' AS property, {test} AS preserved, (SELECT sum(greatest(gap, 0)) FROM gaps)::BIGINT AS moved" for name, test in (("edge_count", "(SELECT sum(gap) = 0 FROM gaps)"), ("out_degree", same("src")), ("in_degree", same("dst")), ("weights", same("weight"))))
    return f"""WITH {_E}, l AS (SELECT {own}, row_number() OVER (ORDER BY src, dst, weight) AS i FROM e),
r AS (SELECT {column}, row_number() OVER (ORDER BY md5(src || ':' || dst || ':{seed}'), src, dst, {column}) AS i FROM e),
n AS (SELECT src, dst, weight FROM l JOIN r USING (i)),
gaps AS (SELECT src, dst, weight, sum(s) AS gap FROM (SELECT src, dst, weight, 1 AS s FROM e UNION ALL SELECT src, dst, weight, -1 FROM n) GROUP BY ALL) {rows}"""


@query(_permuted("dst", "shuffle"))
def control_shuffle_preserves(spark: SparkSession, sf_dir: str) -> DataFrame:  # G13
    edges = user_graph(spark, sf_dir)
    return graph.preservation(edges, graph.shuffled_targets(edges))


@query(_permuted("weight", "weights"))
def control_permuted_weights_preserves(spark: SparkSession, sf_dir: str) -> DataFrame:  # G11
    edges = user_graph(spark, sf_dir)
    return graph.preservation(edges, graph.permuted_weights(edges))


@query(f"""WITH {_B}, x AS (SELECT 'N' || s_nationkey AS a, p_brand AS c FROM b JOIN supplier ON s_suppkey = src JOIN part ON p_partkey + 1000000 = dst)
SELECT CASE WHEN starts_with(a, 'N1') AND regexp_matches(c, '^Brand#2') THEN 'r1' WHEN starts_with(a, 'N') AND regexp_matches(c, '3$') AND a[-1] = c[-1] THEN 'r2' END AS rule,
       CASE WHEN starts_with(a, 'N1') AND regexp_matches(c, '^Brand#2') THEN 0.3::DOUBLE WHEN starts_with(a, 'N') AND regexp_matches(c, '3$') AND a[-1] = c[-1] THEN 0.6::DOUBLE END AS utilisation, count(*) AS edges FROM x GROUP BY ALL""")
def depressing_edges(spark: SparkSession, sf_dir: str) -> DataFrame:  # G15
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.concat(F.lit("N"), "s_nationkey").alias("label"))
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1000000).alias("node"), F.col("p_brand").alias("label"))
    rules = [{"id": "r1", "source_prefix": "N1", "target_regex": "^Brand#2", "utilisation": 0.3}, {"id": "r2", "source_prefix": "N", "target_regex": "3$", "utilisation": 0.6, "same_label": 1}]
    return graph.depressing(graph.type_pairs(bipartite(spark, sf_dir), s, p), rules).groupBy("rule", "utilisation").agg(F.count("*").alias("edges"))


@query(f"WITH {_E}, s AS (SELECT event_id % 50 AS t, user_id AS node FROM events WHERE event_type = 'error') SELECT t, dst AS node, sum(weight)::BIGINT AS delivered FROM s JOIN e ON node = src GROUP BY t, dst")
def spike_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:  # G16
    events = table(spark, sf_dir, "events").where("event_type = 'error'").select((F.col("event_id") % 50).alias("t"), F.col("user_id").alias("node"))
    return graph.fanout_delivery(user_graph(spark, sf_dir), events)


@query(f"WITH {_E} SELECT src, dst, weight FROM e ORDER BY weight DESC, src, dst LIMIT 40")
def top_routes(spark: SparkSession, sf_dir: str) -> DataFrame:  # O02
    return graph.top(user_graph(spark, sf_dir), 40, F.desc("weight"), F.col("src"), F.col("dst"))


@query(f"WITH {_E} SELECT src, arg_max(dst, struct_pack(w := weight, d := -dst)) AS best, max(weight) AS weight FROM e GROUP BY src")
def argbest_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:  # O03 O05
    return user_graph(spark, sf_dir).groupBy("src").agg(F.max_by("dst", F.struct("weight", -F.col("dst"))).alias("best"), F.max("weight").alias("weight"))
