"""Statistics, geometry and integrity over the driver tables."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions import tails
from strandweave.operators import integrity, spatial, stats
from strandweave.plans._registry import query, table


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("""WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS rx, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS ry FROM part)
SELECT count(*) AS n, round(corr(rx, ry), 9) AS rho FROM r""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:  # ST01 ST02
    return _rounded(stats.spearman(table(spark, sf_dir, "part"), "p_size", "p_retailprice"), 9, "rho")


@query("""SELECT p_partkey, (rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2)::DOUBLE AS rank FROM part""")
def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:  # ST01
    from strandweave.operators.ordered import ranked

    return ranked(table(spark, sf_dir, "part"), "p_size").select("p_partkey", F.col("rank").cast("double").alias("rank"))


@query("SELECT l_returnflag, count(l_quantity) AS n, round(stddev_samp(l_quantity) / avg(l_quantity), 9) AS cv FROM lineitem GROUP BY ALL")
def coefficient_of_variation(spark: SparkSession, sf_dir: str) -> DataFrame:  # ST06
    return _rounded(stats.variation(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity"), 9, "cv")


@query("SELECT count(*) FILTER (WHERE d > 0) AS positive, count(*) FILTER (WHERE d < 0) AS negative, count(*) FILTER (WHERE d = 0) AS ties FROM (SELECT l_linenumber - l_quantity::INTEGER % 7 AS d FROM lineitem)")
def sign_test_counts(spark: SparkSession, sf_dir: str) -> DataFrame:  # ST04
    return stats.sign_counts(table(spark, sf_dir, "lineitem"), F.col("l_linenumber") - F.col("l_quantity").cast("int") % 7)


@query()
def sign_test_p(spark: SparkSession, sf_dir: str) -> DataFrame:  # ST03 ST04 ST05 ST08
    """Tail probabilities of what the lines of each flag give: signs and mean of discount less tax, its correlation with quantity, and line numbers against equal shares."""
    d = F.col("l_discount") - F.col("l_tax")
    lines = table(spark, sf_dir, "lineitem")
    each = lines.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(d > 0).alias("positive"), F.count_if(d < 0).alias("negative"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"), F.corr(d, "l_quantity").alias("rho"))
    numbers = lines.groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("c")).groupBy("l_returnflag").agg(F.count("*").alias("kinds"), F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("squares"))
    rows = []
    for r in each.join(numbers, "l_returnflag").collect():  # a row for each flag
        chi = r["squares"] * r["kinds"] / r["all"] - r["all"]
        rows += [
            (r["l_returnflag"], "sign_test", tails.sign_test(r["positive"], r["negative"])), (r["l_returnflag"], "t_two_sided", tails.t_two_sided(r["mean"] / r["sd"] * r["n"] ** 0.5, r["n"] - 1)),
            (r["l_returnflag"], "t_quantile", tails.t_quantile(r["n"] - 1)), (r["l_returnflag"], "chi_square", tails.chi_square_upper(chi, r["kinds"] - 1)), (r["l_returnflag"], "spearman", tails.spearman_p(r["rho"], r["n"])),
        ]
    return spark.createDataFrame(rows, "flag string, name string, value double")


_T5 = ", ".join(f"({n}, {tails.t_quantile(n - 1)!r})" for n in range(2, 60))


@query(f"""WITH t(n, t) AS (VALUES {_T5}),
g AS (SELECT s_nationkey, count(*) FILTER (WHERE v IS NOT NULL) AS n, count(*) FILTER (WHERE v IS NULL) AS excluded, avg(v) AS mean, stddev_samp(v) AS sd, min(v) AS least, max(v) AS most
 FROM (SELECT s_nationkey, CASE WHEN s_suppkey % 10 <> 3 THEN s_acctbal END AS v FROM supplier) GROUP BY ALL)
SELECT s_nationkey, g.n, excluded, round(mean, 6) AS mean, round(sd, 6) AS sd, round(sd / sqrt(g.n), 6) AS se, round(mean - t * sd / sqrt(g.n), 6) AS low, round(mean + t * sd / sqrt(g.n), 6) AS high, least, most FROM g LEFT JOIN t ON t.n = g.n""")
def cohort_summary(spark: SparkSession, sf_dir: str) -> DataFrame:  # A20 F11
    s = table(spark, sf_dir, "supplier").select("s_nationkey", F.when(F.col("s_suppkey") % 10 != 3, F.col("s_acctbal")).alias("v"))
    return _rounded(stats.cohort_summary(s, ["s_nationkey"], "v"), 6, "mean", "sd", "se", "low", "high")


@query("""WITH g AS (SELECT l_returnflag, l_linenumber, avg(l_quantity) AS m, stddev_samp(l_quantity) / sqrt(count(*)) AS se, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linenumber, n, round(m / first(m) OVER w, 9) AS mean, round(se / first(m) OVER w, 9) AS se FROM g WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_linenumber)""")
def pulse_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:  # A21
    return _rounded(stats.pulse_normalised(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_quantity", ["l_returnflag"]), 9, "mean", "se")


@query("""WITH x AS (SELECT toxic, (n_chars - 1500)::DOUBLE AS s FROM labels JOIN documents USING (doc_id)),
r AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS k FROM x),
c AS (SELECT count(*) FILTER (WHERE toxic = 1 AND s > 0) AS tp, count(*) FILTER (WHERE toxic <> 1 AND s > 0) AS fp, count(*) FILTER (WHERE toxic = 1 AND s <= 0) AS fn, count(*) FILTER (WHERE toxic <> 1 AND s <= 0) AS tn, sum(k) FILTER (WHERE toxic = 1) AS r FROM r)
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round(tp / (tp + fn), 9) AS sensitivity, round(tn / (fp + tn), 9) AS specificity,
       round((tp / (tp + fn) + tn / (fp + tn)) / 2, 9) AS balanced_accuracy, round((r - (tp + fn) * (tp + fn + 1) / 2) / ((tp + fn) * (fp + tn)), 9) AS auroc FROM c""")
def confusion_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:  # A22
    x = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") - 1500).cast("double").alias("s")), "doc_id")
    return _rounded(stats.binary_metrics(x, "toxic", "s"), 9, "accuracy", "sensitivity", "specificity", "balanced_accuracy", "auroc")


_CURVE = "SELECT date_trunc('month', o_orderdate) AS m, round(avg(o_totalprice), 6) AS v FROM orders WHERE o_orderstatus = '{}' GROUP BY ALL"


@query(f"""WITH a AS ({_CURVE.format('F')}), b AS ({_CURVE.format('O')})
SELECT count(*) AS points, round(sqrt(avg((a.v - b.v) ** 2)), 4) AS rmse, round(avg(abs(a.v - b.v)), 4) AS mae, round(corr(a.v, b.v), 6) AS pearson, round(count(*) FILTER (WHERE b.v > 0 AND a.v > 0) / count(*) FILTER (WHERE b.v > 0), 9) AS coverage
FROM a JOIN b USING (m)""")
def curve_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:  # A23 J13
    curve = lambda s: table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).groupBy(F.date_trunc("month", "o_orderdate").alias("m")).agg(F.round(F.avg("o_totalprice"), 6).alias("value"))
    out = stats.curve_metrics(curve("F"), curve("O"), "m")
    return _rounded(_rounded(_rounded(out, 4, "rmse", "mae"), 6, "pearson"), 9, "coverage")


@query("SELECT l_linestatus, count(l_discount) AS n, round(avg(l_discount), 9) AS mean, round(stddev_pop(l_discount), 9) AS sd FROM lineitem GROUP BY ALL")
def control_summary(spark: SparkSession, sf_dir: str) -> DataFrame:  # A16
    return _rounded(stats.control_summary(table(spark, sf_dir, "lineitem"), "l_linestatus", "l_discount"), 9, "mean", "sd")


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 6) AS q5, round(median(l_extendedprice), 6) AS q50, round(quantile_cont(l_extendedprice, 0.95), 6) AS q95 FROM lineitem GROUP BY ALL")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:  # ST07 A29 A30
    return _rounded(stats.quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", (0.05, 0.5, 0.95)), 6, "q5", "q50", "q95")


@query("""WITH x AS (SELECT user_id % 6 AS g, (event_id % 40)::DOUBLE AS x, ln(exp(-((event_id % 40) / (10.0 + user_id % 6))) * (1 + (value - 20) / 4000)) AS y, exp(-((event_id % 40) / (10.0 + user_id % 6))) * (1 + (value - 20) / 4000) AS rem FROM events),
f AS (SELECT g, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2 FROM x WHERE rem > 0.1 AND rem < 0.9 GROUP BY g)
SELECT g, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2, CASE WHEN n < 10 THEN 'few' WHEN NOT coalesce(slope < 0, false) THEN 'rising' WHEN r2 < 0.9 THEN 'poor' ELSE 'ok' END AS verdict,
       CASE WHEN n >= 10 AND slope < 0 AND r2 >= 0.9 THEN round(-1 / slope, 4) END AS tau FROM f""")
def charging_fit(spark: SparkSession, sf_dir: str) -> DataFrame:  # ST14
    t = (F.col("event_id") % 40).cast("double")
    rem = F.exp(-(t / (10.0 + F.col("user_id") % 6))) * (1 + (F.col("value") - 20) / 4000)
    out = stats.log_linear_fit(table(spark, sf_dir, "events").withColumn("g", F.col("user_id") % 6), ["g"], t, rem, 0.1, 0.9, 0.9)
    return _rounded(_rounded(out, 6, "slope", "intercept", "r2"), 4, "tau")


@query("""WITH x AS (SELECT user_id AS g, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::DOUBLE AS t, value AS v FROM events), b AS (SELECT g, avg(v) FILTER (WHERE t < 10) AS baseline FROM x GROUP BY g),
p AS (SELECT g, baseline, max(v - baseline) AS peak, arg_max(t, struct_pack(a := v - baseline, b := -t)) AS peak_time FROM x JOIN b USING (g) WHERE t >= 10 GROUP BY ALL)
SELECT p.g, round(p.baseline, 9) AS baseline, round(peak, 9) AS peak, peak_time, (SELECT min(t) FROM x WHERE x.g = p.g AND t > peak_time AND v - baseline <= peak / exp(1.0)) - peak_time AS decay FROM p""")
def waveform_features(spark: SparkSession, sf_dir: str) -> DataFrame:  # ST13
    from strandweave.plans.trace_queries import trace

    x = trace(spark, sf_dir).select(F.col("key").alias("g"), F.col("i").cast("double").alias("t"), F.col("value").alias("v"))
    return _rounded(stats.waveform_features(x, ["g"], "t", "v", 10.0), 9, "baseline", "peak")


@query("""WITH x AS (SELECT l_returnflag AS g, l_linenumber, avg(l_quantity) AS v, stddev_samp(l_quantity) / sqrt(count(*)) AS se FROM lineitem GROUP BY ALL), m AS (SELECT g, sum(v / (se * se)) / sum(1 / (se * se)) AS mean FROM x GROUP BY g)
SELECT g, round(mean, 6) AS mean, count(*) AS n, round(sum(((v - mean) / se) ** 2), 6) AS chi2, count(*) FILTER (WHERE abs((v - mean) / se) <= 1.96) AS inside FROM x JOIN m USING (g) GROUP BY g, mean""")
def weighted_null(spark: SparkSession, sf_dir: str) -> DataFrame:  # ST22
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("g"), "l_linenumber").agg(F.avg("l_quantity").alias("v"), (F.stddev_samp("l_quantity") / F.sqrt(F.count("*"))).alias("se"))
    return _rounded(stats.weighted_null(x, ["g"], "v", "se"), 6, "mean", "chi2")


@query("""WITH x AS (SELECT p_brand AS label, avg(p_size) / 100.0 AS q, 2.0::DOUBLE AS r, count(*) AS possible, sum(p_size) AS total FROM part GROUP BY ALL), y AS (SELECT *, q * 0.8 / (1 - q * 0.2) AS qt FROM x)
SELECT label, round(qt, 9) AS q_true, round((1 - q ** r) / (1 - qt ** r), 9) AS predicted, round(1 - q ** r, 9) AS floor, round(total / (0.8 * possible), 9) AS exact_mean FROM y""")
def unthin_correct(spark: SparkSession, sf_dir: str) -> DataFrame:  # ST10
    x = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("label")).agg((F.avg("p_size") / 100).alias("q"), F.lit(2.0).alias("r"), F.count("*").alias("possible"), F.sum("p_size").alias("total"))
    return _rounded(stats.corrected(x, 0.8), 9, "q_true", "predicted", "floor", "exact_mean")


@query("""SELECT p_partkey, round(1 - u * exp(-gap / 200.0), 9) AS ppr, round((1 - exp(-gap / 200.0)) / (1 - (1 - u) * exp(-gap / 200.0)), 9) AS steady
FROM (SELECT p_partkey, p_size * 25.0::DOUBLE AS gap, (1 + p_partkey % 9) * 0.1::DOUBLE AS u FROM part)""")
def paired_pulse_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:  # ST19
    own = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 25.0).alias("gap"), ((1 + F.col("p_partkey") % 9) * 0.1).alias("u"))
    tau = F.lit(200.0)
    return own.select("p_partkey", F.round(stats.paired_pulse_ratio(F.col("u"), F.col("gap"), tau), 9).alias("ppr"), F.round(stats.train_steady_state(F.col("u"), F.col("gap"), tau), 9).alias("steady"))


@query("""WITH RECURSIVE r(p_partkey, gap, k, v) AS (SELECT p_partkey, p_size * 25.0::DOUBLE, 1, 1.0::DOUBLE FROM part UNION ALL SELECT p_partkey, gap, k + 1, 1 - (1 - v * 0.6::DOUBLE) * exp(-gap / 200.0) FROM r WHERE k < 12)
SELECT p_partkey, k AS pulse, round(v, 9) AS resource FROM r""")
def train_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:  # ST19
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 25.0).alias("gap"))
    rows = rows.withColumn("r", stats.train_resource(F.lit(0.4), F.col("gap"), F.lit(200.0), 12))
    return rows.select("p_partkey", F.posexplode("r").alias("p", "v")).select("p_partkey", (F.col("p") + 1).alias("pulse"), F.round("v", 9).alias("resource"))


@query("SELECT p_partkey, round(CASE WHEN p_size * 1.2::DOUBLE > 15 THEN 1000 / (2.0 + 20 * ln(p_size * 1.2::DOUBLE / (p_size * 1.2::DOUBLE - 15))) ELSE 0 END, 6) AS rate FROM part")
def steady_state_rate(spark: SparkSession, sf_dir: str) -> DataFrame:  # ST16
    return table(spark, sf_dir, "part").select("p_partkey", F.round(stats.lif_rate(F.col("p_size"), 1.2, 15.0, 20.0, 2.0), 6).alias("rate"))


@query("""WITH c AS (SELECT l_returnflag AS specimen, l_linenumber AS x, round(avg(l_quantity), 6) AS y FROM lineitem GROUP BY ALL), g AS (SELECT specimen, list(x ORDER BY x) AS xs, list(y ORDER BY x) AS ys FROM c GROUP BY specimen)
SELECT specimen, len(ys)::INTEGER AS points, round(ys[1], 6) AS first_value, (SELECT count(DISTINCT xs) = 1 FROM g) AS shared FROM g""")
def grouped_curves(spark: SparkSession, sf_dir: str) -> DataFrame:  # ST17
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("specimen"), F.col("l_linenumber").alias("x")).agg(F.round(F.avg("l_quantity"), 6).alias("y"))
    return stats.grouped_curves(c, "specimen", "x", "y").select("specimen", F.size("curve").alias("points"), F.get("curve", F.lit(0)).alias("first_value"), "shared")


# Geometry

_PTS = "p AS MATERIALIZED (SELECT vec_id, label, floor(embedding[1]::DOUBLE * 1000) AS x, floor(embedding[2]::DOUBLE * 1000) AS y, floor(embedding[3]::DOUBLE * 1000) AS z FROM embeddings)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.floor(e[i].cast("double") * 1000).cast("double").alias(c) for i, c in enumerate("xyz")])


@query(f"WITH {_PTS} SELECT label, count(DISTINCT (floor(x / 125), floor(y / 125), floor(z / 125))) AS bins, round(count(DISTINCT (floor(x / 125), floor(y / 125), floor(z / 125))) * 1.0::DOUBLE, 9) AS volume FROM p GROUP BY label")
def occupied_volume(spark: SparkSession, sf_dir: str) -> DataFrame:  # P3-1
    return spatial.occupied(points(spark, sf_dir), ["label"], 125.0, 1.0)


@query(f"""WITH {_PTS}, s AS (SELECT *, row_number() OVER (PARTITION BY label, rep ORDER BY md5(rep || ':' || vec_id || ':rare'), vec_id) AS r FROM p, range(1, 6) t(rep)),
v AS (SELECT label, rep, count(DISTINCT (floor(x / 125), floor(y / 125), floor(z / 125))) AS volume FROM s WHERE r <= 20 GROUP BY ALL) SELECT label, round(avg(volume), 9) AS volume FROM v GROUP BY label""")
def rarefied_volume(spark: SparkSession, sf_dir: str) -> DataFrame:  # P3-2
    return _rounded(spatial.rarefied(points(spark, sf_dir), ["label"], "vec_id", 20, 5, 125.0, 1.0), 9, "volume")


_NEAR = f"""{_PTS}, o AS (SELECT vec_id AS object_id, CASE WHEN vec_id % 2 = 0 THEN 'food' ELSE 'wall' END AS kind, 5.0 + vec_id % 3 AS radius, x, y, z FROM p WHERE vec_id % 25 = 0),
n AS (SELECT p.vec_id AS point_id, arg_min(struct_pack(object_id, kind, distance := sqrt((p.x - o.x) ** 2 + (p.y - o.y) ** 2 + (p.z - o.z) ** 2), radius), struct_pack(d := sqrt((p.x - o.x) ** 2 + (p.y - o.y) ** 2 + (p.z - o.z) ** 2), i := object_id)) AS b FROM p, o GROUP BY p.vec_id)"""


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    o = p.where("vec_id % 25 = 0").select(F.col("vec_id").alias("object_id"), F.when(F.col("vec_id") % 2 == 0, "food").otherwise("wall").alias("kind"), (5.0 + F.col("vec_id") % 3).alias("radius"), "x", "y", "z")
    return spatial.nearest(p.withColumnRenamed("vec_id", "point_id"), o, ("x", "y", "z"))


@query(f"WITH {_NEAR} SELECT point_id, b.object_id, b.kind, round(b.distance, 6) AS distance, round(b.distance - b.radius, 6) AS gap FROM n")
def nearest_object(spark: SparkSession, sf_dir: str) -> DataFrame:  # J16
    return _rounded(_nearest(spark, sf_dir), 6, "distance", "gap")


@query(f"WITH {_NEAR} SELECT b.kind, count(*) AS points, count(*) FILTER (WHERE b.distance - b.radius < 100) AS within FROM n GROUP BY b.kind")
def object_census(spark: SparkSession, sf_dir: str) -> DataFrame:  # A24
    return _nearest(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("points"), F.count_if(F.col("gap") < 100).alias("within"))


@query(f"WITH {_PTS} SELECT p.vec_id AS a, q.vec_id AS b FROM p JOIN p q ON p.vec_id < q.vec_id AND sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) < 10 + p.vec_id % 5 + 10 + q.vec_id % 5")
def disc_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:  # J17
    discs = points(spark, sf_dir).select(F.col("vec_id").alias("id"), "x", "y", (10.0 + F.col("vec_id") % 5).alias("r"))
    return spatial.overlaps(discs, 28.0)


@query("SELECT a.n_nationkey AS agent, b.n_nationkey AS seen, 'agent' AS kind FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey UNION ALL SELECT n_nationkey, r_regionkey + 100, 'region' FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 2")
def visibility_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:  # J22
    agents = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("agent"), F.col("n_regionkey").alias("scene"))
    objects = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("object"), F.col("r_regionkey").alias("scene"), F.lit("region").alias("kind"), (F.col("r_regionkey") != 2).alias("visible"))
    return spatial.visible(agents, objects)


_OBJ = "o AS (SELECT x AS ox, y AS oy, 2.0 + vec_id % 7 AS alpha, 0.5 + (vec_id % 3) / 2 AS gain FROM p WHERE vec_id % 100 = 0)"


@query(f"""WITH {_PTS}, {_OBJ}, d AS (SELECT vec_id AS cell, max(exp(-((x - ox) ** 2 + (y - oy) ** 2) / (2 * (40.0 + alpha * 5.0) ** 2)) * (alpha / (alpha + 3.0)) * gain) AS d FROM p, o GROUP BY vec_id) SELECT cell, round(5.0 + least(greatest(d, 0), 1) * 95.0, 6) AS rate FROM d""")
def receptive_field_max(spark: SparkSession, sf_dir: str) -> DataFrame:  # P3-5
    p = points(spark, sf_dir)
    o = p.where("vec_id % 100 = 0").select(F.col("x").alias("ox"), F.col("y").alias("oy"), (2.0 + F.col("vec_id") % 7).alias("alpha"), (0.5 + (F.col("vec_id") % 3) / 2).alias("gain"))
    return _rounded(spatial.field_drive(p.withColumnRenamed("vec_id", "cell"), o, 40.0, 5.0, 3.0, 5.0, 95.0), 6, "rate")


@query(f"WITH {_PTS}, s AS (SELECT x AS sx, y AS sy, 500.0 + vec_id AS strength FROM p WHERE vec_id % 100 = 0), d AS (SELECT vec_id AS point_id, sum(strength / ((x - sx) ** 2 + (y - sy) ** 2 + 25.0)) AS c FROM p, s GROUP BY vec_id) SELECT point_id, round(c / (1 + c), 6) AS odour FROM d")
def odor_field(spark: SparkSession, sf_dir: str) -> DataFrame:  # P3-6
    p = points(spark, sf_dir)
    s = p.where("vec_id % 100 = 0").select(F.col("x").alias("sx"), F.col("y").alias("sy"), (500.0 + F.col("vec_id")).alias("strength"))
    return _rounded(spatial.odour(p.withColumnRenamed("vec_id", "point_id"), s, 25.0), 6, "odour")


@query(f"WITH {_PTS} SELECT vec_id, round(degrees(atan2(sin(atan2(y, x) - label), cos(atan2(y, x) - label))), 6) AS bearing, round(degrees(asin(least(1.0, 30.0 / greatest(sqrt(x * x + y * y), 1e-9)))), 6) AS radius FROM p")
def bearings(spark: SparkSession, sf_dir: str) -> DataFrame:  # P3-4
    x, y = F.col("x"), F.col("y")
    return points(spark, sf_dir).select("vec_id", F.round(spatial.bearing(x, y, F.col("label")), 6).alias("bearing"), F.round(spatial.angular_radius(F.lit(30.0), F.sqrt(x * x + y * y)), 6).alias("radius"))


@query(f"""WITH {_PTS}, b AS (SELECT label, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM p GROUP BY label)
SELECT vec_id, round((x - (lx + hx) / 2) / greatest(hx - lx, hy - ly, hz - lz), 9) AS x, round((y - (ly + hy) / 2) / greatest(hx - lx, hy - ly, hz - lz), 9) AS y FROM p JOIN b USING (label)""")
def unit_box(spark: SparkSession, sf_dir: str) -> DataFrame:  # P3-8
    return spatial.unit_box(points(spark, sf_dir), ["label"]).select("vec_id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query(f"""WITH {_PTS}, c AS (SELECT p.vec_id, k AS candidate, min(abs((q.x - p.x) * sin(k * 2 * pi() / 12) - (q.y - p.y) * cos(k * 2 * pi() / 12))) AS c FROM p, p q, range(0, 12) t(k) WHERE p.label % 2 = 0 AND q.label % 2 = 1 GROUP BY ALL)
SELECT candidate::INTEGER AS candidate, round(median(c), 6) AS clearance FROM c GROUP BY candidate""")
def clearance_search(spark: SparkSession, sf_dir: str) -> DataFrame:  # P3-7
    """Every point has a role: those of even labels are the path, those of odd ones the obstacles."""
    p = points(spark, sf_dir)
    path = p.where("label % 2 = 0").select(F.col("vec_id").alias("point_id"), "x", "y")
    return _rounded(spatial.clearest_direction(path, p.where("label % 2 = 1").select(F.col("x").alias("ox"), F.col("y").alias("oy")), 12), 6, "clearance")


# Integrity


@query("""WITH r AS (SELECT sha256(concat_ws('|', p_partkey::VARCHAR, p_brand, p_size::VARCHAR, coalesce(nullif(p_type, 'ECONOMY'), '\\N'))) AS d FROM part),
g AS (SELECT d[1:2] AS g, count(*) AS n, sha256(string_agg(d, '' ORDER BY d)) AS h FROM r GROUP BY ALL) SELECT sum(n)::BIGINT AS rows, sha256(string_agg(h, '' ORDER BY g)) AS digest FROM g""")
def logical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:  # P02
    part = table(spark, sf_dir, "part").withColumn("kind", F.expr("nullif(p_type, 'ECONOMY')"))
    return integrity.logical_digest(part.repartition(5), ["p_partkey", "p_brand", "p_size", "kind"], 2)


@query("SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_key FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicate_content(spark: SparkSession, sf_dir: str) -> DataFrame:  # U08
    return integrity.duplicate_content(table(spark, sf_dir, "documents"), "doc_id", "text")


_LEGS = """legs AS (SELECT 'g' || l_linenumber AS gate, l_orderkey * 10 + l_linenumber AS leg, CASE l_linenumber % 3 WHEN 0 THEN 'expect' WHEN 1 THEN 'at_least' ELSE 'below' END AS kind,
 CASE l_linenumber % 3 WHEN 0 THEN l_quantity WHEN 1 THEN 0 ELSE 50 END::DOUBLE AS "limit", l_quantity::DOUBLE AS value, l_tax > 0.07 AS retired FROM lineitem)"""


_GATES = """s AS (SELECT *, CASE kind WHEN 'expect' THEN value = "limit" WHEN 'at_least' THEN value >= "limit" ELSE value < "limit" END AS passed FROM legs)
SELECT gate, count(*) AS legs, count(*) FILTER (WHERE NOT passed AND NOT retired) AS failed, count(*) FILTER (WHERE NOT passed AND NOT retired) = 0 AS passed FROM s GROUP BY gate"""


def _legs(lines: DataFrame) -> DataFrame:
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("double")
    kind = F.when(n % 3 == 0, "expect").when(n % 3 == 1, "at_least").otherwise("below")
    limit = F.when(n % 3 == 0, q).when(n % 3 == 1, 0.0).otherwise(50.0)
    return lines.select(F.concat(F.lit("g"), n).alias("gate"), (F.col("l_orderkey") * 10 + n).alias("leg"), kind.alias("kind"), limit.alias("limit"), q.alias("value"), (F.col("l_tax") > 0.07).alias("retired"))


@query(f"WITH {_LEGS}, {_GATES}")
def gate_legs(spark: SparkSession, sf_dir: str) -> DataFrame:  # P08
    return integrity.gates(_legs(table(spark, sf_dir, "lineitem")))


@query("SELECT DISTINCT c_custkey AS key FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def consumed_guard(spark: SparkSession, sf_dir: str) -> DataFrame:  # U09
    spent = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key"))
    return integrity.overlap(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), spent, "key")


@query("""WITH e AS (SELECT user_id AS subject, event_type AS tier, value > 20 AS valid FROM events), r(tier, k) AS (VALUES ('view', 1), ('click', 2), ('signup', 3), ('purchase', 4), ('error', 5))
SELECT subject, arg_max(tier, k) AS tier FROM e JOIN r USING (tier) WHERE valid GROUP BY subject""")
def supported_tier(spark: SparkSession, sf_dir: str) -> DataFrame:  # O04 P07
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), F.col("event_type").alias("tier"), (F.col("value") > 20).alias("valid"))
    return integrity.highest_tier(e, ["view", "click", "signup", "purchase", "error"])


@query("""WITH l AS (SELECT s_suppkey AS artifact, md5(s_name) AS digest, length(s_name) AS bytes FROM supplier WHERE s_suppkey % 10 <> 1), o AS (SELECT s_suppkey AS artifact, md5(CASE WHEN s_suppkey % 10 = 2 THEN reverse(s_name) ELSE s_name END) AS d, CASE WHEN s_suppkey % 10 = 3 THEN 1 ELSE length(s_name) END AS b FROM supplier WHERE s_suppkey % 10 <> 4)
SELECT artifact, CASE WHEN digest IS NULL THEN 'unlocked' WHEN d IS NULL THEN 'missing' WHEN bytes <> b THEN 'size' WHEN digest <> d THEN 'mismatch' ELSE 'ok' END AS status FROM l FULL OUTER JOIN o USING (artifact)""")
def lock_status(spark: SparkSession, sf_dir: str) -> DataFrame:  # P03 P04
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    locked = s.where(k % 10 != 1).select(k.alias("artifact"), F.md5("s_name").alias("digest"), F.length("s_name").alias("bytes"))
    name = F.when(k % 10 == 2, F.reverse("s_name")).otherwise(F.col("s_name"))
    seen = s.where(k % 10 != 4).select(k.alias("artifact"), F.md5(name).alias("digest"), F.when(k % 10 == 3, 1).otherwise(F.length("s_name")).alias("bytes"))
    return integrity.lock_status(locked, seen)


@query("SELECT 'o_orderstatus' AS property, count(DISTINCT o_orderstatus) AS distinct_values, count(DISTINCT o_orderstatus) = 1 AS consistent FROM orders UNION ALL SELECT 'century', count(DISTINCT year(o_orderdate) // 100), count(DISTINCT year(o_orderdate) // 100) = 1 FROM orders")
def chain_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:  # A31
    v = table(spark, sf_dir, "orders").select("o_orderstatus", F.floor(F.year("o_orderdate") / 100).alias("century"))
    return integrity.consistent(v, ["o_orderstatus", "century"])


@query("""WITH n AS (SELECT n_name AS name FROM nation), d AS (SELECT n_name AS name FROM nation WHERE n_nationkey % 4 <> 0 UNION ALL SELECT n_name FROM nation WHERE n_nationkey % 5 = 1 UNION ALL SELECT r_name || '!' FROM region), c AS (SELECT name, count(*) AS k FROM d GROUP BY name)
SELECT coalesce(n.name, c.name) AS name, CASE WHEN n.name IS NULL THEN 'absent' WHEN k IS NULL THEN 'unclassified' WHEN k > 1 THEN 'contradictory' ELSE 'ok' END AS verdict FROM n FULL OUTER JOIN c ON c.name = n.name""")
def reservation_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:  # P11 U04
    n = table(spark, sf_dir, "nation")
    d = n.where("n_nationkey % 4 <> 0").select(F.col("n_name").alias("name")).unionByName(n.where("n_nationkey % 5 = 1").select(F.col("n_name").alias("name")))
    d = d.unionByName(table(spark, sf_dir, "region").select(F.concat("r_name", F.lit("!")).alias("name")))
    return integrity.reservations(n.select(F.col("n_name").alias("name")), d)


@query("SELECT round(count(*) * 24 / 1e6, 6) AS edge_mb, round(count(*) * 24 * 100 / 1e6, 6) AS scaled_mb FROM lineitem")
def sizing_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:  # A32
    n = F.count("*")
    return table(spark, sf_dir, "lineitem").agg(F.round(n * 24 / 1e6, 6).alias("edge_mb"), F.round(n * 24 * 100 / 1e6, 6).alias("scaled_mb"))
