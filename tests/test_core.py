"""Small cases with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from strandweave import schema
from strandweave.errors import IntegrityError, SchemaError
from strandweave.functions import predicates as P
from strandweave.functions import tails
from strandweave.operators import contacts, graph, integrity, populations, spatial, stats, traces


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(10, 20, 2), (10, 50, 1), (20, 40, 3), (30, 40, 4), (30, 50, 1), (40, 50, 5)], "src long, dst long, weight long")


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "node long")


def test_duplicate_edges_are_summed(spark, rows):
    raw = spark.createDataFrame([(4294967297, 9, 2), (4294967297, 9, 3), (9, 7, 1)], "body_pre long, body_post long, weight long")
    edges = graph.aggregated(schema.edge_columns(raw), "src", "dst", F.col("weight"))
    assert rows(edges) == [(4294967297, 9, 5), (9, 7, 1)]
    assert graph.nodes_of(edges).count() == 3


def test_unknown_columns_are_refused(spark):
    with pytest.raises(SchemaError, match="source"):
        schema.edge_columns(spark.createDataFrame([(1, 2, 3)], "a long, b long, c long"))


def test_invalid_edges_are_refused(spark):
    with pytest.raises(IntegrityError, match="nonpositive"):
        schema.require_valid(spark.createDataFrame([(1, 2, 0)], "src long, dst long, weight long"))


def test_universe_restriction(spark, rows):
    from strandweave.sources.imports import restricted

    edges = spark.createDataFrame([(9, 12, 3), (9, 99, 2)], "src long, dst long, weight long")
    kept, out = restricted(edges, ids(spark, 9, 12))
    assert rows(kept) == [(9, 12, 3)]
    assert rows(out) == [(1, 2, 2)]


def test_nested_universes(spark):
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (2, 3, 5), (3, 1, 7)], "src long, dst long, weight long")
    status = spark.createDataFrame([(1, "Traced"), (2, "Assign"), (3, "Anchor")], "node long, status string")
    sets = [("all", None), ("t", ("Traced",)), ("ta", ("Traced", "Assign")), ("taa", ("Traced", "Assign", "Anchor"))]
    got = {r["universe"]: (r["edges"], r["contacts"]) for r in graph.universes(edges, status, sets).collect()}
    assert got == {"all": (4, 17), "t": (1, 2), "ta": (2, 5), "taa": (4, 17)}


def test_threshold_counts(spark):
    df = spark.createDataFrame([(0.5, 0.6), (0.7, 0.8), (0.9, 1.0)], "a double, b double")
    got = contacts.threshold_counts(df, F.least("a", "b"), (0.5, 0.6, 0.7, 0.8, 0.9)).collect()
    assert [r["kept"] for r in got] == [3, 2, 2, 1, 1]
    assert all(r["monotone"] for r in got)


def test_shortest_paths(spark, small):
    one = graph.shortest_path_circuit(small, ids(spark, 10), ids(spark, 50), 4)
    assert sorted(r["node"] for r in one.collect()) == [10, 50]
    union = graph.population_path_union(small, ids(spark, 10, 20), ids(spark, 50), 2)
    assert sorted(r["node"] for r in union.collect()) == [10, 20, 40, 50]
    with pytest.raises(IntegrityError, match="no readout"):
        graph.shortest_path_circuit(small, ids(spark, 50), ids(spark, 10), 4)


def test_bounded_paths_hold_longer_ones(spark, small):
    assert {r["node"] for r in graph.bounded_path_circuit(small, ids(spark, 10), ids(spark, 50), 3).collect()} == {10, 20, 40, 50}


def test_completeness(spark):
    edges = spark.createDataFrame([(10, 20, 1), (10, 21, 40), (11, 20, 7), (20, 10, 5)], "src long, dst long, weight long")
    s = spark.createDataFrame([(10, "a"), (11, "a")], "node long, label string")
    t = spark.createDataFrame([(20, "a"), (21, "a")], "node long, label string")
    r = graph.pair_completeness(edges, s, t).first()
    assert (r["realised"], r["possible"], r["contacts"], r["reverse_pairs"], r["completeness"], r["orphans"]) == (3, 4, 48, 1, 0.75, 0)
    with pytest.raises(IntegrityError, match="duplicate"):
        graph.pair_completeness(edges.union(edges), s, t).count()


def test_sides_mirror(spark):
    edges = spark.createDataFrame([(1, 10, 40), (2, 10, 60), (3, 10, 10), (4, 10, 30)], "src long, dst long, weight long")
    side = spark.createDataFrame([(1, "L"), (2, "L"), (3, "R"), (4, "R")], "node long, side string")
    other = side.withColumn("side", F.when(F.col("side") == "L", "R").otherwise("L"))
    a, b = graph.sided_profile(edges, side).first(), graph.sided_profile(edges, other).first()
    assert (a["mean_l"], a["mean_r"]) == (50, 20)
    assert a["log2_ratio"] == pytest.approx(math.log2(2.5)) == pytest.approx(-b["log2_ratio"])


def test_signs(spark, rows):
    labels = spark.createDataFrame([(1, "acetylcholine"), (2, "gaba"), (3, "glutamate"), (4, None)], "node long, label string")
    assert [r["sign"] for r in graph.signs(labels).orderBy("node").collect()] == [1, -1, -1, 0]
    assert [r["sign"] for r in graph.signs(labels, "excitatory").orderBy("node").collect()] == [1, -1, -1, 1]
    with pytest.raises(IntegrityError, match="conflicting"):
        graph.signs(labels.union(spark.createDataFrame([(1, "gaba")], labels.schema)))


def test_populations(spark):
    notes = spark.createDataFrame([(10, "DNa01"), (11, None)], "body long, type string")
    registry = [{"id": "hit", "queries": [{"field": "type", "operator": "exact", "value": "DNa01"}], "min": 1, "max": 1}, {"id": "miss", "queries": [{"field": "type", "operator": "regex", "value": "^MN"}], "min": 1, "max": 2}]
    got = {r["population_id"]: r["status"] for r in populations.status(populations.resolve(notes, registry, "body"), registry, "body").collect()}
    assert got == {"hit": "resolved", "miss": "unresolved"}


def test_ladder_takes_the_first_rung_and_refuses_clashes(spark):
    notes = spark.createDataFrame([(1, "x")], "body long, type string")
    rung = lambda name, p: {"channel": name, "priority": p, "queries": [{"field": "type", "operator": "exact", "value": "x"}]}
    assert populations.ladder(notes, [rung("late", 50), rung("early", 20)], "body").first()["channel"] == "early"
    populations.require_no_clash(notes, [rung("late", 50), rung("early", 20)], "body")
    with pytest.raises(IntegrityError, match="share priority"):
        populations.require_no_clash(notes, [rung("a", 20), rung("b", 20)], "body")


def test_packed_key_bounds(spark):
    df = spark.createDataFrame([(1, 2, 3), (1 << 22, 0, 0), (0, 1 << 21, 0)], "z long, y long, x long")
    got = [r[0] for r in df.select(P.packed_key(F.col("z"), F.col("y"), F.col("x"))).collect()]
    assert got == [(1 << 42) | (2 << 21) | 3, None, None]


def test_ranks_and_rho(spark):
    from strandweave.operators.ordered import ranked

    df = spark.createDataFrame([(10,), (20,), (20,), (30,)], "v long")
    assert [r["rank"] for r in ranked(df, "v").orderBy("v").collect()] == [1, 2.5, 2.5, 4]
    xy = spark.createDataFrame(list(zip([1, 2, 3, 4, 5], [2, 1, 4, 3, 5])), "x long, y long")
    assert stats.spearman(xy, "x", "y").first()["rho"] == pytest.approx(0.8)
    assert stats.spearman(xy.withColumn("y", F.lit(1)), "x", "y").first()["rho"] is None


def test_tails():
    assert tails.sign_test(15, 3) == pytest.approx(0.007538, abs=1e-6)
    assert tails.sign_test(0, 0) == 1
    assert tails.t_quantile(9) == pytest.approx(2.262157, abs=1e-6)
    assert tails.chi_square_upper(11.0705, 5) == pytest.approx(0.05, abs=1e-5)
    assert tails.t_two_sided(0.0, 4) == pytest.approx(1.0)


def test_sign_test_is_calibrated():
    import random

    rnd = random.Random(5)
    rejected = 0
    for _ in range(400):
        k = sum(rnd.random() < 0.5 for _ in range(30))
        rejected += tails.sign_test(k, 30 - k) < 0.05
    assert rejected <= 32


def test_occupied_bins(spark):
    make = lambda pts: spark.createDataFrame([("g", *map(float, p)) for p in pts], "g string, x double, y double, z double")
    assert spatial.occupied(make([(1, 1, 1)] * 500), ["g"], 125.0, 1.0).first()["bins"] == 1
    assert spatial.occupied(make([(0, 0, 0), (125, 0, 0), (250, 0, 0)]), ["g"], 125.0, 1.0).first()["bins"] == 3
    assert spatial.occupied(make([(-1, 0, 0), (1, 0, 0)]), ["g"], 125.0, 1.0).first()["bins"] == 2
    assert spatial.occupied(make([]), ["g"], 125.0, 1.0).count() == 0


def test_nearest_ties_take_the_lowest_id(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0)], "point_id long, x double, y double")
    o = spark.createDataFrame([(7, "a", 0.5, 1.0, 0.0), (3, "b", 0.5, -1.0, 0.0)], "object_id long, kind string, radius double, x double, y double")
    r = spatial.nearest(p, o, ("x", "y")).first()
    assert (r["object_id"], r["gap"]) == (3, 0.5)


def spikes(spark, at):
    v = [-60.0] * 2000
    for a in at:
        for k, h in ((-1, 20.0), (0, 80.0), (1, 20.0)):
            v[a + k] = max(v[a + k], -60.0 + h)
    return spark.createDataFrame([(0, i, i * 100, x) for i, x in enumerate(v)], "key long, i long, t_us long, value double")


def test_spike_detection(spark):
    found = traces.peaks(spikes(spark, [100, 400, 700, 1500]), 30.0, 50, 20)
    assert [r["i"] for r in found.orderBy("i").collect()] == [100, 400, 700, 1500]
    assert [r["i"] for r in traces.peaks(spikes(spark, [100, 110]), 30.0, 50, 20).collect()] == [100]


def test_adaptation_needs_four_intervals(spark):
    few = spark.createDataFrame([(1, t) for t in (0, 10, 30, 60)], "key long, t_us long")
    r = traces.adaptation(few).first()
    assert (r["ratio"], r["first_interval"], r["last_interval"]) == (None, 10, 30)
    more = spark.createDataFrame([(1, t) for t in (0, 10, 20, 40, 70)], "key long, t_us long")
    assert traces.adaptation(more).first()["ratio"] == 3.0


def test_sustained_run(spark):
    t = spark.createDataFrame([(1, i, i * 10, v) for i, v in enumerate([1, 1, 0, 1, 1, 1])], "key long, i long, t_us long, value long")
    assert traces.longest_sustained(t, F.col("value") == 1).first()["sustained_us"] == 30


@pytest.mark.parametrize("width", [1, 2, 3, 7, 50])
def test_trailing_minimum_matches_naive(spark, width):
    import random

    rnd = random.Random(width)
    v = [rnd.random() for _ in range(40)]
    t = spark.createDataFrame([(1, i, x) for i, x in enumerate(v)], "key long, i long, value double")
    got = [r["m"] for r in t.select("i", traces.trailing_min(F.col("value"), width, True).alias("m")).orderBy("i").collect()]
    assert got == [min(v[max(0, i - width + 1) : i + 1]) for i in range(40)]


def test_digest_does_not_depend_on_layout(spark):
    df = spark.createDataFrame([(i, "pre" if i % 2 else None) for i in range(16)], "point_id long, kind string")
    assert integrity.same_content(df.repartition(3), df.orderBy(F.desc("point_id")).coalesce(1), ["point_id", "kind"])
    assert not integrity.same_content(df, df.withColumn("kind", F.coalesce("kind", F.lit("x"))), ["point_id", "kind"])


def test_gate_kinds(spark):
    legs = [("g", 1, "expect", 1.0, 1.0, False), ("g", 2, "at_least", 2.0, 2.0, False), ("g", 3, "below", 3.0, 3.0, True), ("h", 4, "below", 3.0, 3.0, False), ("h", 5, "expect", 1.0, None, True)]
    df = spark.createDataFrame(legs, "gate string, leg long, kind string, limit double, value double, retired boolean")
    assert {r["gate"]: (r["failed"], r["passed"]) for r in integrity.gates(df).collect()} == {"g": (0, True), "h": (1, False)}


def test_plasticity_closed_form_meets_recurrence(spark):
    r = spark.range(1).select(stats.train_resource(F.lit(0.4), F.lit(50.0), F.lit(200.0), 200).alias("r"), stats.train_steady_state(F.lit(0.4), F.lit(50.0), F.lit(200.0)).alias("s"), stats.paired_pulse_ratio(F.lit(0.4), F.lit(50.0), F.lit(200.0)).alias("p")).first()
    assert r["r"][-1] == pytest.approx(r["s"])
    assert r["r"][1] == pytest.approx(r["p"])


def test_controls_preserve_what_they_should(spark, small):
    for control in (graph.shuffled_targets(small), graph.permuted_weights(small)):
        assert all(r["preserved"] for r in graph.preservation(small, control).collect())
    assert {r["weight"] for r in graph.uniform_weights(small).collect()} == {2}


def test_consumed_units_are_refused(spark):
    with pytest.raises(IntegrityError, match="already used"):
        integrity.refuse_spent(ids(spark, 1, 2), ids(spark, 2), "node")
    integrity.refuse_spent(ids(spark, 1), ids(spark, 2), "node")
