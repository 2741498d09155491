"""Sensory channels, command order, declared populations and registries on small tables."""

import pytest
from pyspark.sql import functions as F

from strandweave.errors import CausalityError, IntegrityError
from strandweave.operators import graph, populations, sensing, sweeps

BOUND = "channel string, sensor string, delay_us long, threshold double, half double, most double, gain double, enabled boolean"


def bound(spark, *rows):
    return spark.createDataFrame([(c, s, d, 0.0, 1.0, 10.0, 1.0, on) for c, s, d, on in rows], BOUND)


def test_what_arrives_late_counts_at_the_next_frame(spark):
    """Frames at 0, 10, 40, 50: of what is shown at 0 and 10 and due at 20 and 30, the later counts at 40."""
    samples = spark.createDataFrame([("a", t, float(t + 1)) for t in (0, 10, 40, 50)], "sensor string, t_us long, value double")
    out = {(r["channel"], r["t_us"]): r["quantity"] for r in sensing.channel_frames(samples, bound(spark, ("now", "a", 0, True), ("late", "a", 20, True), ("never", "a", 100, True), ("none", "b", 0, True))).collect()}
    assert [out["now", t] for t in (0, 10, 40, 50)] == [1.0, 11.0, 41.0, 51.0]
    assert [out["late", t] for t in (0, 10, 40, 50)] == [0.0, 0.0, 11.0, 0.0]
    assert all(out[c, t] == 0.0 for c in ("never", "none") for t in (0, 10, 40, 50))


def test_bindings_that_no_bus_can_serve_are_refused(spark):
    members = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1)], "channel string, node long")
    sensing.check_bindings(bound(spark, ("a", "s", 0, True), ("b", "s", 30, True)), members, 10)
    for rows in ([("a", "s", 0, True), ("a", "t", 0, True)], [("a", "s", 15, True)], [("a", "s", -10, True)], [("x", "s", 0, True)], [("a", "s", 0, True), ("c", "s", 0, True)]):
        with pytest.raises(IntegrityError):
            sensing.check_bindings(bound(spark, *rows), members, 10)
    with pytest.raises(IntegrityError):
        sensing.check_bindings(bound(spark, ("b", "s", 0, True)), members, 10, spark.createDataFrame([(1,)], "node long"))


def test_disabled_channels_are_silent_and_other_encoders_may_not_clash(spark):
    samples = spark.createDataFrame([("s", 0, 1.0), ("s", 10, 3.0)], "sensor string, t_us long, value double")
    members = spark.createDataFrame([("a", 1), ("b", 2)], "channel string, node long")
    extra = spark.createDataFrame([(0, 2, 7.0), (10, 3, 0.0)], "t_us long, node long, rate double")
    driven, lists = sensing.bus_frames(samples, bound(spark, ("a", "s", 0, True), ("b", "s", 0, False)), members, 10, extra)
    assert sorted(map(tuple, driven.collect())) == [(0, 1, 5.0), (0, 2, 7.0), (10, 1, 7.5)]
    assert {r["t_us"]: (r["active"], r["silent"]) for r in lists.collect()} == {t: (["a"], ["b"]) for t in (0, 10)}
    with pytest.raises(IntegrityError):
        sensing.bus_frames(samples, bound(spark, ("a", "s", 0, True)), members, 10, spark.createDataFrame([(0, 1, 7.0)], "t_us long, node long, rate double"))


def test_commands_act_in_the_next_interval(spark):
    steps = spark.createDataFrame([(1, t, t, f"c{t}") for t in (20, 0, 10)], "key long, t_us long, body_us long, command string")
    assert {r["t_us"]: r["applied"] for r in sensing.scheduled(steps, 10, F.lit("rest")).collect()} == {0: "rest", 10: "c0", 20: "c10"}
    for bad in ([(1, 0, 0, "x"), (1, 20, 20, "y")], [(1, 0, 1, "x")], [(1, 5, 5, "x")]):
        with pytest.raises(CausalityError):
            sensing.scheduled(spark.createDataFrame(bad, steps.schema), 10, F.lit("rest"))


def test_runs_and_acceptance(spark):
    trace = spark.createDataFrame([(1, 0, 0, "a", 0), (1, 1, 10, "b", 11), (1, 2, 10, "c", None)], "key long, seq long, t_us long, state string, body long")
    claims = spark.createDataFrame([(1, 0, 0, "a"), (1, 1, 5, "b"), (1, 2, 10, "x")], "key long, seq long, t_us long, state string")
    faults = {r["fault"]: r["n"] for r in sensing.run_faults(trace, claims, ["a", "x"], ["body"]).collect()}
    assert faults == {"order": 1, "clock": 2, "unrecorded": 1, "state": 1}
    assert sensing.run_faults(trace, claims, ["x", "a"], []).where("fault = 'sequence'").count() == 1
    rows = sensing.accepted(trace, "key", {"many": F.count("*") > 2, "unknown": F.max("body") > F.lit(None)}).collect()
    assert {(r["criterion"], r["passed"], r["accepted"]) for r in rows} == {("many", True, False), ("unknown", False, False)}


def test_declared_populations_are_refused_when_empty_or_shared(spark):
    rows = spark.createDataFrame([(1, "a", "L"), (2, "a", "R"), (3, "a", None), (4, "b", "L")], "id long, type string, side string")
    spec = lambda role, name, where, side=None: {"role": role, "name": name, "where": F.expr(where), "side_column": "side", "side": side}
    out = populations.declared(rows, [spec("entry", "left", "type = 'a'", "L"), spec("readout", "all_b", "type = 'b'")], "id")
    assert {(r["name"], r["id"], r["unknown_side"]) for r in out.collect()} == {("left", 1, False), ("left", 3, True), ("all_b", 4, False)}
    with pytest.raises(IntegrityError):
        populations.declared(rows, [spec("entry", "none", "type = 'z'")], "id")
    with pytest.raises(IntegrityError):
        populations.declared(rows, [spec("entry", "e", "type = 'a'"), spec("readout", "r", "id = 1")], "id")


def test_unions_records_and_weights_refuse_what_is_wrong(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "node long"), spark.createDataFrame([(3,)], "node long")
    assert populations.entry_union(a, b).count() == 3
    with pytest.raises(IntegrityError):
        populations.entry_union(a, a)
    with pytest.raises(IntegrityError):
        populations.with_records(spark.createDataFrame([(1, "t")], "node long, type string"), spark.createDataFrame([("t", 1), ("t", 2)], "type string, v long"), {"v": 0})
    sign = spark.createDataFrame([(1, -1)], "node long, sign int")
    edges = spark.createDataFrame([(1, 2, 3, 2.0), (5, 2, 3, 1.0)], "src long, dst long, weight long, m double")
    assert sorted(r["value"] for r in graph.functional_weights(edges, sign, 0.5, "m").collect()) == [-3.0, 0.0]
    for bad in (-1.0, float("nan"), float("inf"), None):
        with pytest.raises(IntegrityError):
            graph.functional_weights(spark.createDataFrame([(1, 2, 3, bad)], edges.schema), sign, 0.5, "m")


def test_charging_verdicts(spark):
    import math

    curves = {
        "ok": [-60 + 10 * (1 - math.exp(-i / 20)) for i in range(200)], "span": [-60 + 0.1 * (i > 5) for i in range(200)], "few": [-60 + 10 * (i > 1) for i in range(200)],
        "poor": [-60 + (3 + (i * 37 % 5) if i < 100 else 10) for i in range(200)], "rising": [-60 + (8 - 0.05 * i if i < 100 else 10) for i in range(200)],
    }
    rows = [(k, i, float(v)) for k, c in curves.items() for i, v in enumerate(c)]
    df = spark.createDataFrame(rows, "sweep string, i long, voltage double")
    rest = F.when(F.col("sweep") == "span", -59.9).otherwise(-50.0)
    got = {r["sweep"]: r for r in sweeps.charging(df, F.lit(-60.0), rest, 0.5, 0.1, 0.9, 0.9, 1.0, 1.0).collect()}
    assert {k: r["verdict"] for k, r in got.items()} == {k: k for k in curves}
    assert got["ok"]["tau_ms"] == pytest.approx(20, rel=1e-3) and got["poor"]["tau_ms"] is None
    long = sweeps.charging(df.where("sweep = 'ok' and i < 20"), F.lit(-60.0), F.lit(-50.0), 0.5, 0.1, 0.9, 0.9, 0.5, 1.0).first()
    assert long["verdict"] == "long"
