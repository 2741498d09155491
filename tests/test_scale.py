"""Operators that must not gather a key or a table in one place, against brute force."""

import hashlib
import math
import random
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.operators import graph, integrity, ordered, spatial, traces


def test_quantiles_of_large_groups_and_nulls(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "a", "a", None]), rnd.choice([None, float(rnd.randint(0, 30)), rnd.random()])) for _ in range(3000)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r["q"] for r in ordered.quantiles(df, ["g"], "v", (0.0, 0.05, 0.5, 0.9, 1.0)).collect()}
    for g in ("a", None, "one"):
        own = [v for k, v in rows if k == g and v is not None]
        assert got[g] == pytest.approx(np.quantile(own, [0.0, 0.05, 0.5, 0.9, 1.0]).tolist())
    assert "none" not in got


def test_positions(spark):
    rows = [(i * 7919 % 500,) for i in range(500)] + [(3,), (3,)]
    out = ordered.positions(spark.createDataFrame(rows, "x long").repartition(7), ["x"]).collect()
    assert [r["x"] for r in sorted(out, key=lambda r: r["position"])] == sorted(x for x, in rows)
    assert sorted(r["position"] for r in out) == list(range(502))


def test_permutations_reach_over_the_whole_table(spark):
    rows = [(i // 10, i % 97, i % 5 + 1) for i in range(900)]
    edges = spark.createDataFrame(rows, "src long, dst long, weight long")
    key = lambda r: (hashlib.md5(f"{r[0]}:{r[1]}:shuffle".encode()).hexdigest(), r[0], r[1], r[1])
    want = sorted((s, d, w) for (s, _, w), (_, d, _) in zip(sorted(rows), sorted(rows, key=key)))
    assert sorted(map(tuple, graph.shuffled_targets(edges).collect())) == want
    report = {r["property"]: (r["preserved"], r["moved"]) for r in graph.preservation(edges, graph.shuffled_targets(edges)).collect()}
    assert all(p for p, _ in report.values()) and report["edge_count"][1] > 800
    same = graph.preservation(edges, edges).collect()
    assert all(r["preserved"] and r["moved"] == 0 for r in same)


def test_filters_and_peaks_along_long_keys(spark):
    rnd = random.Random(2)
    rows = [(k, i, None if k == 2 and i == 50 else rnd.uniform(0, 100)) for k, n in ((1, 30_000), (2, 100), (3, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "key long, i long, value double").repartition(6)
    got = {(r["key"], r["i"]): r["r"] for r in traces.exponential_filter(df, F.col("value"), 0.7, "r").collect()}
    for k in (1, 2, 3):
        r = 0.0
        for _, i, x in (row for row in rows if row[0] == k):
            r = r if x is None else r * 0.7 + x * (1 - 0.7)  # a null sample changes nothing
            assert got[k, i] == pytest.approx(r, rel=1e-12)
    found = sorted((r["key"], r["i"]) for r in traces.peaks(df.where("key <> 2"), 10.0, 5, 3).collect())
    want, last = [], None
    v = [x for k, _, x in rows if k == 1]
    for i in range(1, len(v) - 1):
        if v[i] >= v[i - 1] and v[i] > v[i + 1] and v[i] - min(v[max(0, i - 5) : i]) >= 10 and (last is None or i - last > 3):
            want.append((1, i))
            last = i
    assert found == want


def test_digest_levels(spark, monkeypatch):
    df = spark.range(3000).withColumn("v", F.col("id") % 7)
    one = integrity.logical_digest(df, ["id", "v"]).first()
    assert one == integrity.logical_digest(df.repartition(9).orderBy(F.desc("id")), ["id", "v"]).first()
    monkeypatch.setattr(integrity, "GROUP_ROWS", 1)
    deep = integrity.logical_digest(df, ["id", "v"]).first()
    assert deep["rows"] == 3000 and deep == integrity.logical_digest(df.repartition(5), ["id", "v"]).first()
    assert deep != integrity.logical_digest(df.unionByName(df.limit(1)), ["id", "v"]).first()


@pytest.mark.parametrize("axes", [("x", "y"), ("x", "y", "z")])
def test_nearest_by_growing_cells(spark, axes):
    rnd = random.Random(3)
    spot = lambda: [rnd.choice([rnd.gauss(0, 1), rnd.uniform(-50, 50)]) for _ in range(3)]
    objects = [(i, f"k{i % 3}", 0.5, *spot()) for i in range(300)] + [(900, "twin", 0.5, 1.0, 1.0, 1.0), (901, "twin", 0.5, 1.0, 1.0, 1.0), (902, "lost", 0.5, None, 1.0, 1.0)]
    points = [(i, *spot()) for i in range(200)] + [(500, 1.0, 1.0, 1.0), (501, 4000.0, -3000.0, 0.0), (502, None, 0.0, 0.0)]
    p = spark.createDataFrame(points, "point_id long, x double, y double, z double")
    o = spark.createDataFrame(objects, "object_id long, kind string, radius double, x double, y double, z double")
    got = {r["point_id"]: r for r in spatial.nearest(p, o, axes).collect()}
    n = len(axes)
    for i, *at in points:
        if at[0] is None:
            assert i not in got
            continue
        d, best = min((math.dist(at[:n], o[3 : 3 + n]), o[0]) for o in objects if o[3] is not None)
        assert (got[i]["object_id"], got[i]["distance"]) == (best, pytest.approx(d))
    assert spatial.nearest(p, o.limit(0), axes).count() == spatial.nearest(p.limit(0), o, axes).count() == 0


def scene(n, seed):
    """Objects in clusters, many in one place."""
    rng = np.random.default_rng(seed)
    at = rng.uniform(-1000, 1000, (12, 2))[rng.integers(0, 12, n)] + rng.normal(size=(n, 2)) * 30
    at[: n // 4] = at[0]
    return at, rng


@pytest.mark.parametrize("leaf", [256, 4])
def test_strongest_object_of_a_large_scene(spark, monkeypatch, leaf):
    monkeypatch.setattr(spatial, "LEAF", leaf)
    at, rng = scene(20_000 if leaf == 256 else 600, 1)
    alpha, gain = rng.uniform(0, 9, len(at)), rng.uniform(-0.2, 1, len(at))
    where = np.concatenate([rng.uniform(-1500, 1500, (60, 2)), at[-20:]])
    objects = spark.createDataFrame([(*map(float, p), float(a), float(g)) for p, a, g in zip(at, alpha, gain)] + [(None, 1.0, 1.0, 1.0), (0.0, 0.0, None, 1.0)], "ox double, oy double, alpha double, gain double")
    cells = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(where)], "cell long, x double, y double")
    got = {r["cell"]: r["rate"] for r in spatial.field_drive(cells, objects, 40.0, 5.0, 3.0, 5.0, 95.0).collect()}
    for i, p in enumerate(where):
        drive = np.exp(-((at - p) ** 2).sum(1) / (2 * (40.0 + alpha * 5.0) ** 2)) * (alpha / (alpha + 3.0)) * gain
        assert got[i] == pytest.approx(5.0 + min(max(drive.max(), 0.0), 1.0) * 95.0, rel=1e-12)
    assert spatial.field_drive(cells, objects.limit(0), 40.0, 5.0, 3.0, 5.0, 95.0).count() == 0
    assert {r["rate"] for r in spatial.field_drive(cells, objects.where("gain < 0"), 40.0, 5.0, 3.0, 5.0, 95.0).collect()} == {5.0}


def test_odour_of_a_large_scene_is_within_its_bound(spark):
    at, rng = scene(20_000, 2)
    strength = rng.uniform(-20, 200, len(at))
    where = np.concatenate([rng.uniform(-30_000, 30_000, (40, 2)), at[-20:]])
    sources = spark.createDataFrame([(*map(float, p), float(s)) for p, s in zip(at, strength)] + [(None, 1.0, 1.0)], "sx double, sy double, strength double")
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(where)], "point_id long, x double, y double")
    got = {r["point_id"]: r["odour"] for r in spatial.odour(points, sources, 25.0, 1e-3).collect()}
    for i, p in enumerate(where):
        term = 1 / (((at - p) ** 2).sum(1) + 25.0)
        c, most = (strength * term).sum(), (np.abs(strength) * term).sum()
        found = got[i] / (1 - got[i])
        assert abs(found - c) <= 1e-3 * most + 1e-9
    exact = spatial.odour(points, sources.limit(200), 25.0, 0.0)
    assert exact.count() == len(where) and spatial.odour(points, sources.limit(0), 25.0).count() == 0


def test_clearance_of_many_obstacles(spark):
    at, rng = scene(20_000, 3)
    path = rng.uniform(-1500, 1500, (40, 2))
    path[0] = at[0]
    obstacles = spark.createDataFrame([tuple(map(float, p)) for p in at] + [(None, 0.0)], "ox double, oy double")
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(path)], "point_id long, x double, y double")
    got = {r["candidate"]: r["clearance"] for r in spatial.clearest_direction(points, obstacles, 5).collect()}
    for k in range(5):
        t = k * 2 * math.pi / 5
        project = lambda p: p[:, 0] * math.sin(t) - p[:, 1] * math.cos(t)  # noqa: B023, E731
        least = np.abs(project(at)[:, None] - project(path)[None, :]).min(0)
        assert got[k] == pytest.approx(float(np.median(least)), abs=1e-9)
    assert spatial.clearest_direction(points, obstacles.limit(0), 5).count() == 0


def test_draws_are_those_of_a_full_ranking(spark):
    bins = [(i, i % 3) for i in range(900)]
    sources = [i for i in range(0, 900, 31)] + [0, 3, 6]
    out = {(r["draw"], r["node"]) for r in graph.matched_draws(spark.createDataFrame(bins, "node long, bin int"), spark.createDataFrame([(i,) for i in sources], "node long"), 4).collect()}
    want = set()
    for draw in range(1, 5):
        for b in range(3):
            k = len({i for i in sources if i % 3 == b})
            own = sorted((i for i, x in bins if x == b), key=lambda i: (hashlib.md5(f"{draw}:{i}:null".encode()).hexdigest(), i))
            want |= {(draw, i) for i in own[:k]}
    assert out == want


def test_skip_draws_are_exact_and_uniform(spark, monkeypatch):
    monkeypatch.setattr(graph, "SKIP_BLOCK", 7)
    bins = [(i, i % 3) for i in range(90)] + [(5, None), (None, 1)]
    sources = list(range(0, 30, 2))
    frame = spark.createDataFrame(bins, "node long, bin int")
    out = graph.skip_draws(frame, spark.createDataFrame([(i,) for i in sources], "node long"), 400, 3).collect()
    per = Counter((r["draw"], r["bin"]) for r in out)
    assert per == {(d, b): sum(i % 3 == b for i in sources) for d in range(1, 401) for b in range(3)}
    assert len({(r["draw"], r["node"]) for r in out}) == len(out) and all(r["node"] % 3 == r["bin"] for r in out)
    # 5 of 30 in each draw: a node is in 66.7 of 400 draws, with a deviation of 7.5.
    times = Counter(r["node"] for r in out)
    assert len(times) == 90 and abs(statistics.mean(times.values()) - 400 * 5 / 30) < 1e-9 and 5 < statistics.pstdev(times.values()) < 10
    # Pairs too, within a block and across blocks.
    together = Counter((min(a, b), max(a, b)) for d in range(1, 401) for a in [r["node"] for r in out if r["draw"] == d and r["bin"] == 0] for b in (0, 3, 60) if b in [r["node"] for r in out if r["draw"] == d and r["bin"] == 0] and a != b)
    assert 2 < statistics.mean(together.values()) < 16
    again = graph.skip_draws(frame.repartition(5), spark.createDataFrame([(i,) for i in sources], "node long"), 3, 3).collect()
    assert {(r["draw"], r["node"]) for r in again} == {(r["draw"], r["node"]) for r in out if r["draw"] <= 3}
    assert graph.skip_draws(frame.limit(0), frame.select("node"), 3).count() == 0


def test_rollup_of_a_label_with_many_targets(spark):
    profile = spark.range(50_000).select(F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.lit("x")).alias("label"), F.col("id").alias("sources"), (F.col("id") % 1001).cast("double").alias("median"), F.lit(2).alias("total"))
    got = {r["label"]: r for r in graph.rollup(profile).collect()}
    for label, ids in (("x", [i for i in range(50_000) if i % 5]), (None, list(range(0, 50_000, 5)))):
        assert (got[label]["targets"], got[label]["median_of_medians"]) == (len(ids), statistics.median(i % 1001 for i in ids))


def test_trial_rates_count_empty_trials(spark):
    trials = spark.createDataFrame([(t,) for t in range(4)], "trial int")
    ids = spark.createDataFrame([("a",), ("b",)], "key string")
    events = spark.createDataFrame([("a", 0), ("a", 0), ("a", 2), ("a", 9)], "key string, trial int")
    got = {r["key"]: (r["mean_rate"], r["sd_rate"]) for r in traces.trial_rates(trials, ids, events, 2.0).collect()}
    x = [1.0, 0.0, 0.5, 0.0]
    assert got["a"] == pytest.approx((statistics.mean(x), statistics.pstdev(x))) and got["b"] == (0.0, 0.0)
