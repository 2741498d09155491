"""State along a key over many partitions against plain passes."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandweave.operators import scan, traces


@pytest.fixture(scope="module")
def samples(spark):
    """One long key, many short ones, a null key, null samples; over as many partitions as there are."""
    rnd = random.Random(4)
    rows = [(k, i, 1000 * i + rnd.randint(0, 900), None if rnd.random() < 0.02 else rnd.uniform(0, 100)) for k, n in ((1, 20_000), (None, 700), *((k, 5) for k in range(2, 40))) for i in range(n)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield rows, spark.createDataFrame(rows, "key long, i long, t_us long, value double").repartition(7)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_one_key_is_spread_over_tasks(samples):
    _, df = samples
    out = traces.exponential_filter(df.where("key = 1"), F.col("value"), 0.9, "r")
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 4 and max(sizes) < 10_000


def test_filter(samples):
    rows, df = samples
    got = {(r["key"], r["i"]): r["r"] for r in traces.exponential_filter(df, F.col("value"), 0.9, "r").collect()}
    for key, own in by_key(rows).items():
        r = 0.0
        for _, i, _, x in own:
            r = r if x is None else r * 0.9 + x * (1 - 0.9)
            assert got[key, i] == pytest.approx(r, rel=1e-11)


@pytest.mark.parametrize(("prominence", "width", "refractory"), [(10.0, 5, 3), (0.5, 1, 0), (60.0, 30, 5000)])
def test_peaks(samples, monkeypatch, prominence, width, refractory):
    monkeypatch.setattr(traces, "BLOCK", 501)
    rows, df = samples
    want = []
    for key, own in by_key(rows).items():
        v, last = [x for *_, x in own], None
        for i in range(1, len(v) - 1):
            low = min((x for x in v[max(0, i - width) : i] if x is not None), default=None)
            if None in (v[i - 1], v[i], v[i + 1], low) or v[i] < v[i - 1] or v[i] <= v[i + 1] or v[i] - low < prominence:
                continue
            if last is None or i - last > refractory:
                want.append((key, i))
                last = i
    assert sorted(((r["key"], r["i"]) for r in traces.peaks(df, prominence, width, refractory).collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("floor", [20.0, 2.0, -1.0, 200.0])
def test_longest_sustained(samples, floor):
    rows, df = samples
    got = {r["key"]: r["sustained_us"] for r in traces.longest_sustained(df, F.col("value") >= floor).collect()}
    for key, own in by_key(rows).items():
        run = best = 0
        for k, (_, _, t, x) in enumerate(own):
            run = run + (t - own[k - 1][2] if k else 0) if x is not None and x >= floor else 0
            best = max(best, run)
        assert got[key] == best


def test_unwrap(samples):
    rows, df = samples
    got = {(r["key"], r["i"]): r["u"] for r in traces.unwrap(df, "value", "u").collect()}
    for key, own in by_key(rows).items():
        last = total = None
        for _, i, _, x in own:
            if x is None:
                assert got[key, i] is None
                continue
            d = 0.0 if last is None else x - last
            total, last = x if last is None else total + d - 2 * math.pi * math.floor((d + math.pi) / (2 * math.pi)), x
            assert got[key, i] == pytest.approx(total, abs=1e-6)


def test_time_means(samples):
    rows, df = samples
    got = {(r["key"], r["i"]): r["m"] for r in traces.time_means(df, F.col("value"), 5000, "m").collect()}
    assert len(got) == len(rows)
    for key, own in by_key(rows).items():
        for k in range(0, len(own), 37):
            near = [x for _, _, t, x in own[max(0, k - 20) : k + 20] if own[k][2] - 5000 <= t <= own[k][2] and x is not None]
            assert got[key, own[k][1]] == (pytest.approx(sum(near) / len(near)) if near else None)


def test_empty_tables(spark, samples):
    _, df = samples
    none = df.limit(0)
    assert traces.peaks(none, 1.0, 2, 3).collect() == traces.exponential_filter(none, F.col("value"), 0.5, "r").collect() == []
    assert traces.longest_sustained(none, F.col("value") > 0).collect() == traces.unwrap(none, "value", "u").collect() == []


@pytest.mark.parametrize("kind", ["refractory", "sustained", "affine"])
def test_maps_compose(kind):
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(2, 60))
        rows = {"i": pa.array(np.sort(rng.choice(200, n, replace=False))), "t_us": pa.array(np.cumsum(rng.integers(1, 9, n))), "ok": pa.array(rng.random(n) < 0.7), "x": pa.array(rng.normal(size=n))}
        own = {"refractory": scan.Refractory(int(rng.integers(0, 50))), "sustained": scan.Sustained(), "affine": scan.Affine(0.8, "i", "r")}[kind]
        cut = sorted({0, n, *rng.integers(0, n, 3).tolist()})
        step, state = None, own.start
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            mine = own.map_of({k: v[a:b] for k, v in rows.items()})
            step, state = mine if step is None else own.compose(step, mine), own.after(state, mine)
        whole = own.after(own.start, own.map_of(rows))
        assert own.after(own.start, step) == pytest.approx(whole, rel=1e-12) and state == pytest.approx(whole, rel=1e-12)
