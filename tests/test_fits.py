import numpy as np
import pytest

from strandweave.operators import fits, plasticity


def test_family_recovers_its_parameters(spark):
    truth = np.array([0.4, 150.0])
    data = [(g, i + 1, float(v), 0.01) for g in (20.0, 60.0, 200.0) for i, v in enumerate(plasticity.train("depression", truth, g, 6))]
    loss, p, edge = fits.fit_family("depression", data, 1, starts=4)
    assert loss < 1e-4 and not edge
    assert p == pytest.approx(truth, rel=1e-2)


def test_truncated_nb_recovers_the_mean(spark):
    rng = np.random.default_rng(2)
    v = rng.negative_binomial(2.0, 2.0 / 14.0, 20000)
    k, n = np.unique(v[v > 0], return_counts=True)
    h = spark.createDataFrame([("a", int(x), int(c)) for x, c in zip(k, n)], "label string, value long, n long")
    r = fits.truncated_nb(h, ["label"]).first()
    assert r["mean"] == pytest.approx(12.0, rel=0.05)
    assert not r["boundary"]


def test_kernel_grid(spark):
    t = np.arange(0, 60.0)
    rows = [("g", c, float(x), float((c + 1) * y)) for c in range(3) for x, y in zip(t, fits.kernel(t, 2.0, 12.0))]
    df = spark.createDataFrame(rows, "g string, curve long, t double, y double")
    r = fits.kernel_grid_fit(df, "g", [1.0, 2.0, 4.0], [6.0, 12.0, 24.0]).first()
    assert (r["rise"], r["decay"]) == (2.0, 12.0)


THETA = {
    "depression": (0.4, 150.0), "facilitation_depression": (0.2, 0.3, 60.0, 400.0), "tied_facilitation": (0.3, 60.0, 400.0), "parallel_pools": (0.8, 50.0, 0.4, 300.0),
    "published_depression": (0.15, 80.0), "two_time_facilitation": (1.5, 0.4, 120.0, 0.3), "two_time_facilitation_free": (1.5, 12.0, 0.4, 120.0, 0.3),
}


def test_families_by_hand():
    e = lambda gap, tau: np.exp(-gap / tau)
    gap = 25.0
    two = {f: plasticity.responses(f, t, [0.0, gap]) for f, t in THETA.items()}
    assert two["depression"] == pytest.approx([1.0, 1 - 0.4 * e(gap, 150)])
    u1 = 0.2 + 0.3 * 0.8
    u2 = 0.2 + (u1 - 0.2) * e(gap, 60)
    u2 += 0.3 * (1 - u2)
    assert two["facilitation_depression"] == pytest.approx([u1, u2 * (1 - u1 * e(gap, 400))])
    assert plasticity.responses("tied_facilitation", (0.3, 60.0, 400.0), [0, 9, 30]) == pytest.approx(plasticity.responses("facilitation_depression", (0.3, 0.3, 60.0, 400.0), [0, 9, 30]))
    assert two["parallel_pools"] == pytest.approx([1.0, 0.5 * (1 + 0.8 * e(gap, 50)) + 0.5 * (1 - 0.4 * e(gap, 300))])
    assert plasticity.terms("published_depression", (0.15, 80.0)).first_use() == pytest.approx(0.22)
    assert two["two_time_facilitation"] == pytest.approx([1.0, (1 + 1.5 * e(gap, 5) + 0.4 * e(gap, 120)) * (1 - 0.3 * e(gap, 20000))])
    assert plasticity.responses("two_time_facilitation_free", (1.5, 5.0, 0.4, 120.0, 0.3), [0, 9, 30]) == pytest.approx(plasticity.responses("two_time_facilitation", (1.5, 0.4, 120.0, 0.3), [0, 9, 30]))
    with pytest.raises(ValueError):
        plasticity.responses("depression", (0.4,), [0.0])
    with pytest.raises(ValueError):
        plasticity.responses("depression", (0.4, 150.0), [0.0, -1.0])


def test_pairs_and_their_ceilings(spark):
    assert plasticity.paired_pulse("depression", (0.4, 150.0), 30.0, 1) == pytest.approx(1 - 0.4 * np.exp(-30 / 150))
    assert plasticity.paired_pulse("published_depression", (0.0, 50.0), 50.0) == pytest.approx(1 - 0.22 * np.exp(-50 / 893), abs=2e-3)
    r = spark.range(1).select(plasticity.pair_ceiling(0.79, 10.0, 893.0).alias("c"), plasticity.mixed_pair(0.5, 0.04, 10.0, 893.0).alias("m"), plasticity.largest_probability(1.51, 10.0, 893.0).alias("p")).first()
    k = np.exp(-10 / 893)
    assert (r["c"], r["m"], r["p"]) == pytest.approx(((1 - 0.79 * k) / 0.79, 1 - k * (0.25 + 0.04) / 0.5, 1 / (1.51 + k)))
    most = max(plasticity.paired_pulse("tied_facilitation", (u, t, 500.0), 1.0, 1) for u in (0.001, 0.01, 0.1) for t in (10.0, 1000.0))
    assert 1.45 < most <= 1.5


@pytest.mark.parametrize("family", list(THETA))
def test_joint_fit_recovers_what_made_the_data(family):
    truth = THETA[family]
    shape = [(g, k, 0.0, 0.01) for g in (20.0, 80.0) for k in range(2, 7)] + [(g, 0, 0.0, 0.01) for g in (10.0, 30.0, 100.0, 300.0)]
    data = [(g, k, float(v), e) for (g, k, _, e), v in zip(shape, fits.predicted(family, truth, shape))]
    loss, p, _ = fits.fit_family(family, data, 3, starts=24)
    assert loss < 0.5
    assert fits.predicted(family, p, data) == pytest.approx([d[2] for d in data], abs=0.01)


def test_a_rival_of_another_kind_loses(spark):
    shape = [(g, k, 0.0, 0.02) for g in (20.0, 80.0) for k in (2, 4)] + [(10.0, 0, 0.0, 0.02)]
    observed = spark.createDataFrame([("s", *o) for o in shape], "specimen string, gap double, pulse int, mean double, error double")
    r = fits.discrimination(observed, "two_time_facilitation", list(THETA["two_time_facilitation"]), "depression", replicates=3, starts=2).first()
    assert r["specimen"] == "s" and r["wins"] == 1.0 and r["high_margin"] >= r["median_margin"] > 10


def test_specimens_are_fitted_apart(spark):
    """Responses made by two settings of a family, each found again; what cannot be an observation is left out."""
    truth = {"a": (0.4, 150.0), "b": (0.15, 400.0)}
    rows = [(s, g, i + 1, 7.0 * float(v) * (1 + d)) for s, t in truth.items() for g in (20.0, 60.0) for i, v in enumerate(plasticity.train("depression", t, g, 6)) for d in (-0.001, 0.001)]
    rows += [("a", 99.0, 2, 1.0), ("a", 20.0, 9, 1.0), (None, 20.0, 2, 1.0)]
    observed = fits.observations(spark.createDataFrame(rows, "specimen string, gap double, pulse int, response double"))
    assert observed.count() == 20 and {r["error"] for r in observed.collect()} >= {1e-3}
    got = {r["specimen"]: r for r in fits.fit_families(observed, ["depression"], 2).collect()}
    for s, t in truth.items():
        assert got[s]["parameters"] == pytest.approx(t, rel=0.02) and got[s]["gof_p"] > 0.9
    left = fits.leave_one_out(observed, ["depression"]).collect()
    assert sorted((r["specimen"], r["left_out"]) for r in left) == [(s, k) for s in "ab" for k in range(10)] and max(abs(r["residual"]) for r in left) < 1
    band = fits.bootstrap_band(observed, "depression", 40.0, 3, 8).collect()
    assert len(band) == 6 and all(r["low"] <= r["middle"] <= r["high"] for r in band)
    assert all(r["worst_relative_error"] < 0.1 for r in fits.recovery(observed, "depression", [0.4, 150.0], 2).collect())
    assert fits.fit_families(observed.limit(0), ["depression"], 1).count() == 0


def test_synapses_are_carried_along_keys(spark):
    rng = np.random.default_rng(5)
    rows = [(k, i, float(g)) for k in range(4) for i, g in enumerate(rng.uniform(1, 90, 30))] + [(9, 0, None)]
    out = plasticity.respond(spark.createDataFrame(rows, "key long, i long, gap double"), THETA).collect()
    assert len(out) == len(rows)
    for k in range(4):
        own = sorted((r for r in out if r["key"] == k), key=lambda r: r["i"])
        for f, theta in THETA.items():
            want = plasticity.responses(f, theta, [r["gap"] for r in own])
            assert [r[f] for r in own] == pytest.approx(want / want[0])


def test_small_network_chain(spark):
    edges = spark.createDataFrame([(0, 1, 2, 5.0), (0, 2, 3, 5.0)], "c int, src long, dst long, weight double")
    out = fits.small_network(edges, "c", {1: [0]}, 10, 0.9, 4.0, 2, 1)
    assert sorted((r["step"], r["node"]) for r in out.collect()) == [(0, 1), (2, 2), (4, 3)]


def test_two_decays_are_found(spark):
    t = np.arange(0.0, 100.0)
    rows = [("g", c, float(x), float((c + 1) * y)) for c in range(3) for x, y in zip(t, fits.two_decay_kernel(t, 12.0, 1.5, 8.0, 40.0, 0.7))]
    df = spark.createDataFrame(rows, "g string, curve long, t double, y double")
    r = fits.two_decay_fit(df, "g", [10.0, 12.0, 14.0], [1.0, 1.5], [5.0, 8.0], [20.0, 40.0], [0.5, 0.7]).first()
    assert (r["onset"], r["rise"], r["fast"], r["slow"], r["share"]) == (12.0, 1.5, 8.0, 40.0, 0.7)
    assert r["amplitude"] == pytest.approx(2.0) and r["loss"] < 1e-12 and 3 < r["half_decay"] < 15
    assert fits.two_decay_fit(df, "g", [10.0], [9.0], [5.0], [4.0], [0.5]).count() == 0
    assert fits.huber_mean(np.array([0.5, -3.0]), 1.0) == pytest.approx((0.125 + 2.5) / 2)


def test_small_network_depresses(spark):
    edges = spark.createDataFrame([(0, 1, 2, 5.0)], "c int, src long, dst long, weight double")
    fired = lambda **k: sorted((r["step"], r["node"]) for r in fits.small_network(edges, "c", {1: [0, 1, 2]}, 8, 0.0, 4.0, 2, 0, **k).collect() if r["node"] == 2)
    assert fired() == [(2, 2), (3, 2), (4, 2)]
    assert fired(use=0.5) == [(2, 2)]
    assert fired(use=0.5, recovery=0.1) == [(2, 2), (3, 2), (4, 2)]
