"""Queries that read whole tables, against brute force."""

import math
import statistics
from collections import Counter

import pytest

from strandweave.plans import catalog


@pytest.fixture
def run(spark, tmp_path):
    def make(name, **tables):
        for k, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{k}.parquet")
        return catalog.queries()[name](spark, str(tmp_path)).collect()

    return make


def test_gate_legs_all_reads_every_order(run):
    lines = [(k, n, float(k % 60), 0.08 if k % 5 == 0 else 0.01) for k in range(1, 200) for n in (1, 2, 3)]
    got = {r["gate"]: (r["legs"], r["failed"]) for r in run("gate_legs", lineitem=(lines, "l_orderkey long, l_linenumber int, l_quantity double, l_tax double"))}
    failed = sum(q >= 50 and t <= 0.07 for _, n, q, t in lines if n == 2)
    assert failed and got == {"g1": (199, 0), "g2": (199, failed), "g3": (199, 0)}


def test_consumed_guard_all_asks_for_every_customer(run):
    got = run("consumed_guard", customer=([(i,) for i in range(1, 8)], "c_custkey long"), orders=([(1, "P"), (2, "F"), (5, "P"), (6, "P")], "o_custkey long, o_orderstatus string"))
    assert sorted(r["key"] for r in got) == [1, 5, 6]


def test_clearance_by_label_uses_every_point(run):
    rows = [(i, i % 3, [((i * 37) % 101) / 100, ((i * 53) % 89) / 100, 0.0]) for i in range(40)]
    got = {r["candidate"]: r["clearance"] for r in run("clearance_search", embeddings=(rows, "vec_id long, label int, embedding array<double>"))}
    p = [(label, math.floor(e[0] * 1000), math.floor(e[1] * 1000)) for _, label, e in rows]
    for k in range(12):
        t = k * 2 * math.pi / 12
        least = [min(abs((ox - x) * math.sin(t) - (oy - y) * math.cos(t)) for o, ox, oy in p if o % 2) for label, x, y in p if label % 2 == 0]
        assert got[k] == pytest.approx(statistics.median(least), abs=2e-6)


def test_frame_contract_all_checks_every_user(run):
    """Event 400 and later count: users 22 and 26 have no earlier one."""
    events = [(i, u, f"2024-01-01 00:00:{i % 60:02d}", "click", 1.0) for i, u in [(1, 1), (400, 22), (401, 26), (402, 27), (403, 27)]]
    got = Counter(r["fault"] for r in run("frame_contract", events=(events, "event_id long, user_id long, ts string, event_type string, value double")))
    assert got == {"length": 1, "units": 1, "repeated": 1}


def test_leave_one_out_takes_all_observations(run):
    lines = [(f"{'AN'[i % 2]}", i % 6, 1 + i % 5, float(20 + (i * 7) % 13)) for i in range(600)]
    schema = "l_returnflag string, l_suppkey long, l_linenumber int, l_quantity double"
    observed = run("train_observations", lineitem=(lines, schema))
    out = run("family_leave_one_out", lineitem=(lines, schema))
    for flag in "AN":
        assert sorted(r["left_out"] for r in out if r["specimen"] == flag) == list(range(sum(r["specimen"] == flag for r in observed)))



def _walk(edges, seeds, limit):
    hop, layer = {n: 0 for n in seeds}, set(seeds)
    for k in range(1, limit + 1):
        layer = {b for a, b in edges if a in layer} - set(hop)
        hop |= {n: k for n in layer}
    return hop


def test_paths_over_single_contacts(run):
    """A chain of single contacts: click 1 -> 2 -> 3 -> view 4, and a spur 1 -> 5 that reaches no view."""
    kind = {1: "click", 2: "error", 3: "signup", 4: "view", 5: "error"}
    order = [1, 2, 3, 4, 1, 5]
    rows = [(i, u, f"2024-01-01 00:00:{i:02d}", kind[u], 1.0) for i, u in enumerate(order)]
    events = (rows, "event_id long, user_id long, ts string, event_type string, value double")
    edges = set(zip(order, order[1:]))
    forward, backward = _walk(edges, {1}, 4), _walk({(b, a) for a, b in edges}, {4}, 4)
    assert {r["node"]: r["hop"] for r in run("hop_distance", events=events)} == forward
    assert {r["node"] for r in run("bounded_path")} == {n for n in forward if n in backward and forward[n] + backward[n] <= 4} == {1, 2, 3, 4}
    assert {r["node"]: r["hop"] for r in run("shortest_path_circuit")} == {1: 0, 2: 1, 3: 2, 4: 3}
    assert {r["node"] for r in run("population_path_union")} == {1, 2, 3, 4}
    assert {r["node"]: r["status"] for r in run("endpoint_status")} == {1: "pathless", 2: "kept", 3: "pathless", 4: "pathless", 5: "kept"}


def test_control_takes_whole_sets(spark, run, monkeypatch):
    from strandweave.operators import graph

    seen = []
    real = graph.bounded_path_circuit
    monkeypatch.setattr(graph, "bounded_path_circuit", lambda e, a, b, k: seen.append((a.count(), b.count())) or real(e, a, b, k))
    rows = [(i, i % 6, f"2024-01-01 00:00:{i:02d}", "click" if i % 6 < 3 else "view", 1.0) for i in range(30)]
    got = run("bounded_equals_shortest_k1", events=(rows, "event_id long, user_id long, ts string, event_type string, value double"))
    # The one edge from a click to a view is that from 2 to 3.
    assert [tuple(r) for r in got] == [(0, 0, 2, 2)] and seen == [(3, 3)]
