"""Many seed sets at once against plain searches; hubs, odd rows, and what a layer moves."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from strandweave.operators import graph, reach


def plain(edges, seeds, limit):
    out, follow, nodes = {}, defaultdict(set), set()
    for a, b in edges:
        follow[a].add(b)
        nodes |= {a, b}
    for name in {s for s, _ in seeds}:
        seen = {n: 0 for s, n in seeds if s == name and n in nodes}
        queue = deque(seen)
        while queue:
            n = queue.popleft()
            for m in follow[n]:
                if seen[n] < limit and m not in seen:
                    seen[m] = seen[n] + 1
                    queue.append(m)
        out |= {(name, n): h for n, h in seen.items()}
    return out


@pytest.fixture(scope="module")
def drawn(spark):
    rnd = random.Random(8)
    pairs = {(rnd.randrange(400), rnd.randrange(400)) for _ in range(700)} | {(7, n) for n in range(0, 400, 2)} | {(-5, 3)}
    seeds = [(f"s{k}", rnd.randrange(420)) for k in range(150) for _ in range(rnd.randrange(1, 4))] + [("s1", 7), ("gone", 9999)]
    edges = spark.createDataFrame([(a, b, 1) for a, b in pairs] + [(1, 2, 5)], "src long, dst long, weight long")
    return sorted(pairs | {(1, 2)}), seeds, edges, spark.createDataFrame(seeds + [(None, 1), ("s2", None)], "set string, node long")


@pytest.mark.parametrize(("limit", "block"), [(0, 1024), (3, 1024), (8, 16)])
def test_sets_are_searched_together(drawn, monkeypatch, limit, block):
    monkeypatch.setattr(reach, "BLOCK", block)
    pairs, seeds, edges, sets = drawn
    assert {(r["set"], r["node"]): r["hop"] for r in reach.hops(edges, sets, limit).collect()} == plain(pairs, seeds, limit)
    back = reach.hops(edges, sets, limit, reverse=True).collect()
    assert {(r["set"], r["node"]): r["hop"] for r in back} == plain([(b, a) for a, b in pairs], seeds, limit)


def test_one_set_is_as_before(drawn):
    pairs, seeds, edges, sets = drawn
    got = {r["node"]: r["hop"] for r in graph.hops(edges, sets.where("set = 's1'").select("node"), 4).collect()}
    assert got == {n: h for (_, n), h in plain(pairs, [s for s in seeds if s[0] == "s1"], 4).items()}


def test_hubs_have_several_blocks(drawn, monkeypatch):
    monkeypatch.setattr(reach, "BLOCK", 16)
    pairs, _, edges, _ = drawn
    blocks = reach.adjacency(edges).df
    assert blocks.where("node = 7").count() > 5 and blocks.agg(F.max(F.size("steps"))).first()[0] < 60
    back = {(r["node"], r["to"]) for r in blocks.select("node", reach.neighbours().alias("to")).collect()}
    assert back == set(pairs)


def test_a_layer_does_not_move_the_edges(spark, drawn):
    """The blocks lie where they are; only the frontier is exchanged."""
    _, _, edges, sets = drawn
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        blocks = reach.adjacency(edges)
        plan = reach.spread(blocks.df, sets.select("node").distinct())._jdf.queryExecution().executedPlan().toString()
        # The one exchange is that of the frontier; the blocks are read in their buckets.
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan, plan
        blocks.drop()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_bounded_paths_of_all_sets(drawn):
    pairs, seeds, edges, sets = drawn
    forward, back = plain(pairs, seeds, 3), {n: h for (_, n), h in plain([(b, a) for a, b in pairs], [("r", 5), ("r", 11)], 3).items()}
    got = {(r["set"], r["node"]): (r["forward"], r["backward"]) for r in reach.bounded_paths(edges, sets, sets.sparkSession.createDataFrame([(5,), (11,)], "node long"), 3).collect()}
    assert got == {k: (h, back[k[1]]) for k, h in forward.items() if k[1] in back and h + back[k[1]] <= 3}


def test_identity_is_of_the_content(spark, drawn):
    _, _, edges, _ = drawn
    nodes = spark.range(50).withColumnRenamed("id", "node")
    one = graph.identity(edges, nodes).first()
    assert one == graph.identity(edges.repartition(5), nodes.union(nodes)).first() and one["nodes"] == 50
    assert one["digest"] != graph.identity(edges, nodes.where("node <> 3")).first()["digest"]
    assert one["digest"] != graph.identity(edges.withColumn("weight", F.when((F.col("src") == 1) & (F.col("dst") == 2), 9).otherwise(F.col("weight"))), nodes).first()["digest"]
    assert graph.identity(edges.limit(0), nodes.limit(0)).first()["nodes"] == 0


def test_empty_graphs(drawn):
    _, _, edges, sets = drawn
    assert reach.hops(edges.limit(0), sets, 3).count() == reach.hops(edges, sets.limit(0), 3).count() == 0
