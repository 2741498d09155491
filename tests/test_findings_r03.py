"""Findings of the third round: joins of few keys, carried values, digests and keys of large tables."""

import hashlib
import random

from pyspark.sql import functions as F

from strandweave.operators import graph, integrity, matched, ordered, sensing, spatial, sweeps
from strandweave.plans import contact_queries, stat_queries
from strandweave.streaming import operators as S


def test_pairs_of_a_key_are_spread_over_tasks(spark, rows, monkeypatch):
    monkeypatch.setattr(matched, "BLOCK", 4)
    monkeypatch.setattr(matched, "CELL", 2)
    samples = spark.range(90).select(F.when(F.col("id") < 80, 1).when(F.col("id") < 85, 2).alias("channel"), F.col("id").alias("t_us"), (F.col("id") % 5 - 1.0).alias("value"))
    bound = spark.range(50).select((F.col("id") % 3).cast("int").alias("channel"), F.col("id").alias("node"), F.lit(2.0).alias("gain"), (F.col("id") % 7 != 0).alias("enabled"))
    got = S.channel_drive(samples, bound)
    plain = samples.join(bound.where("enabled"), "channel").select("t_us", "node", (F.col("value") * F.col("gain")).alias("rate")).where("rate > 0")
    assert rows(got) == rows(plain) and plain.count() > 500
    assert got.groupBy(F.spark_partition_id()).count().count() > 2  # one key for each task, of two, before


def test_next_value_from_each_row(spark):
    rnd = random.Random(4)
    own = [(i, rnd.choice([None, None, None, i])) for i in range(300)] + [(300, None)]
    got = {r["i"]: r["to"] for r in ordered.next_from(spark.createDataFrame(own, "i long, v long").repartition(3), ["i"], "v", "to").collect()}
    assert got == {i: next((v for _, v in own[i:] if v is not None), None) for i, _ in own}


def test_frames_of_many_times(spark):
    """A window that looks ahead to the end of a channel takes the square of its frames, and a channel is one task."""
    n = 40_000
    samples = spark.range(n).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("sensor"), (F.col("id") * 10).alias("t_us"), F.col("id").cast("double").alias("value"))
    bound = spark.createDataFrame([("now", "a", 0, 0.0, 1.0, 1.0, 1.0, True), ("late", "b", 15, 0.0, 1.0, 1.0, 1.0, True)], "channel string, sensor string, delay_us long, threshold double, half double, most double, gain double, enabled boolean")
    out = sensing.channel_frames(samples, bound)
    assert "windowspecdefinition(channel" not in out._jdf.queryExecution().analyzed().toString()
    got = {(r["channel"], r["t_us"]): r["quantity"] for r in out.where("t_us >= 399950 or t_us < 50").collect()}
    assert got == {(c, t * 10): float(t if c == "now" and t % 2 == 0 else t - 2 if c == "late" and t % 2 and t > 1 else 0) for c in ("now", "late") for t in [*range(5), *range(n - 5, n)]}


def test_type_pairs_are_spread_over_tasks(spark, rows, monkeypatch):
    monkeypatch.setattr(matched, "BLOCK", 4)
    monkeypatch.setattr(matched, "CELL", 2)
    rnd = random.Random(2)
    edges = [(i, rnd.randrange(60), rnd.randint(1, 9)) for i in range(60) for _ in range(2)]
    labels = {i: "big" for i in range(40)} | {i: "small" for i in range(40, 50)}
    type_of = lambda i: labels.get(i, f"node:{i}")
    got = graph.type_only(spark.createDataFrame(edges, "src long, dst long, weight long"), spark.createDataFrame(list(labels.items()), "node long, label string"))
    per = {}
    for a, b, w in edges:
        per.setdefault((type_of(a), type_of(b)), []).append(w)
    nodes = {n for a, b, _ in edges for n in (a, b)}
    want = [(a, b, max(round(sum(w) / len(w)), 1)) for (s, t), w in per.items() for a in nodes if type_of(a) == s for b in nodes if type_of(b) == t and a != b]
    assert rows(got) == sorted(want, key=repr)
    big = got.where("src < 40 and dst < 40").groupBy(F.spark_partition_id()).count()
    assert big.count() > 1  # all in one task before


def test_sweeps_made_of_few_rows_are_not_broadcast(spark):
    i = F.col("i")
    made = spark.range(20).select(F.col("id").alias("sweep"), F.explode(F.sequence(F.lit(0), F.lit(99))).alias("i"))
    samples = made.select("sweep", "i", F.when(i.between(20, 59), 5.0).otherwise(0.0).alias("current"), (-60 + F.when(i >= 20, 1 - F.exp(-(i - 20) / 10)).otherwise(0.0)).alias("voltage"))
    out = sweeps.features(samples, 0.5)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 20


def test_keys_out_of_range_count_as_broken(spark, tmp_path):
    """Bits of an order key of 2^21 or more run into the quantity's; nothing is left out."""
    lines = [((1 << 21) + 5, 1, 3.0, 1, 1, "N"), (7, 2, 4.0, 1, 1, "N"), (7, 2, 5.0, 1, 1, "R"), ((1 << 21) + 5, 2, 3.0, 1, 1, "N")]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double, l_suppkey long, l_partkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(7,), ((1 << 21) + 5,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = contact_queries.packed_key_roundtrip(spark, str(tmp_path)).first()
    assert tuple(got) == (4, 2, max((int(q) << 42) | (k << 21) | n for k, n, q, *_ in lines))
    assert {r["check_name"]: r["observed"] for r in contact_queries.contact_audit(spark, str(tmp_path)).collect()}["unique_keys"] == 1


def test_digest_of_the_query_has_two_levels_at_any_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(integrity, "GROUP_ROWS", 1)  # what counts as large
    parts = [(k, f"b{k % 7}", "ECONOMY" if k % 3 else "LARGE", k % 50) for k in range(2000)]
    spark.createDataFrame(parts + parts[:3], "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    digest = lambda p: sha(f"{p[0]}|{p[1]}|{p[3]}|" + ("\\N" if p[2] == "ECONOMY" else p[2]))
    groups = {}
    for d in sorted(digest(p) + ("*2" if p[0] < 3 else "") for p in parts):
        groups.setdefault(d[:2], []).append(d)
    assert tuple(stat_queries.logical_digest(spark, str(tmp_path)).first()) == (2003, sha("".join(sha("".join(groups[g])) for g in sorted(groups))))


def test_discs_of_one_cell_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(matched, "BLOCK", 4)
    monkeypatch.setattr(matched, "CELL", 2)
    rnd = random.Random(6)
    discs = [(i, rnd.uniform(0, 25), rnd.uniform(0, 25), 1.0 + i % 3) for i in range(120)] + [(i, rnd.uniform(-60, 60), rnd.uniform(-60, 60), 14.0) for i in range(120, 160)]
    got = spatial.overlaps(spark.createDataFrame(discs, "id long, x double, y double, r double"), 28.0)
    want = [(a[0], b[0]) for a in discs for b in discs if a[0] < b[0] and ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5 < a[3] + b[3]]
    assert sorted(tuple(r) for r in got.collect()) == want
    assert "_c_l" in got._jdf.queryExecution().executedPlan().toString()  # a cell of the grid was one key, and so one task, before


def test_equal_sequence_numbers_give_one_result(spark, rows):
    own = [(1, 0, 50), (1, 1, 90), (1, 1, 10), (1, 2, 60), (1, 1, 95)]
    want = [(1, 1, 10, 50), (1, 2, 60, 95)]
    for order in (own, own[::-1], sorted(own, key=lambda r: -r[2])):
        assert rows(S.backward_rows(spark.createDataFrame(order, "key long, seq long, t_us long").coalesce(1))) == want
