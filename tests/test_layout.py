"""Bucketed contacts plan without an exchange; imports pass over their input once and publish only what is sound."""

import pytest
from pyspark.sql import functions as F

from strandweave.errors import IntegrityError
from strandweave.operators import contacts
from strandweave.sources import imports, layout


@pytest.fixture
def large(spark):
    """As if no side of a join were small."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def tables(spark):
    points = spark.range(500).select(F.col("id").alias("point_id"), (F.col("id") % 20).alias("body"))
    partners = spark.range(3000).select((F.col("id") * 7 % 500).alias("pre_id"), (F.col("id") * 11 % 520).alias("post_id"))
    return points, partners.select("*", (F.col("pre_id") % 20).alias("body_pre"), F.when(F.col("post_id") % 100 == 3, F.lit(None)).otherwise(F.col("post_id") % 20).alias("body_post"))


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_audits_of_bucketed_contacts_exchange_nothing(spark, large):
    points, partners = tables(spark)
    store = imports.write_contacts(points, partners)
    official = layout.write_bucketed(store.pairs.df.where("src <> 3"), ["src", "dst"])
    lost = contacts.unresolved(store.by_pre.df, store.points.df, ("pre_id", "point_id"), (("body_pre", "body"),))
    wrong = contacts.reconcile(store.pairs.df, official.df, ["src", "dst"])
    twice = store.points.df.groupBy("point_id").count()
    assert [exchanges(x) for x in (lost, wrong, twice)] == [0, 0, 0]
    got = {r["check_name"]: r["observed"] for r in imports.audit_contacts(store, official).collect()}
    # The same by plain joins.
    post = [(r["post_id"], r["body_post"]) for r in partners.collect()]
    known = {(r["point_id"], r["body"]) for r in points.collect()}
    pairs = partners.groupBy(F.col("body_pre").alias("src"), F.col("body_post").alias("dst")).agg(F.count("*").alias("weight"))
    plain = contacts.reconcile(pairs, pairs.where("src <> 3"), ["src", "dst"])  # a pair without an end is never the official one
    assert got == {"unique_points": 0, "pre_endpoints": 0, "post_endpoints": sum(x not in known for x in post), "pairs": plain.count()}
    assert exchanges(contacts.unmatched(partners.select("pre_id"), points.select(F.col("point_id").alias("pre_id")), ["pre_id"])) > 0
    store.drop()
    official.drop()


def test_a_later_session_opens_the_layout(spark, large, tmp_path):
    points, _ = tables(spark)
    one = layout.write_bucketed(points, ["point_id"], 3, path=f"{tmp_path}/points")
    spark.sql(f"DROP TABLE `{one.name}`")
    again = layout.open_bucketed(spark, "points_again", one.path, "point_id bigint, body bigint", ["point_id"], 3)
    assert again.df.count() == 500 and exchanges(again.df.groupBy("point_id").count()) == 0
    again.drop()


def counted(spark, df):
    """``df`` with a count of the rows that were read."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(count, df.schema), seen


def test_import_reads_its_input_once(spark, tmp_path):
    raw = spark.range(2000).select((F.col("id") % 50).alias("src"), (F.col("id") % 37).alias("dst"), F.lit(2).cast("bigint").alias("weight"))
    watched, seen = counted(spark, raw)
    bodies = spark.range(40).withColumnRenamed("id", "node")
    out = imports.import_edges_counted(watched, f"{tmp_path}/deep/edges", bodies)
    assert seen.value == 2000
    inside = raw.where("src < 40")
    assert out.counts == {"null_ids": 0, "negative_ids": 0, "null_weights": 0, "nonpositive_weights": 0, "overflow_weights": 0, "raw_edges": 2000, "excluded_edges": 2000 - inside.count(), "excluded_contacts": 2 * (2000 - inside.count())}
    want = {(r["src"], r["dst"]): r["w"] for r in inside.groupBy("src", "dst").agg(F.sum("weight").alias("w")).collect()}
    assert {(r["src"], r["dst"]): r["weight"] for r in out.df.collect()} == want


def test_an_unsound_import_leaves_nothing(spark, tmp_path):
    raw = spark.createDataFrame([(1, 2, 3), (1, None, 3), (4, 5, 0)], "src long, dst long, weight long")
    with pytest.raises(IntegrityError, match="null_ids"):
        imports.import_edges(raw, f"{tmp_path}/e")
    with pytest.raises(IntegrityError, match="negative"):
        imports.import_contacts(spark.createDataFrame([(-1, 0), (2, 1)], "body long, x int"), f"{tmp_path}/c", ["body"])
    assert list(tmp_path.iterdir()) == []
    good = imports.import_edges(raw.limit(1), f"{tmp_path}/e")
    assert good.count() == 1 and [p.name for p in tmp_path.iterdir()] == ["e"]
    with pytest.raises(IntegrityError, match="exists"):
        imports.import_edges(raw.limit(1), f"{tmp_path}/e")
    empty = imports.import_edges_counted(raw.limit(0), f"{tmp_path}/none")
    assert empty.df.count() == 0 and empty.counts["raw_edges"] == 0
    nobody = imports.import_edges_counted(raw.limit(1), f"{tmp_path}/nobody", raw.limit(0).select(F.col("src").alias("node")))
    assert nobody.df.count() == 0 and nobody.counts["excluded_edges"] == 1
