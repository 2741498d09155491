"""Labelled populations: registries, priority ladders, groups by label."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.errors import IntegrityError
from strandweave.functions.predicates import combined
from strandweave.operators import ordered


def resolve(annotations: DataFrame, registry: list[dict], key: str) -> DataFrame:
    """Members (population_id, key) of every population, in one scan of the annotations."""
    hits = F.array_compact(F.array(*[F.when(combined(p["queries"], p.get("how", "all")), F.lit(p["id"])) for p in registry]))
    return annotations.select(F.col(key), F.explode(hits).alias("population_id")).distinct()


def status(members: DataFrame, registry: list[dict], key: str) -> DataFrame:
    """Bodies of each population and whether their number is expected: resolved, ambiguous or unresolved."""
    spark = members.sparkSession
    wanted = spark.createDataFrame([(p["id"], int(p["min"]), int(p["max"])) for p in registry], "population_id string, lo bigint, hi bigint")
    counts = members.groupBy("population_id").agg(F.count_distinct(key).alias("bodies"))
    bodies = F.coalesce("bodies", F.lit(0)).cast("bigint")
    verdict = F.when(bodies == 0, "unresolved").when(bodies.between(F.col("lo"), F.col("hi")), "resolved").otherwise("ambiguous")
    return F.broadcast(wanted).join(counts, "population_id", "left").select("population_id", bodies.alias("bodies"), verdict.alias("status"))


def ladder(annotations: DataFrame, rungs: list[dict], key: str) -> DataFrame:
    """(key, channel, priority): each body in the channel of its first matching rung; ``unassigned`` without one."""
    ordered = sorted(enumerate(rungs), key=lambda r: (r[1]["priority"], r[0]))
    channel: Column = F.lit("unassigned")
    level: Column = F.lit(None).cast("int")
    for _, rung in reversed(ordered):
        mask = combined(rung["queries"], rung.get("how", "all"))
        channel, level = F.when(mask, F.lit(rung["channel"])).otherwise(channel), F.when(mask, F.lit(rung["priority"])).otherwise(level)
    return annotations.select(F.col(key), channel.alias("channel"), level.alias("priority"))


def ladder_clashes(annotations: DataFrame, rungs: list[dict], key: str) -> DataFrame:
    """Bodies that several rungs of one priority claim."""
    hits = F.array_compact(F.array(*[F.when(combined(r["queries"], r.get("how", "all")), F.struct(F.lit(r["priority"]).alias("priority"), F.lit(r["channel"]).alias("channel"))) for r in rungs]))
    claims = annotations.select(F.col(key), F.explode(hits).alias("h"))
    return claims.groupBy(key, F.col("h.priority").alias("priority")).agg(F.count("*").alias("claims")).where("claims > 1")


def require_no_clash(annotations: DataFrame, rungs: list[dict], key: str) -> None:
    row = ladder_clashes(annotations, rungs, key).limit(1).collect()
    if row:
        raise IntegrityError(f"rungs share priority {row[0]['priority']} on {key} {row[0][key]}")


def ledger(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("channel").agg(F.count("*").alias("bodies"))


def grouped(annotations: DataFrame, label: Column, key: str) -> DataFrame:
    """(label, bodies) of the labelled rows."""
    return annotations.select(F.col(key), label.alias("label")).where("label is not null").groupBy("label").agg(F.count_distinct(key).alias("bodies"))


def missing_labels(left: DataFrame, right: DataFrame, column: str = "label") -> DataFrame:
    """Labels that only one side has, with that side."""
    a, b = left.select(column).distinct(), right.select(column).distinct()
    return a.exceptAll(b).withColumn("only_in", F.lit("left")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("right")))


def require_disjoint(members: DataFrame, key: str) -> None:
    twice = members.groupBy(key).agg(F.count_distinct("population_id").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise IntegrityError(f"{key} {twice[0][key]} is in several populations")


def union_of(filters: dict[str, Column], annotations: DataFrame, key: str) -> DataFrame:
    """(name, key) of a table of predicates."""
    return reduce(DataFrame.unionByName, [annotations.where(mask).select(F.lit(name).alias("name"), F.col(key)) for name, mask in filters.items()])


def quantile_bins(values: DataFrame, key: str, value: str, bins: int) -> DataFrame:
    """(key, value, bin): bins between exact quantiles; equal values share a bin, and the largest falls in the last."""
    edges = ordered.quantiles(values, [], value, tuple(i / bins for i in range(bins + 1)))
    at = F.size(F.filter("q", lambda e: e <= F.col(value))) - 1
    return values.join(F.broadcast(edges)).select(key, value, F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"))


def declared(annotations: DataFrame, specs: list[dict], key: str) -> DataFrame:
    """Members (role, name, key, unknown_side) of declared populations, in one scan of the annotations.

    A spec has role (``entry``, ``readout`` or ``monitor``), name, a condition ``where``, and optionally ``side_column`` and ``side``; rows
    that fit but are on neither side L nor R have ``unknown_side`` and are no members.  A population without members, or a member of both
    an entry and a readout, is refused.
    """
    rows = []
    for p in specs:
        side = F.col(p["side_column"]) if p.get("side") else F.lit(None).cast("string")
        own = F.lit(True) if not p.get("side") else F.coalesce(side == p["side"], F.lit(False))
        lost = F.lit(False) if not p.get("side") else ~F.coalesce(side.isin("L", "R"), F.lit(False))
        rows.append(F.when(p["where"] & (own | lost), F.struct(F.lit(p["role"]).alias("role"), F.lit(p["name"]).alias("name"), (~own).alias("unknown_side"))))
    hits = annotations.select(F.col(key), F.explode(F.array_compact(F.array(*rows))).alias("h")).select("h.role", "h.name", F.col(key), "h.unknown_side")
    found = {r["name"] for r in hits.where("not unknown_side").select("name").distinct().collect()}  # at most a row for each spec
    empty = sorted({p["name"] for p in specs} - found)
    if empty:
        raise IntegrityError(f"{empty[0]} has no members")
    both = hits.where("not unknown_side and role in ('entry', 'readout')").groupBy(key).agg(F.count_distinct("role").alias("n")).where("n > 1").limit(1).collect()
    if both:
        raise IntegrityError(f"{key} {both[0][key]} is entry and readout")
    return hits


def group_means(members: DataFrame, values: DataFrame, ablated: tuple[str, ...] = ()) -> DataFrame:
    """(t, group, value): mean over the members (group, node) of values (t, node, value), 0 for those without one; ablated groups are 0."""
    size = members.groupBy("group").agg(F.count("*").alias("_n"))
    total = values.join(members, "node").groupBy("t", "group").agg(F.sum("value").alias("_s"))
    grid = values.select("t").distinct().crossJoin(F.broadcast(size))  # the result has a row for each
    mean = F.when(F.col("group").isin(*ablated), 0.0).otherwise(F.coalesce("_s", F.lit(0.0)) / F.col("_n")) if ablated else F.coalesce("_s", F.lit(0.0)) / F.col("_n")
    return grid.join(total, ["t", "group"], "left").select("t", "group", mean.alias("value"))


def entry_union(partition: DataFrame, surrogates: DataFrame) -> DataFrame:
    """Distinct nodes of both; a node of both is refused."""
    twice = partition.select("node").join(surrogates.select("node"), "node", "left_semi").limit(1).collect()
    if twice:
        raise IntegrityError(f"node {twice[0]['node']} is in the partition and a surrogate")
    return partition.select("node").unionByName(surrogates.select("node")).distinct()


def with_records(nodes: DataFrame, records: DataFrame, default: dict) -> DataFrame:
    """Nodes (node, type) with the columns of their type's record, those of ``default`` where there is none, and ``is_default``."""
    twice = records.groupBy("type").count().where("count > 1").limit(1).collect()
    if twice:
        raise IntegrityError(f"type {twice[0]['type']} has several records")
    joined = nodes.join(records.withColumn("_known", F.lit(True)), "type", "left")
    known = F.col("_known").isNotNull()
    values = [F.when(known, F.col(c)).otherwise(F.lit(default[c])).alias(c) for c in records.columns if c != "type"]
    return joined.select("node", "type", *values, (~known).alias("is_default"))


def coverage(resolved: DataFrame, set_col: str, measured: Column) -> DataFrame:
    """(set, nodes, fraction, measured, fallback): how many nodes each parameter set covers, and their share of all."""
    per = resolved.groupBy(F.col(set_col).alias("set")).agg(F.count("*").alias("nodes"), F.max(measured).alias("measured"), F.count_if("is_default").alias("fallback"))
    whole = resolved.agg(F.count("*").alias("_all"))
    return per.join(F.broadcast(whole)).select("set", "nodes", (F.col("nodes") / F.col("_all")).alias("fraction"), "measured", "fallback")


def live_edges(members: DataFrame, edges: DataFrame, sign: DataFrame) -> DataFrame:
    """Per channel of members (channel, node): bodies, those with a sign, and their edges that are live (of a source with a sign) or dead."""
    own = members.select("channel", "node").distinct().join(sign.select("node", "sign"), "node", "left").withColumn("live", F.coalesce(F.col("sign") != 0, F.lit(False)))
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("_e"), F.sum("weight").alias("_w"))
    own = own.join(out, "node", "left")
    e, w = F.coalesce("_e", F.lit(0)), F.coalesce("_w", F.lit(0))
    per = own.groupBy("channel").agg(
        F.count("*").alias("bodies"), F.count_if("live").alias("live_bodies"), F.sum(F.when(F.col("live"), e).otherwise(0)).alias("live_edges"),
        F.sum(F.when(F.col("live"), w).otherwise(0)).cast("bigint").alias("live_contacts"), F.sum(F.when(F.col("live"), 0).otherwise(e)).alias("dead_edges"),
    )
    return per.withColumn("live_fraction", F.col("live_bodies") / F.col("bodies")).withColumn("drivable", F.col("live_edges") > 0)
