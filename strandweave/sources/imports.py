"""Imports and sinks: contact tables to sorted Parquet, edge tables restricted to a body universe."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strandweave.errors import IntegrityError
from strandweave.operators import contacts
from strandweave.operators.graph import aggregated
from strandweave.operators.integrity import additive_digest
from strandweave.operators.ordered import cut
from strandweave.schema import normalised_ids, refuse_violations, violations
from strandweave.sources.layout import Bucketed, write_bucketed


def _marked(edges: DataFrame, bodies: DataFrame) -> DataFrame:
    """Edges with ``_in``, whether both ends are in the universe (node)."""
    known = bodies.select("node").distinct()
    marked = edges.join(known.select(F.col("node").alias("src"), F.lit(True).alias("_s")), "src", "left").join(known.select(F.col("node").alias("dst"), F.lit(True).alias("_d")), "dst", "left")
    return marked.withColumn("_in", F.col("_s").isNotNull() & F.col("_d").isNotNull()).drop("_s", "_d")


def _left_out() -> list[Column]:
    outside = ~F.col("_in")
    return [F.count_if(outside).alias("excluded_edges"), F.coalesce(F.sum(F.when(outside, F.col("weight"))), F.lit(0)).cast("bigint").alias("excluded_contacts"), F.count("*").alias("raw_edges")]


def restricted(edges: DataFrame, bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summed edges whose ends are both in the universe (node), and one row of what was left out."""
    marked = _marked(edges, bodies)
    return aggregated(marked.where("_in"), "src", "dst", F.col("weight")), marked.agg(*_left_out())


def _published(df: DataFrame, path: str, check: Callable[[], None], **options: object) -> DataFrame:
    """``df`` written beside ``path`` and moved there once ``check`` has passed; if it raises, nothing is left.  A target that exists is refused."""
    spark = df.sparkSession
    made = spark._jvm.org.apache.hadoop.fs.Path
    target, staging = made(path), made(f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise IntegrityError(f"{path} exists")
    try:
        df.write.options(compression="zstd", **options).parquet(staging.toString())
        check()
        if target.getParent() is not None:
            fs.mkdirs(target.getParent())
        if fs.exists(target) or not fs.rename(staging, target):
            raise IntegrityError(f"{path} exists")
    finally:
        fs.delete(staging, True)
    return spark.read.parquet(path)


def _observed(seen: Observation, df: DataFrame, *counts: Column) -> dict[str, int]:
    """What the writing job counted; where the planner saw that nothing comes out, it counted nothing, and a pass of its own does."""
    try:
        return seen.get
    except Py4JJavaError:
        return df.agg(*counts).first().asDict()


@dataclass
class Imported:
    """What an import wrote, and what it counted on the way: violations, and for a universe what was left out."""

    df: DataFrame
    counts: dict[str, int]


def import_edges_counted(raw: DataFrame, path: str, bodies: DataFrame | None = None) -> Imported:
    """Sums duplicate pairs, sorts by (src, dst) and writes, in one pass over ``raw``; an existing target is refused.

    Violations, excluded rows and excluded contacts are counted by the job that writes.  It writes beside the target, which appears
    only if there is no violation; else the import raises and leaves nothing.
    """
    seen, kept = Observation(), Observation()
    sound = [*violations(), F.count("*").alias("raw_edges")]
    edges = raw.observe(seen, *sound)
    if raw._jdf.queryExecution().sparkPlan().outputPartitioning().toString().startswith("SinglePartition"):
        edges = edges.repartition(2)  # else nothing would part the counts from the range sampling, which would count again
    if bodies is not None:
        edges = _marked(edges, bodies).observe(kept, *_left_out()).where("_in")
    edges = aggregated(edges, "src", "dst", F.col("weight")).repartitionByRange("src", "dst").sortWithinPartitions("src", "dst")
    counts: dict[str, int] = {}

    def check() -> None:
        counts.update(_observed(seen, raw, *sound))
        refuse_violations({k: v for k, v in counts.items() if k != "raw_edges"})
        counts.update(_observed(kept, _marked(raw, bodies), *_left_out()) if bodies is not None else {})

    return Imported(_published(edges, path, check), counts)


def import_edges(raw: DataFrame, path: str, bodies: DataFrame | None = None) -> DataFrame:
    """The edges of ``import_edges_counted``."""
    return import_edges_counted(raw, path, bodies).df


def import_contacts(raw: DataFrame, path: str, order: list[str], rows_per_file: int = 5_000_000) -> DataFrame:
    """Normalises ids, sorts by range and writes zstd shards of bounded size.

    Negative ids are counted by the job that writes; with any, the import raises and the target does not appear.
    """
    df = normalised_ids(raw)
    ids = [c for c in df.columns if c == "sv" or c == "point_id" or c.startswith("body")]
    seen = Observation()
    least = [F.count("*").alias("rows"), *[F.min(c).alias(c) for c in ids]]
    df = df.observe(seen, *least)

    def check() -> None:
        bad = [c for c, v in _observed(seen, normalised_ids(raw), *least).items() if c in ids and v is not None and v < 0]
        if bad:
            raise IntegrityError(f"negative ids in {', '.join(bad)}")

    return _published(df.repartitionByRange(*order).sortWithinPartitions(*order), path, check, maxRecordsPerFile=rows_per_file)


@dataclass
class Contacts:
    """Points by id, contacts by either end and as pairs, each bucketed by what it is joined on."""

    points: Bucketed
    by_pre: Bucketed
    by_post: Bucketed
    pairs: Bucketed

    def drop(self) -> None:
        for table in (self.points, self.by_pre, self.by_post, self.pairs):
            table.drop()


def write_contacts(points: DataFrame, partners: DataFrame, buckets: int | None = None, folder: str | None = None) -> Contacts:
    """Points (point_id, body, and any others) and partners (pre_id, post_id, body_pre, body_post, and any others) laid out for audits.

    Endpoint joins, uniqueness and the reconciliation of pairs then read the buckets that belong together and exchange nothing.
    """
    at = lambda name: f"{folder}/{name}" if folder else None
    pairs = aggregated(partners, "body_pre", "body_post")
    return Contacts(
        write_bucketed(points, ["point_id"], buckets, path=at("points")), write_bucketed(partners, ["pre_id"], buckets, path=at("by_pre")),
        write_bucketed(partners, ["post_id"], buckets, path=at("by_post")), write_bucketed(pairs, ["src", "dst"], buckets, path=at("pairs")),
    )


def audit_contacts(store: Contacts, official: Bucketed) -> DataFrame:
    """(check_name, observed, expected, passed) of a laid-out contact table: unique point ids, ends that are points of the
    body they name, and pairs (src, dst, weight), bucketed by (src, dst), that are the official ones."""
    points, pre, post = store.points.df, store.by_pre.df, store.by_post.df
    count = lambda df: df.agg(F.count("*").alias("observed"))
    return contacts.audit([
        ("unique_points", contacts.duplicates(points, F.col("point_id")), 0),
        ("pre_endpoints", count(contacts.unresolved(pre, points, ("pre_id", "point_id"), (("body_pre", "body"),))), 0),
        ("post_endpoints", count(contacts.unresolved(post, points, ("post_id", "point_id"), (("body_post", "body"),))), 0),
        ("pairs", count(contacts.reconcile(store.pairs.df, official.df, ["src", "dst"])), 0),
    ])


def import_sharded(raw: DataFrame, path: str, order: list[str], shards: int, rows_per_group: int = 131_072) -> DataFrame:
    """Writes ``raw`` in ``shards`` hash shards of the first order column, each sorted, and a manifest; what an earlier call has finished is kept.

    A shard is finished once the manifest (shard, rows, digest) has it.  Only the shards that are not are written (again); the
    manifest is then extended from what was read back.  A finished shard whose rows or digest have changed raises.
    """
    spark = raw.sparkSession
    df = normalised_ids(raw).withColumn("shard", F.pmod(F.xxhash64(order[0]), F.lit(shards)).cast("int"))
    schema = "shard int, rows bigint, digest string"
    manifest = f"{path}/_manifest"

    def measured(rows: DataFrame) -> DataFrame:
        columns = sorted(c for c in rows.columns if c != "shard")
        return rows.groupBy("shard").agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string").alias("digest"))

    try:
        done = cut(spark.read.schema(schema).json(manifest))
    except AnalysisException:
        done = spark.createDataFrame([], schema)
    finished = [r["shard"] for r in done.collect()]  # at most ``shards`` rows
    if len(finished) < shards:
        rest = df.where(~F.col("shard").isin(finished)) if finished else df
        writer = rest.repartition(shards, "shard").sortWithinPartitions("shard", *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("shard").option("compression", "zstd").option("parquet.block.row.count.limit", rows_per_group).option("parquet.page.write-checksum.enabled", "true").parquet(f"{path}/data")
    written = spark.read.schema(df.schema).parquet(f"{path}/data")
    now = cut(measured(written))
    if finished:
        bad = done.join(now.withColumnRenamed("rows", "_n").withColumnRenamed("digest", "_d"), "shard", "left").where("not (rows <=> _n and digest <=> _d)").limit(1).collect()
        if bad:
            raise IntegrityError(f"shard {bad[0]['shard']} is not what the manifest says")
    new = now.join(done.select("shard"), "shard", "left_anti")
    empty = spark.range(shards).select(F.col("id").cast("int").alias("shard")).join(now.select("shard"), "shard", "left_anti").join(done.select("shard"), "shard", "left_anti")
    new.unionByName(empty.select("shard", F.lit(0).cast("bigint").alias("rows"), F.lit("0").alias("digest"))).coalesce(1).write.mode("append").json(manifest)
    return written.drop("shard")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as Parquet, with their digests beside them."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/{name}")
        back = nodes.sparkSession.read.parquet(f"{path}/{name}")
        additive_digest(back, sorted(back.columns)).write.mode("errorifexists").json(f"{path}/{name}.digest")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that ``write_graph`` wrote; content that its digest does not fit raises."""
    out = []
    for name in ("nodes", "edges"):
        df = spark.read.parquet(f"{path}/{name}")
        want = spark.read.schema("rows bigint, digest string").json(f"{path}/{name}.digest").first()
        if additive_digest(df, sorted(df.columns)).first() != want:
            raise IntegrityError(f"{name} of {path} are not those that were written")
        out.append(df)
    return out[0], out[1]


def write_trace(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)
