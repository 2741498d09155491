"""Breadth-first search of many seed sets at once over adjacency blocks.

A block is a source with some of its neighbours, sorted and as differences; a hub has several
blocks.  Blocks are dealt by source once, so a layer moves only its frontier, never the edges.
Sets are searched 64 at a time: each node carries a mask with a bit for every set that has
reached it, masks merge by OR, and a node is on the next frontier with its new bits alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.operators.ordered import cut
from strandweave.sources.layout import Bucketed, write_bucketed

#: Neighbours of a block, about.
BLOCK = 1024
#: Hubs that are broadcast when edges are dealt into blocks; more are met by a shuffled join.
BROADCAST_HUBS = 1 << 17
SETS = 64


def adjacency(edges: DataFrame, reverse: bool = False) -> Bucketed:
    """(node, way, first, steps): the different neighbours of each source (of each target, reversed) in blocks, as a table bucketed by node."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    links = edges.select(F.col(a).alias("node"), F.col(b).alias("to")).where("node is not null and to is not null")
    hubs = cut(links.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("node", F.ceil(F.col("n") / BLOCK).cast("int").alias("ways")))
    hubs = F.broadcast(hubs) if hubs.limit(BROADCAST_HUBS + 1).count() <= BROADCAST_HUBS else hubs
    way = F.pmod(F.xxhash64("to"), F.coalesce("ways", F.lit(1))).cast("int")
    dealt = links.join(hubs, "node", "left").groupBy("node", way.alias("way")).agg(F.array_sort(F.collect_set("to")).alias("_t"))
    steps = F.transform(F.sequence(F.lit(2), F.size("_t")), lambda i: F.element_at("_t", i) - F.element_at("_t", i - 1))
    blocks = dealt.select("node", "way", F.element_at("_t", 1).alias("first"), F.when(F.size("_t") > 1, steps).otherwise(F.array().cast("array<bigint>")).alias("steps"))
    return write_bucketed(blocks, ["node"])


def neighbours() -> Column:
    """A block's neighbours, one after the other."""
    running = F.aggregate(F.col("steps"), F.array(F.col("first")), lambda done, d: F.concat(done, F.array(F.element_at(done, -1) + d)))
    return F.explode(running)


def spread(blocks: DataFrame, frontier: DataFrame, *carried: str) -> DataFrame:
    """(node, carried): the neighbours of the frontier (node, carried), once for each way to reach them."""
    return frontier.join(blocks, "node").select(*carried, neighbours().alias("node"))


def hops(edges: DataFrame, seeds: DataFrame, limit: int, reverse: bool = False, blocks: DataFrame | None = None) -> DataFrame:
    """(set, node, hop): the nodes that each seed set (set, node) reaches in at most ``limit`` steps, and the least number of them.

    Sets have any name but null; seeds outside the graph and rows without a node are left out.  ``blocks`` may be those of an earlier
    ``adjacency`` of the same edges and direction.
    """
    table = adjacency(edges, reverse) if blocks is None else None
    blocks = blocks if table is None else table.df
    kind = seeds.schema["set"].dataType.simpleString()
    names = cut(seeds.where("set is not null").select("set").distinct())
    # Sets are numbered in blocks of their hash, a batch of 64 with one number each.
    numbered = names.select("set", (F.row_number().over(_by_hash()) - 1).alias("k")).select("set", F.floor(F.col("k") / SETS).cast("int").alias("batch"), (F.col("k") % SETS).cast("int").alias("bit"))
    numbered = cut(numbered)
    present = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    own = seeds.select("set", "node").distinct().join(present, "node", "left_semi").join(numbered, "set")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))
    layers = [cut(own.groupBy("batch", "node").agg(F.bit_or(bit).alias("bits")).withColumn("hop", F.lit(0)))]
    for hop in range(1, limit + 1):
        step = spread(blocks, layers[-1].select("node", "batch", "bits"), "batch", "bits").groupBy("batch", "node").agg(F.bit_or("bits").alias("bits"))
        met = reduce(DataFrame.unionByName, layers).groupBy("batch", "node").agg(F.bit_or("bits").alias("_met"))
        new = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_met", F.lit(0).cast("bigint"))))
        layer = cut(step.join(met, ["batch", "node"], "left").select("batch", "node", new.alias("bits"), F.lit(hop).alias("hop")).where("bits <> 0"))
        if layer.isEmpty():
            break
        layers.append(layer)
    if table is not None:
        table.drop()  # all layers are written down
    found = reduce(DataFrame.unionByName, layers)
    bits = F.filter(F.sequence(F.lit(0), F.lit(SETS - 1)), lambda i: F.call_function("getbit", F.col("bits"), i) == 1)
    return found.select("batch", "node", "hop", F.explode(bits).alias("bit")).join(numbered, ["batch", "bit"]).select(F.col("set").cast(kind).alias("set"), "node", "hop")


def _by_hash():
    from pyspark.sql.window import Window

    # One row for each set.
    return Window.orderBy(F.xxhash64("set"), "set")


def bounded_paths(edges: DataFrame, seeds: DataFrame, readouts: DataFrame, limit: int) -> DataFrame:
    """(set, node, forward, backward): for each seed set the nodes on paths of at most ``limit`` steps to any readout (node)."""
    forward = hops(edges, seeds, limit).withColumnRenamed("hop", "forward")
    back = hops(edges, readouts.select(F.lit(0).alias("set"), "node"), limit, reverse=True).select("node", F.col("hop").alias("backward"))
    return forward.join(back, "node").where(F.col("forward") + F.col("backward") <= limit).select("set", "node", "forward", "backward")
