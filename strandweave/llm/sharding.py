"""Balanced label propagation: linked documents meet in one shard.

Documents with equal texts are linked.  Members of one group in one shard are
interchangeable, so the moving state is a table of cells (group, shard, count),
at most one row per shard for each group however large the group is.  Each round
moves part of a cell towards the shard where most of its group lies, among those
with room; how much is set by quotas computed from one (from, to) demand matrix
of ``shards`` squared numbers.  Documents without links are the filler that makes
the counts even at the end.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandweave.llm._common import cut

#: Rows that one task ranks at a time.
RANK_ROWS = 50_000
#: Marks of groups with more rows than that; a fixed number, so they may be broadcast whatever there is.
HOT_MARKS = 1 << 16


def _literals(values: list[int]) -> Column:
    return F.array(*[F.lit(int(v)).cast("bigint") for v in values])


def _quotas(demand: list[list[float]], room: list[int]) -> list[list[float]]:
    """Share of each wish (from, to) that is granted so that no inflow exceeds the room."""
    shards = len(room)
    inflow = [sum(demand[s][t] for s in range(shards)) for t in range(shards)]
    return [[min(1.0, room[t] / inflow[t]) if inflow[t] else 0.0 for t in range(shards)] for _ in range(shards)]


def _cells_after_moves(cells: DataFrame, shards: int, capacity: list[int], rounds: int) -> DataFrame:
    """Cells once no group gains by moving, or after ``rounds`` rounds."""
    for turn in range(rounds):
        load = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # at most ``shards`` rows
        room = [max(0, capacity[s] - load.get(s, 0)) for s in range(shards)]
        # The target is the fullest shard of the group that still has room; a cell moves only to one that holds more than it, or as much and comes first.
        has_room = F.element_at(_literals(room), F.col("shard") + 1) > 0
        best = cells.groupBy("g").agg(F.max(F.when(has_room, F.struct(F.col("n").alias("most"), (-F.col("shard")).alias("neg")))).alias("best"))
        wish = cells.join(best, "g").withColumn("to", -F.col("best.neg"))
        gains = (F.col("to") != F.col("shard")) & ((F.col("n") < F.col("best.most")) | ((F.col("n") == F.col("best.most")) & (F.col("to") < F.col("shard"))))
        wish = wish.withColumn("to", F.when(gains, F.col("to")))
        demand = [[0.0] * shards for _ in range(shards)]
        for r in wish.where(F.col("to").isNotNull()).groupBy("shard", "to").agg(F.sum("n").alias("n")).collect():  # at most ``shards`` squared rows
            demand[r["shard"]][r["to"]] = r["n"]
        if not any(map(any, demand)):
            break
        grant = _quotas(demand, room)
        share = F.element_at(F.element_at(F.array(*[F.array(*[F.lit(x) for x in row]) for row in grant]), F.col("shard") + 1), F.col("to").cast("int") + 1)
        # A cell of one document goes whole or stays, by its group's hash, so that small groups are not rounded down for ever.
        whole = F.floor(F.col("n") * share)
        coin = (F.pmod(F.xxhash64("g", "shard"), F.lit(1 << 20)) / F.lit(float(1 << 20))) < (F.col("n") * share - whole)
        moved = F.when(F.col("to").isNull(), F.lit(0)).when(share >= 1.0, F.col("n")).otherwise(whole + coin.cast("bigint")).cast("bigint")
        flows = wish.withColumn("moved", moved)
        parts = F.array(F.struct(F.col("shard").alias("shard"), (F.col("n") - F.col("moved")).alias("n")), F.struct(F.coalesce(F.col("to"), F.col("shard")).cast("int").alias("shard"), F.col("moved").alias("n")))
        cells = cut(flows.select("g", F.explode(parts).alias("p")).select("g", "p.shard", "p.n").where("n > 0").groupBy("g", "shard").agg(F.sum("n").alias("n")))
        if turn == rounds - 1:
            logging.getLogger(__name__).warning("after %d rounds some groups could still move together", rounds)
    return cells


def _ranked(rows: DataFrame, keys: list[str], buckets: Column, order: list[str], out: str) -> DataFrame:
    """Adds ``out``, the rank from 0 within ``keys``, ranking one hash bucket at a time."""
    placed = rows.withColumn("_b", F.pmod(F.xxhash64(*order), buckets))
    sizes = placed.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*keys, "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    inner = placed.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)))
    return inner.join(sizes, [*keys, "_b"]).withColumn(out, F.col("_before") + F.col("_r") - 1).drop("_b", "_r", "_before")


def _with_plan(base: DataFrame, plan: DataFrame) -> DataFrame:
    """``base`` with the plan of each row's group, if it has one.

    The rows of a group above ``RANK_ROWS``, and of those few that share its mark, are dealt over several tasks, to which the group's plan is copied.
    """
    mark = F.pmod(F.xxhash64("g"), F.lit(HOT_MARKS)).cast("int")
    hot = plan.where(F.col("group_n") > RANK_ROWS).groupBy(mark.alias("mark")).agg(F.max("group_n").alias("n"))
    hot = hot.select("mark", F.ceil(F.col("n") / RANK_ROWS).cast("int").alias("ways"))
    ways = lambda df: df.withColumn("mark", mark).join(F.broadcast(hot), "mark", "left").withColumn("ways", F.coalesce("ways", F.lit(1))).drop("mark")
    dealt = ways(base).withColumn("way", F.pmod(F.xxhash64("h", "id", F.lit(5)), "ways").cast("int")).drop("ways")
    copied = ways(plan).withColumn("way", F.explode(F.sequence(F.lit(0), F.col("ways") - 1))).drop("ways")
    return dealt.join(copied, ["g", "way"], "left").drop("way")


def balanced_shards(docs: DataFrame, shards: int = 24, rounds: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, size (UTF-8 bytes of the text plus 8), text_crc32, shard, slot.

    Row counts of the shards differ by at most one; slots are gapless from 0 in
    each shard.  Equal texts share a shard as far as the counts allow: a group
    that outgrows the room of one shard fills further ones.  Moves end after ``rounds`` rounds; if groups could
    still gain by moving, a warning is logged.

    Null text counts as empty.  Repeated rows and null ids are placed like any
    others.  Columns of ``docs`` other than these two are not used.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = cut(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 8).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("g"),
            F.xxhash64(F.lit(3), text).alias("g2"),
        ).select("id", "size", "text_crc32", F.struct("g", "g2").alias("g"), F.xxhash64("id").alias("h"))
    )
    total = base.count()
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    start = F.pmod(F.xxhash64(F.col("h"), F.lit(11)), F.lit(shards)).cast("int")
    cells = base.groupBy("g", start.alias("shard")).agg(F.count("*").alias("n"))
    linked = cells.groupBy("g").agg(F.sum("n").alias("group_n")).where("group_n > 1")
    cells = cut(cells.join(linked.select("g"), "g"))
    cells = _cells_after_moves(cells, shards, capacity, rounds)
    plan = cells.groupBy("g").agg(F.sum("n").alias("group_n"), F.array_sort(F.collect_list(F.struct(F.col("shard"), F.col("n")))).alias("parts"))

    # Members of a group take its cells in the order of their rank within the group.
    tagged = _with_plan(base, plan)
    singles = tagged.where("group_n is null").select("id", "size", "text_crc32", "g", "h", F.lit(shards).alias("kind"))
    members = tagged.where("group_n is not null").withColumn("buckets", F.ceil(F.col("group_n") / RANK_ROWS))
    members = _ranked(members, ["g"], F.col("buckets"), ["h", "id"], "rank")
    upto = F.expr("filter(transform(parts, (p, i) -> struct(p.shard as shard, aggregate(slice(parts, 1, i + 1), 0L, (a, q) -> a + q.n) as upto)), p -> p.upto > rank)[0].shard")
    members = members.select("id", "size", "text_crc32", "g", "h", upto.cast("int").alias("kind"))

    # ``kind`` is the shard of a linked row, ``shards`` for a filler.
    rows = members.unionByName(singles)
    rows = cut(_ranked(rows, ["kind"], F.lit(max(1, -(-total // RANK_ROWS))), ["h", "id", "g"], "rank"))
    counts = {r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # at most ``shards`` + 1 rows
    held = [min(counts.get(s, 0), capacity[s]) for s in range(shards)]
    over = [counts.get(s, 0) - held[s] for s in range(shards)]
    before_over = [counts.get(shards, 0) + sum(over[:s]) for s in range(shards)]
    room = [capacity[s] - held[s] for s in range(shards)]
    before_room = [sum(room[:s]) for s in range(shards)]
    stays = (F.col("kind") < shards) & (F.col("rank") < F.element_at(_literals([*held, 0]), F.col("kind") + 1))
    filler = F.when(F.col("kind") == shards, F.col("rank")).otherwise(
        F.element_at(_literals([*before_over, 0]), F.col("kind") + 1) + F.col("rank") - F.element_at(_literals([*held, 0]), F.col("kind") + 1)
    )
    rows = rows.withColumn("stays", stays).withColumn("filler", filler)
    target = F.lit(None).cast("int")
    for s in (s for s in range(shards) if room[s]):
        target = F.when(F.col("filler") >= before_room[s], F.lit(s)).otherwise(target)
    rows = rows.withColumn("shard", F.when(F.col("stays"), F.col("kind")).otherwise(target).cast("int"))
    slot = F.when(F.col("stays"), F.col("rank")).otherwise(
        F.element_at(_literals(held), F.col("shard") + 1) + F.col("filler") - F.element_at(_literals(before_room), F.col("shard") + 1)
    )
    return rows.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", slot.cast("bigint").alias("slot"))
