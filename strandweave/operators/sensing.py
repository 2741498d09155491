"""From world quantities to rates, one frame for each coupling interval, and the order of commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandweave.errors import CausalityError, IntegrityError
from strandweave.operators.ordered import cut, next_from


def transduced(quantity: Column, threshold: Column, half: Column, most: Column) -> Column:
    """Saturating rate of what lies above a threshold: most * d / (d + half), 0 at or below it."""
    d = F.greatest(quantity - threshold, F.lit(0.0))
    return F.when(d > 0, most * d / (d + half)).otherwise(0.0)


def check_bindings(bindings: DataFrame, members: DataFrame, coupling_us: int, union: DataFrame | None = None) -> None:
    """Refuses bindings (channel, sensor, delay_us, threshold, half, most, gain, enabled) that no bus can serve.

    A channel is bound once, has members (channel, node), a delay that is a multiple of the coupling interval, and a gain of 0
    or more; no node belongs to two bound channels, and all are in ``union`` (node), where that is given.
    """

    def first(rows: DataFrame, what: str) -> None:
        bad = rows.limit(1).collect()
        if bad:
            raise IntegrityError(f"channel {bad[0]['channel']}: {what}")

    first(bindings.groupBy("channel").agg(F.count("*").alias("n")).where("n > 1"), "bound twice")
    first(bindings.where((F.col("delay_us") < 0) | (F.col("delay_us") % coupling_us != 0) | (F.col("gain") < 0)), "delay or gain out of range")
    first(bindings.join(members, "channel", "left_anti"), "no members")
    bound = members.join(bindings.select("channel"), "channel", "left_semi")
    first(bound.groupBy("node").agg(F.count_distinct("channel").alias("n"), F.min("channel").alias("channel")).where("n > 1"), "shares a node with another channel")
    if union is not None:
        first(bound.join(union.select("node"), "node", "left_anti"), "a node outside the entry union")


def channel_frames(samples: DataFrame, bindings: DataFrame) -> DataFrame:
    """(t_us, channel, quantity, rate) of each bound channel at each time of the samples (sensor, t_us, value).

    What a sensor shows at one frame (0 if nothing) arrives a delay later, at the first frame from then on; of several
    that arrive together the latest counts.  Until something has arrived, and at frames where nothing does, the channel is silent.
    """
    values = cut(samples.where("t_us is not null").groupBy("sensor", "t_us").agg(F.max("value").cast("double").alias("value")))
    times, none = values.select("t_us").distinct(), F.lit(None).cast("bigint")
    # Frames are those of all channels, so what arrives at which of them is told once for each delay.
    frames = times.select(none.alias("delay_us"), F.col("t_us").alias("at"), F.col("t_us").alias("frame"), none.alias("sent"))
    due = times.crossJoin(F.broadcast(bindings.select(F.col("delay_us").cast("bigint")).distinct())).select("delay_us", (F.col("t_us") + F.col("delay_us")).alias("at"), none.alias("frame"), F.col("t_us").alias("sent"))
    # Samples come before the frame of the same time.
    met = next_from(frames.unionByName(due).withColumn("_is", F.col("frame").isNotNull()), ["at", "_is"], "frame", "to").where("sent is not null and to is not null")
    arrived = met.groupBy("delay_us", F.col("to").alias("t_us")).agg(F.max("sent").alias("sent"))
    own = times.crossJoin(F.broadcast(bindings)).join(arrived, ["delay_us", "t_us"], "left")  # each channel has a row for each frame, as the result has
    own = own.join(values.select("sensor", F.col("t_us").alias("sent"), "value"), ["sensor", "sent"], "left").withColumn("quantity", F.coalesce("value", F.lit(0.0)))
    rate = F.when(F.col("enabled"), transduced(F.col("quantity"), F.col("threshold"), F.col("half"), F.col("most")) * F.col("gain")).otherwise(0.0)
    return own.select("t_us", "channel", "quantity", rate.alias("rate"))


def bus_frames(samples: DataFrame, bindings: DataFrame, members: DataFrame, coupling_us: int, extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What the bus injects, (t_us, node, rate) above 0, and (t_us, active, silent), the sorted channels of each frame.

    ``extra`` (t_us, node, rate) are the rates of an encoder of its own; a node that a sounding channel drives at that time is refused.
    """
    check_bindings(bindings, members, coupling_us)
    channels = channel_frames(samples, bindings)
    driven = channels.where("rate > 0").join(members.select("channel", "node").distinct(), "channel").select("t_us", "node", "rate")
    if extra is not None:
        twice = driven.join(extra, ["t_us", "node"], "left_semi").limit(1).collect()
        if twice:
            raise IntegrityError(f"node {twice[0]['node']} is driven by a channel and by another encoder")
        driven = driven.unionByName(extra.where("rate > 0").select("t_us", "node", "rate"))
    named = lambda on: F.array_sort(F.collect_set(F.when(on, F.col("channel"))))
    lists = channels.groupBy("t_us").agg(named(F.col("rate") > 0).alias("active"), named(~(F.col("rate") > 0)).alias("silent"))
    return driven, lists


def scheduled(steps: DataFrame, coupling_us: int, first: Column) -> DataFrame:
    """Steps (key, t_us, body_us, command) of agents with ``applied``: the command decoded at the end of an interval
    acts in the next one, ``first`` in the first.

    Intervals of an agent follow each other without gaps, and both clocks agree, or ``CausalityError`` is raised.
    """
    own = Window.partitionBy("key").orderBy("t_us")
    out = steps.withColumn("_before", F.lag("t_us").over(own)).withColumn("_n", F.row_number().over(own))
    out = out.withColumn("applied", F.when(F.col("_n") == 1, first).otherwise(F.lag("command").over(own)))
    bad = out.where((F.col("t_us") != F.col("body_us")) | (F.col("t_us") % coupling_us != 0) | (F.col("t_us") - F.col("_before") != coupling_us)).limit(1).collect()
    if bad:
        raise CausalityError(f"agent {bad[0]['key']} at {bad[0]['t_us']}: clocks differ or an interval is missing")
    return out.drop("_before", "_n")


def retained(events: DataFrame, last: int = 100) -> DataFrame:
    """The last events (key, t_us, ...) of each agent."""
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("t_us"), *[F.desc(c) for c in events.columns if c not in ("key", "t_us")]))
    return events.withColumn("_r", place).where(F.col("_r") <= last).drop("_r")


def run_faults(trace: DataFrame, claims: DataFrame, required: list[str], clocks: list[str]) -> DataFrame:
    """(key, fault, n) of recorded runs: trace (key, seq, t_us, state and component clocks) and claimed transitions (key, seq, t_us, state).

    ``order``: time does not strictly increase; ``clock``: a component's time is missing or differs; ``unrecorded``: a claim at a
    time without a record; ``state``: the record shows another state; ``sequence``: a completed run's claims lack the required order.
    """
    last = F.max("t_us").over(Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    rows = trace.withColumn("_last", last)
    order = rows.where(F.col("t_us") <= F.col("_last")).select("key", F.lit("order").alias("fault"))
    wrong = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col("t_us")), F.lit(c)) for c in clocks]))
    clock = rows.select("key", F.explode(wrong)).select("key", F.lit("clock").alias("fault"))
    states = trace.groupBy("key", "t_us").agg(F.max_by("state", "seq").alias("recorded"))
    met = claims.join(states.withColumn("_in", F.lit(True)), ["key", "t_us"], "left")
    unrecorded = met.where("_in is null").select("key", F.lit("unrecorded").alias("fault"))
    state = met.where((F.col("_in")) & ~F.col("recorded").eqNullSafe(F.col("state"))).select("key", F.lit("state").alias("fault"))
    wanted = F.array(*[F.lit(x) for x in required])
    listed = claims.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "state"))), lambda x: x["state"]).alias("s"))
    reached = F.aggregate("s", F.lit(0), lambda n, x: F.when(x == F.get(wanted, n), n + 1).otherwise(n))
    sequence = listed.where(reached < len(required)).select("key", F.lit("sequence").alias("fault"))
    faults = order.unionByName(clock).unionByName(unrecorded).unionByName(state).unionByName(sequence)
    return faults.groupBy("key", "fault").agg(F.count("*").alias("n"))


def accepted(variants: DataFrame, key: str, criteria: dict[str, Column]) -> DataFrame:
    """(key, criterion, passed, accepted): each criterion is an aggregate over a variant's rows; a variant is accepted if all
    hold, and a criterion that cannot be told does not."""
    held = variants.groupBy(key).agg(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in criteria.items()])
    every = F.lit(True)
    for n in criteria:
        every = every & F.col(n)
    pairs = F.array(*[F.struct(F.lit(n).alias("criterion"), F.col(n).alias("passed")) for n in criteria])
    return held.select(key, F.explode(pairs).alias("c"), every.alias("accepted")).select(key, "c.criterion", "c.passed", "accepted")
