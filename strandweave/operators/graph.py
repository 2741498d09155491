"""Directed weighted graphs: nodes(node), edges(src, dst, weight)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandweave.errors import IntegrityError
from strandweave.operators import ordered, reach
from strandweave.operators.integrity import logical_digest
from strandweave.operators.matched import gathered, matched
from strandweave.operators.ordered import cut

#: Bins whose sizes are broadcast; more are met by a shuffled join.
BROADCAST_BINS = 1 << 16
#: Numbers of a bin from which one task draws at a time.
SKIP_BLOCK = 1 << 16

# Signs of transmitters.
EXCITATORY = ("acetylcholine", "dopamine", "octopamine", "serotonin")
INHIBITORY = ("gaba", "glutamate")
UNCLEAR = "unclear"


def aggregated(rows: DataFrame, src: str, dst: str, weight: Column | None = None) -> DataFrame:
    """One edge for each ordered pair, weights (or rows) summed."""
    total = F.count("*") if weight is None else F.sum(weight)
    return rows.groupBy(F.col(src).alias("src"), F.col(dst).alias("dst")).agg(total.cast("bigint").alias("weight"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, out_weight, in_degree, in_weight); a side without edges is 0."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("out")))).alias("e"), "weight")
    is_out = F.col("e.out") == 1
    return ends.groupBy("e.node").agg(
        F.count_if(is_out).alias("out_degree"), F.coalesce(F.sum(F.when(is_out, F.col("weight"))), F.lit(0)).cast("bigint").alias("out_weight"),
        F.count_if(~is_out).alias("in_degree"), F.coalesce(F.sum(F.when(~is_out, F.col("weight"))), F.lit(0)).cast("bigint").alias("in_weight"),
    )


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    inside = nodes.select("node").distinct()
    return edges.join(inside.withColumnRenamed("node", "src"), "src", "left_semi").join(inside.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "weight")


def identity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(nodes, edges, digest) of a selected circuit: its different nodes and the edges between them, whatever the layout or order.

    The digest is that of the rows (src, dst, weight), a node being one with itself as both ends and no weight.
    """
    own = nodes.select("node").distinct()
    inside = induced(edges, own)
    rows = inside.select("src", "dst", "weight").unionByName(own.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(None).cast(edges.schema["weight"].dataType).alias("weight")))
    whole = logical_digest(rows, ["src", "dst", "weight"])
    counts = rows.agg(F.count_if(F.col("weight").isNull()).alias("nodes"), F.count_if(F.col("weight").isNotNull()).alias("edges"))
    # One row each.
    return counts.join(F.broadcast(whole.select("digest")), F.lit(True)).select("nodes", "edges", "digest")


def endpoint_status(requested: DataFrame, edges: DataFrame, kept: DataFrame) -> DataFrame:
    """(node, status): ``kept``, ``pathless`` (in the graph, but not kept) or ``unavailable``."""
    present = nodes_of(edges).withColumn("_in", F.lit(True))
    chosen = kept.select("node").distinct().withColumn("_kept", F.lit(True))
    joined = requested.select("node").distinct().join(present, "node", "left").join(chosen, "node", "left")
    return joined.select("node", F.when(F.col("_kept"), "kept").when(F.col("_in"), "pathless").otherwise("unavailable").alias("status"))


def hops(edges: DataFrame, seeds: DataFrame, limit: int, reverse: bool = False) -> DataFrame:
    """(node, hop) of all nodes within ``limit`` steps of the seeds, by layers; each layer is the
    neighbours of the last one that were not met before, read from adjacency blocks."""
    blocks = reach.adjacency(edges, reverse)
    present = nodes_of(edges)
    layers = [cut(seeds.select("node").distinct().join(present, "node", "left_semi").withColumn("hop", F.lit(0)))]
    for hop in range(1, limit + 1):
        step = reach.spread(blocks.df, layers[-1].select("node")).distinct()
        met = reduce(DataFrame.unionByName, layers)
        layer = cut(step.join(met, "node", "left_anti").withColumn("hop", F.lit(hop)))
        if layer.isEmpty():
            break
        layers.append(layer)
    blocks.drop()  # all layers are written down
    return reduce(DataFrame.unionByName, layers)


def shortest_path_circuit(edges: DataFrame, inputs: DataFrame, readouts: DataFrame, limit: int) -> DataFrame:
    """Nodes (node, hop) on shortest paths from the inputs to the first layer that holds a readout."""
    reached = hops(edges, inputs, limit)
    hit = reached.join(readouts.select("node"), "node", "left_semi").where("hop > 0")
    depth = hit.agg(F.min("hop")).first()[0]
    if depth is None:
        raise IntegrityError("no readout is reached")
    kept = layer = cut(hit.where(F.col("hop") == depth))
    for hop in range(depth - 1, -1, -1):
        before = edges.join(layer.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        layer = cut(reached.where(F.col("hop") == hop).join(before, "node", "left_semi"))
        kept = cut(kept.unionByName(layer))
    return kept


def bounded_path_circuit(edges: DataFrame, inputs: DataFrame, readouts: DataFrame, limit: int) -> DataFrame:
    """Nodes on paths of at most ``limit`` steps: distance from the inputs plus distance to the readouts."""
    forward = hops(edges, inputs, limit).withColumnRenamed("hop", "forward")
    backward = hops(edges, readouts, limit, reverse=True).withColumnRenamed("hop", "backward")
    return forward.join(backward, "node").where(F.col("forward") + F.col("backward") <= limit)


def population_path_union(edges: DataFrame, inputs: DataFrame, readouts: DataFrame, limit: int) -> DataFrame:
    """Union over the inputs of their shortest paths to any readout, plus all readouts."""
    distance = hops(edges, readouts, limit, reverse=True)
    layers = [cut(distance.join(inputs.select("node").distinct(), "node", "left_semi"))]
    downhill = edges.join(distance.select(F.col("node").alias("src"), F.col("hop").alias("_s")), "src").join(distance.select(F.col("node").alias("dst"), F.col("hop").alias("_d")), "dst")
    downhill = cut(downhill.where("_d = _s - 1").select("src", "dst", "_d"))
    kept = layers[0]
    for _ in range(limit):
        step = downhill.join(layers[-1].select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node"), F.col("_d").alias("hop")).distinct()
        layers.append(cut(step))
        kept = kept.unionByName(step)
    return kept.select("node").unionByName(readouts.select("node")).distinct()


def pair_completeness(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Per label: realised ordered pairs of ``sources`` and ``targets`` (node, label), of all possible.

    Only nodes present in the graph count.  ``completeness`` is null without
    possible pairs.  ``orphans`` are targets that no cognate source reaches;
    ``reverse_pairs`` are edges from targets to sources.
    """
    both = sources.select("node", "label", F.lit(1).alias("is_source")).unionByName(targets.select("node", "label", F.lit(0).alias("is_source"))).distinct()
    touched = edges.select(F.explode(F.array("src", "dst")).alias("node")).join(both.select("node"), "node", "left_semi").distinct()
    both = cut(both.join(touched, "node", "left_semi"))
    s, t = both.where("is_source = 1").drop("is_source"), both.where("is_source = 0").drop("is_source")
    ends = edges.join(both.select(F.col("node").alias("src"), "label", F.col("is_source").alias("_a")), "src")
    ends = ends.join(both.select(F.col("node").alias("dst"), F.col("label").alias("_l"), F.col("is_source").alias("_b")), "dst").where("label = _l and _a <> _b")
    pairs = cut(ends.select("label", "src", "dst", "weight", "_a"))
    forward = pairs.where("_a = 1")
    twice = forward.groupBy("label", "src", "dst").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise IntegrityError("duplicate edges")
    middle = ordered.quantiles(forward, ["label"], "weight", (0.5,)).select("label", F.get("q", F.lit(0)).alias("median_contacts"))
    f = forward.groupBy("label").agg(F.count("*").alias("realised"), F.sum("weight").alias("contacts"), F.count_distinct("dst").alias("reached")).join(middle, "label", "left")
    r = pairs.where("_a = 0").groupBy("label").agg(F.count("*").alias("reverse_pairs"))
    base = s.groupBy("label").agg(F.count("*").alias("sources")).join(t.groupBy("label").agg(F.count("*").alias("targets")), "label", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    out = base.join(f, "label", "left").join(r, "label", "left").select("label", *[zero(c) for c in ("sources", "targets", "realised", "contacts", "reverse_pairs", "reached")], "median_contacts")
    possible = F.col("sources") * F.col("targets")
    return out.select(
        "label", "sources", "targets", possible.alias("possible"), "realised", "contacts", "median_contacts", "reverse_pairs",
        (F.col("targets") - F.col("reached")).alias("orphans"), F.when(possible > 0, F.col("realised") / possible).alias("completeness"),
    )


def orphans(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets (node, label) in the graph that no source of their label reaches."""
    t = targets.select("node", "label").distinct().join(nodes_of(edges), "node", "left_semi")
    fed = edges.join(sources.select(F.col("node").alias("src"), "label"), "src").select(F.col("dst").alias("node"), "label").distinct()
    return t.join(fed, ["node", "label"], "left_anti")


def shares(edges: DataFrame) -> DataFrame:
    """Edges with ``share``, their part of the target's incoming weight."""
    incoming = edges.groupBy("dst").agg(F.sum("weight").alias("_in"))
    return edges.join(incoming, "dst").select("src", "dst", "weight", (F.col("weight") / F.greatest("_in", F.lit(1))).alias("share"))


def propagate(edges: DataFrame, sources: DataFrame, targets: DataFrame, steps: int) -> DataFrame:
    """(draw, group, hop, arrival): mass 1 / |S| starts on each source of a draw and moves along shares;
    arrival is its mean over a target group's members.  ``sources`` is (draw, node), ``targets`` (group, node)."""
    flow = cut(shares(edges).select("src", "dst", "share"))
    size = sources.groupBy("draw").agg(F.count("*").alias("_n"))
    state = sources.join(size, "draw").select("draw", "node", (1.0 / F.col("_n")).alias("mass"))
    members = targets.groupBy("group").agg(F.count("*").alias("_m"))
    out = []
    for hop in range(1, steps + 1):
        moved = flow.join(state, flow["src"] == state["node"]).groupBy("draw", "dst").agg(F.sum(F.col("share") * F.col("mass")).alias("mass"))
        state = cut(moved.select("draw", F.col("dst").alias("node"), "mass"))
        met = state.join(targets, "node").groupBy("draw", "group").agg(F.sum("mass").alias("_s"))
        out.append(met.join(members, "group").select("draw", "group", F.lit(hop).alias("hop"), (F.col("_s") / F.col("_m")).alias("arrival")))
    return reduce(DataFrame.unionByName, out)


def direct_share(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(group, contacts, share): what the sources give of a target group's incoming weight."""
    to = edges.join(targets.select(F.col("node").alias("dst"), "group"), "dst")
    own = F.col("_own").isNotNull()
    marked = to.join(sources.select(F.col("node").alias("src")).distinct().withColumn("_own", F.lit(True)), "src", "left")
    contacts = F.coalesce(F.sum(F.when(own, F.col("weight"))), F.lit(0))
    return marked.groupBy("group").agg(contacts.cast("bigint").alias("contacts"), (contacts / F.greatest(F.sum("weight"), F.lit(1))).alias("share"))


def matched_draws(bins: DataFrame, sources: DataFrame, draws: int, seed: str = "null") -> DataFrame:
    """(draw, node): ``draws`` samples without replacement with the sources' number of nodes in each bin.

    The order within a draw is that of md5(draw:node:seed), so any engine draws alike.
    """
    wanted = bins.join(sources.select("node").distinct(), "node", "left_semi").groupBy("bin").agg(F.count("*").alias("_want"))
    sizes = bins.groupBy("bin").agg(F.count("*").alias("_all")).join(wanted, "bin")
    # The first of a draw are among the nodes whose hash is small; of the others only few are ranked.
    share = (F.col("_want") + 8 * F.sqrt("_want") + 32) / F.col("_all")
    sizes = cut(sizes.withColumn("_share", share))
    pool = bins.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_BINS else sizes, "bin").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    pool = pool.withColumn("_k", F.md5(F.concat_ws(":", F.col("draw").cast("string"), F.col("node").cast("string"), F.lit(seed))))
    first = cut(pool.where(F.conv(F.substring("_k", 1, 8), 16, 10).cast("double") < F.col("_share") * float(1 << 32)).select("draw", "bin", "node", "_k", "_want"))
    short = sizes.select("bin", "_want", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).join(first.groupBy("draw", "bin").agg(F.count("*").alias("_n")), ["draw", "bin"], "left")
    short = cut(short.where(F.coalesce("_n", F.lit(0)) < F.col("_want")).select("draw", "bin"))
    if not short.isEmpty():  # those draws rank all of the bin
        first = first.join(short, ["draw", "bin"], "left_anti").unionByName(pool.join(short, ["draw", "bin"], "left_semi").select("draw", "bin", "node", "_k", "_want"))
    place = F.row_number().over(Window.partitionBy("draw", "bin").orderBy("_k", "node"))
    return first.withColumn("_r", place).where("_r <= _want").select("draw", "node")


def skip_draws(bins: DataFrame, sources: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """(draw, bin, node): ``draws`` random samples without replacement with the sources' number of nodes in each bin.

    Nodes are numbered within their bin once.  For each draw, the wanted number is dealt over blocks of numbers (by the
    multivariate hypergeometric law), and within a block the accepted numbers are drawn, so the work follows the samples and
    not nodes times draws.  Every set of the wanted size is as likely as any other.  A node in several bins counts in each; null bins are left out.
    """
    own = bins.where("bin is not null and node is not null").select("bin", "node").distinct()
    kind = own.schema["bin"].dataType.simpleString()
    placed = cut(ordered.positions(own, ["bin", "node"], "_at"))
    wanted = own.join(sources.select("node").distinct(), "node", "left_semi").groupBy("bin").agg(F.count("*").alias("want"))
    sizes = placed.groupBy("bin").agg(F.count("*").alias("n"), F.min("_at").alias("start")).join(wanted, "bin")
    jobs = sizes.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).repartition("bin", "draw")

    def rng_of(*key: int) -> np.random.Generator:
        return np.random.default_rng([seed, *(k % (1 << 63) for k in key)])

    def dealt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                blocks = np.minimum(SKIP_BLOCK, r.n - np.arange(0, r.n, SKIP_BLOCK))
                counts = rng_of(r.draw, r.start).multivariate_hypergeometric(blocks, r.want, method="marginals")
                at = np.flatnonzero(counts)
                yield pd.DataFrame({"draw": r.draw, "begin": r.start + at * SKIP_BLOCK, "size": blocks[at], "count": counts[at]})

    def accepted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                own = np.sort(rng_of(r.draw, r.begin, 1).choice(r.size, r.count, replace=False, shuffle=False))
                yield pd.DataFrame({"draw": r.draw, "_at": r.begin + own})

    blocks = jobs.select("draw", "start", "n", "want").mapInPandas(dealt, "draw int, begin bigint, size bigint, count bigint")
    drawn = blocks.repartition("draw", "begin").mapInPandas(accepted, "draw int, _at bigint")
    return drawn.join(placed, "_at").select("draw", F.col("bin").cast(kind).alias("bin"), "node")


def null_ratio(observed: DataFrame, null: DataFrame, group: list[str], value: str) -> DataFrame:
    """Observed value against the draws: ratio to their median, and percentile."""
    one = observed.select(*group, F.col(value).alias("observed"))
    joined = null.join(one, group)
    out = joined.groupBy(*group, "observed").agg(F.median(value).alias("null_median"), (100.0 * F.avg((F.col(value) < F.col("observed")).cast("double"))).alias("percentile"))
    ratio = F.when(F.col("null_median") > 0, F.col("observed") / F.col("null_median")).when(F.col("observed") > 0, F.lit(float("inf"))).otherwise(0.0)
    return out.withColumn("ratio", ratio)


def signs(labels: DataFrame, policy: str = "zero", seed: str = "sign") -> DataFrame:
    """(node, sign, known) from (node, label) rows; several concrete labels of one node are an error.

    Unresolved nodes get 0, 1, -1 or, by policy ``seeded``, the parity of a hash.
    """
    label = F.coalesce(F.lower("label"), F.lit(UNCLEAR))
    concrete = F.when(label.isin(*EXCITATORY, *INHIBITORY), label)
    per = labels.groupBy("node").agg(F.count_distinct(concrete).alias("_k"), F.max(concrete).alias("_label"))
    if per.where("_k > 1").limit(1).collect():
        raise IntegrityError("conflicting labels for one node")
    return per.select("node", resolved_sign(F.col("_label"), F.col("node"), policy, seed).cast("int").alias("sign"), F.col("_label").isNotNull().alias("known"))


def resolved_sign(label: Column, node: Column, policy: str, seed: str = "sign") -> Column:
    parity = F.conv(F.substring(F.md5(F.concat_ws(":", node.cast("string"), F.lit(seed))), 1, 1), 16, 10).cast("int") % 2
    rest = {"zero": F.lit(0), "excitatory": F.lit(1), "inhibitory": F.lit(-1), "seeded": F.when(parity == 0, 1).otherwise(-1)}[policy]
    return F.when(label.isin(*EXCITATORY), 1).when(label.isin(*INHIBITORY), -1).otherwise(rest)


def signed_composition(edges: DataFrame, sign: DataFrame) -> DataFrame:
    """Per target: excitatory, inhibitory and net incoming weight, and which prevails."""
    e = edges.join(sign.select(F.col("node").alias("src"), "sign"), "src")
    plus, minus = F.sum(F.when(F.col("sign") > 0, F.col("weight")).otherwise(0)), F.sum(F.when(F.col("sign") < 0, F.col("weight")).otherwise(0))
    out = e.groupBy(F.col("dst").alias("node")).agg(plus.cast("bigint").alias("excitatory"), minus.cast("bigint").alias("inhibitory"))
    net = F.col("excitatory") - F.col("inhibitory")
    return out.withColumn("net", net).withColumn("label", F.when(net > 0, "excitatory").when(net < 0, "inhibitory").otherwise("balanced"))


def delivered_drive(edges: DataFrame, sign: DataFrame, counts: DataFrame) -> DataFrame:
    """Per target: weight times sign times the source's events, split by sign, with active sources and the static net."""
    e = edges.join(sign.select(F.col("node").alias("src"), "sign"), "src").join(counts.select(F.col("node").alias("src"), F.col("n").alias("_n")), "src", "left")
    n = F.coalesce("_n", F.lit(0))
    d = F.col("weight") * F.col("sign") * n
    out = e.withColumn("_d", d).withColumn("_active", n > 0).groupBy(F.col("dst").alias("node")).agg(
        F.sum(F.when(F.col("_d") > 0, F.col("_d")).otherwise(0)).cast("bigint").alias("plus"),
        F.sum(F.when(F.col("_d") < 0, F.col("_d")).otherwise(0)).cast("bigint").alias("minus"),
        F.count_if("_active").alias("active_sources"), F.count("*").alias("sources"),
        F.sum(F.col("weight") * F.col("sign")).cast("bigint").alias("static_net"),
    )
    return out.withColumn("agrees", F.signum(F.col("plus") + F.col("minus")) == F.signum("static_net"))


def fanout_delivery(edges: DataFrame, events: DataFrame) -> DataFrame:
    """Weight delivered to each target by (t, node) events, per t."""
    return events.join(edges, events["node"] == edges["src"]).groupBy("t", F.col("dst").alias("node")).agg(F.sum("weight").alias("delivered"))


def type_pairs(edges: DataFrame, source_labels: DataFrame, target_labels: DataFrame) -> DataFrame:
    """Edges with the labels of both ends, matched once for each node."""
    a = source_labels.select(F.col("node").alias("src"), F.col("label").alias("src_type"))
    b = target_labels.select(F.col("node").alias("dst"), F.col("label").alias("dst_type"))
    return edges.join(a, "src").join(b, "dst")


def scaled(pairs: DataFrame, scales: DataFrame, fallback: float) -> DataFrame:
    """Adds ``multiplier``: the type pair's scale over the fallback, which holds where there is none."""
    joined = pairs.join(scales, ["src_type", "dst_type"], "left")
    return joined.withColumn("multiplier", F.coalesce("scale", F.lit(fallback)) / fallback).drop("scale")


def functional_weights(edges: DataFrame, sign: DataFrame, scale: float, multiplier: str | None = None) -> DataFrame:
    """(src, dst, value): weight times the source's sign times the edge's multiplier times the scale; sources without a sign give
    nothing.  A multiplier that is null, not finite or below 0 is refused."""
    m = F.col(multiplier).cast("double") if multiplier else F.lit(1.0)
    if multiplier:
        good = F.coalesce((m >= 0) & (m < float("inf")) & ~F.isnan(m), F.lit(False))
        if edges.where(~good).limit(1).collect():
            raise IntegrityError("multipliers are finite and at least 0")
    joined = edges.join(sign.select(F.col("node").alias("src"), F.col("sign").alias("_sign")), "src", "left")
    return joined.select("src", "dst", (F.col("weight") * F.coalesce("_sign", F.lit(0)) * m * scale).alias("value"))


def uniform_weights(edges: DataFrame) -> DataFrame:
    """Every weight the rounded (half to even) median, at least 1."""
    one = ordered.quantiles(edges, [], "weight", (0.5,)).select(F.greatest(F.bround(F.get("q", F.lit(0))), F.lit(1.0)).cast("bigint").alias("weight"))
    return edges.select("src", "dst").join(F.broadcast(one))


def dropout(edges: DataFrame, k: int) -> DataFrame:
    return edges.where(F.col("weight") > k)


def silenced(edges: DataFrame, sources: DataFrame) -> DataFrame:
    return edges.join(sources.select(F.col("node").alias("src")), "src", "left_anti").select("src", "dst", "weight")


def type_only(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Every member pair of each observed type pair, with the rounded mean weight; unlabelled nodes are their own type."""
    typed = cut(nodes_of(edges).join(labels, "node", "left").select("node", F.coalesce(F.nullif("label", F.lit("")), F.concat(F.lit("node:"), F.col("node").cast("string"))).alias("label")))
    pairs = type_pairs(edges, typed, typed).groupBy("src_type", "dst_type").agg(F.greatest(F.bround(F.avg("weight")), F.lit(1.0)).cast("bigint").alias("weight"))
    # A pair of types is given its members on the side that has fewer; those, and the members of the other type, are many rows of few keys.
    sizes = typed.groupBy("label").agg(F.count("*").alias("n"))
    size = lambda side: sizes.select(F.col("label").alias(f"{side}_type"), F.col("n").alias(f"_{side}"))
    fewer = F.col("_src") <= F.col("_dst")
    own = pairs.join(size("src"), "src_type").join(size("dst"), "dst_type").select(
        fewer.alias("_from"), F.when(fewer, F.col("src_type")).otherwise(F.col("dst_type")).alias("_few"), F.when(fewer, F.col("dst_type")).otherwise(F.col("src_type")).alias("label"), "weight"
    )
    members = own.join(typed.select(F.col("label").alias("_few"), F.col("node").alias("_one")), "_few").drop("_few")
    met = matched(members, gathered(typed, ["label"], "node"), ["label"], F.size("node")).select("_from", "_one", "weight", F.explode("node").alias("node"))
    src, dst = F.when(F.col("_from"), F.col("_one")).otherwise(F.col("node")), F.when(F.col("_from"), F.col("node")).otherwise(F.col("_one"))
    return met.select(src.alias("src"), dst.alias("dst"), "weight").where("src <> dst")


def _dealt_anew(edges: DataFrame, column: str, seed: str) -> DataFrame:
    """Edges with ``column`` permuted over the whole table: the k-th edge in order gets that of the k-th one by hash."""
    rows = cut(edges.select("src", "dst", "weight").withColumn("_k", F.md5(F.concat_ws(":", "src", "dst", F.lit(seed)))))
    left = ordered.positions(rows.drop("_k"), ["src", "dst", "weight"]).drop(column)
    right = ordered.positions(rows.select("_k", "src", "dst", column), ["_k", "src", "dst", column]).select("position", column)
    return left.join(right, "position").select("src", "dst", "weight")


def shuffled_targets(edges: DataFrame, seed: str = "shuffle") -> DataFrame:
    """Targets permuted over all edges: sources keep their number of edges, targets theirs, weights stay with the source."""
    return _dealt_anew(edges, "dst", seed)


def permuted_weights(edges: DataFrame, seed: str = "weights") -> DataFrame:
    """Weights permuted over all edges."""
    return _dealt_anew(edges, "weight", seed)


def preservation(before: DataFrame, after: DataFrame) -> DataFrame:
    """(property, preserved, moved) of a control: edge count, out-degrees, in-degrees and weights, each with the number
    of edges whose target or weight is not the one of before (as bags of edges)."""
    sides = before.select("src", "dst", "weight", F.lit(1).alias("side")).unionByName(after.select("src", "dst", "weight", F.lit(-1).alias("side")))
    sides = cut(sides.groupBy("src", "dst", "weight").agg(F.sum("side").alias("gap")))
    moved = F.sum(F.greatest("gap", F.lit(0))).alias("moved")

    def check(name: str, key: list[str]) -> DataFrame:
        gaps = sides.groupBy(*key).agg(F.sum("gap").alias("own"), moved)
        return gaps.agg(F.lit(name).alias("property"), F.coalesce(F.max(F.abs("own")) == 0, F.lit(True)).alias("preserved"), F.coalesce(F.sum("moved"), F.lit(0)).cast("bigint").alias("moved"))

    return reduce(DataFrame.unionByName, [check("edge_count", []), check("out_degree", ["src"]), check("in_degree", ["dst"]), check("weights", ["weight"])])


def depressing(pairs: DataFrame, rules: list[dict]) -> DataFrame:
    """Adds ``rule`` and ``utilisation``: the first rule whose source prefix and target regex fit (null: not depressing)."""
    rule, use = F.lit(None).cast("string"), F.lit(None).cast("double")
    for r in reversed(rules):
        fits = F.col("src_type").startswith(r["source_prefix"]) & F.col("dst_type").rlike(r["target_regex"])
        if r.get("same_label"):
            fits = fits & (F.substring("src_type", -r["same_label"], r["same_label"]) == F.substring("dst_type", -r["same_label"], r["same_label"]))
        rule, use = F.when(fits, F.lit(r["id"])).otherwise(rule), F.when(fits, F.lit(float(r["utilisation"]))).otherwise(use)
    return pairs.withColumn("rule", rule).withColumn("utilisation", use)


def universes(edges: DataFrame, status: DataFrame, sets: list[tuple[str, tuple[str, ...] | None]]) -> DataFrame:
    """Per node universe (None: all nodes): edges and weight with both ends inside, and their part of all."""
    e = edges.join(status.select(F.col("node").alias("src"), F.col("status").alias("_a")), "src", "left").join(status.select(F.col("node").alias("dst"), F.col("status").alias("_b")), "dst", "left")
    inside = [F.lit(True) if m is None else F.coalesce(F.col("_a").isin(*m) & F.col("_b").isin(*m), F.lit(False)) for _, m in sets]
    one = e.agg(*[x for i, mask in enumerate(inside) for x in (F.count_if(mask).alias(f"e{i}"), F.coalesce(F.sum(F.when(mask, F.col("weight"))), F.lit(0)).cast("bigint").alias(f"w{i}"))])
    rows = F.array(*[F.struct(F.lit(name).alias("universe"), F.col(f"e{i}").alias("edges"), F.col(f"w{i}").alias("contacts"), (F.col(f"w{i}") / F.col("w0")).alias("fraction")) for i, (name, _) in enumerate(sets)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def sided_profile(edges: DataFrame, sides: DataFrame) -> DataFrame:
    """Per target: sources, realised pairs, contacts, mean per pair and completeness of each side, and their log2 ratio.

    ``sides`` is (node, side) with sides L and R; means are null without pairs.
    """
    sizes = sides.groupBy().agg(F.count_if(F.col("side") == "L").alias("n_l"), F.count_if(F.col("side") == "R").alias("n_r"))
    e = edges.join(sides.select(F.col("node").alias("src"), "side"), "src")
    left, right = F.col("side") == "L", F.col("side") == "R"
    per = e.groupBy(F.col("dst").alias("node")).agg(
        F.count_if(left).alias("pairs_l"), F.count_if(right).alias("pairs_r"),
        F.coalesce(F.sum(F.when(left, F.col("weight"))), F.lit(0)).cast("bigint").alias("contacts_l"),
        F.coalesce(F.sum(F.when(right, F.col("weight"))), F.lit(0)).cast("bigint").alias("contacts_r"),
    )
    per = per.join(F.broadcast(sizes))
    mean = lambda s: F.when(F.col(f"pairs_{s}") > 0, F.col(f"contacts_{s}") / F.col(f"pairs_{s}"))
    full = lambda s: F.when(F.col(f"n_{s}") > 0, F.col(f"pairs_{s}") / F.col(f"n_{s}"))
    out = per.withColumns({"mean_l": mean("l"), "mean_r": mean("r"), "complete_l": full("l"), "complete_r": full("r")}).drop("n_l", "n_r")
    return out.withColumn("log2_ratio", F.when((F.col("mean_l") > 0) & (F.col("mean_r") > 0), F.log2(F.col("mean_l") / F.col("mean_r"))))


def convergence_profile(pairs: DataFrame) -> DataFrame:
    """Per target of labelled pairs (dst, label, weight): sources, total, min, median and max contacts."""
    return pairs.groupBy("dst", "label").agg(
        F.count("*").alias("sources"), F.sum("weight").cast("bigint").alias("total"), F.min("weight").alias("least"), F.median("weight").alias("median"), F.max("weight").alias("most")
    )


def rollup(profile: DataFrame) -> DataFrame:
    """Per label: targets, mean of source counts, median of medians, mean of totals.

    The median is taken over range partitions, so a label may have any number of targets.
    """
    own = cut(profile.select("label", "sources", "median", "total"))
    middle = ordered.quantiles(own, ["label"], "median", (0.5,)).select(F.col("label").alias("_label"), F.get("q", F.lit(0)).alias("median_of_medians"))
    means = own.groupBy("label").agg(F.count("*").alias("targets"), F.avg("sources").alias("mean_sources"), F.avg("total").alias("mean_total"))
    return means.join(middle, means["label"].eqNullSafe(middle["_label"]), "left").select("label", "targets", "mean_sources", "median_of_medians", "mean_total")


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)
