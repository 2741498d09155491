"""Connected components of an edge table by contraction within tasks and alternating stars between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm._common import cut

#: Edges that one task contracts.
TASK_EDGES = 1_000_000


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with ``m``, the least of u and all its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("m", "u").alias("m"))
    return edges.join(least, edges["u"] == least["_u"]).drop("_u")


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes other than the least of their component among the edges (a, b), and that least one."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = back[: len(a)], back[len(a) :]
    label = np.arange(len(nodes))
    while True:
        p, q = label[i], label[j]
        apart = p != q
        if not apart.any():
            break
        p, q = p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label = label[label]
    hung = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[hung], nodes[label[hung]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [np.zeros((2, 0), np.int64)]
    parts += [np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)]) for batch in batches]
    u, v = stars(*np.concatenate(parts, axis=1))
    for k in range(0, len(u), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(u[k : k + 100_000]), pa.array(v[k : k + 100_000])], names=["u", "v"])


def components(edges: DataFrame, rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """Rows (node, component) of all nodes of the edges (a, b), 64-bit integers; the component is its least node.

    ``edges`` should be cheap to read twice.  About ``task_edges`` edges form a task, which replaces them
    by stars around the least nodes that it knows.  Where there are several tasks, rounds follow that
    hang larger neighbours on the least one, then join what is left; they end when every component is
    a star.  Null ends are left out.  Raises ``RuntimeError`` if ``rounds`` do not suffice.
    """
    pairs = edges.where("a is not null and b is not null and a <> b").select(F.col("a").cast("bigint"), F.col("b").cast("bigint"))
    tasks = max(1, -(-pairs.count() // task_edges))
    pairs = cut(pairs.coalesce(tasks).mapInArrow(_contracted, "u bigint, v bigint"))
    ended, seen = pairs.rdd.getNumPartitions() == 1, None
    for _ in range(rounds):
        if ended:
            break
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _with_least(large)
        small = small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        pairs = cut(small.where("u <> v").distinct())
        state = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        ended, seen = state == seen, state
    if not ended:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)
