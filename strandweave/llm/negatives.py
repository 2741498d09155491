"""Hard-negative mining over a table of pivot distances.

A last component is added to every row, so that all rows have one norm R, and a 0 to
every anchor: their Euclidean distance d then holds the inner product, which is
(R^2 + |anchor|^2 - d^2) / 2.  The distances of all rows and anchors from a few pivots are
stored once.  By the triangle inequality, the largest difference and the least sum of the
two distances from a pivot bracket d, and so bracket the score: only pairs whose bracket
meets what is sought are scored exactly.

Rows are dealt into blocks of bounded size, whatever their label or vector, and stay where
they are: all anchors, far fewer, are sent past each block.  A first pass finds each
anchor's positives, a second one, with their scores, the negatives; blocks give their best
few rows and the best of those are taken over all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandweave.llm._common import cut, shuffle_partitions

PIVOTS = 16
#: Pivots are chosen among so many rows of smallest hash; every row is in the table whatever they are.
PIVOT_SAMPLE = 2048
#: Bytes of vectors and pivot distances that a block may take up in memory, and of one matrix of brackets.
BLOCK_BYTES = 128 << 20
TILE_BYTES = 8 << 20
ANCHORS_AT_ONCE = 64
#: Above all ids: rows without an id come last among ties.
_NO_ID = 2**63 - 1


def prepared(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int | None = None) -> DataFrame:
    """(id, label, v) of the rows that take part: label and vector are not null, all components finite; v has floor(scale * component) as double."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf")))
    whole = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), v.alias("v")).where(F.col("label").isNotNull() & F.col("v").isNotNull() & ~odd)
    return whole if scale is None else whole.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))


@dataclass
class Shape:
    """What all tasks must agree on: number and length of the vectors, their largest squared norm, and the pivots with their last component."""

    count: int
    width: int
    square: float
    pivots: np.ndarray

    @property
    def exact(self) -> type:
        """A float type in which all scores, and all sums on the way to them, are exact."""
        return np.float32 if self.square < 2**24 else np.float64

    @property
    def slack(self) -> float:
        """More than what a score gains or loses as distances are stored in 32 bits."""
        return 1 + 4e-6 * self.square

    def distances(self, vectors: np.ndarray, anchors: bool) -> np.ndarray:
        squares = np.einsum("ij,ij->i", vectors, vectors)
        last = np.zeros(len(vectors)) if anchors else np.sqrt(np.maximum(self.square - squares, 0))
        inner = vectors @ self.pivots[:, :-1].T + last[:, None] * self.pivots[:, -1]
        norms = squares + last * last
        return np.sqrt(np.maximum(norms[:, None] + np.einsum("ij,ij->i", self.pivots, self.pivots) - 2 * inner, 0)).astype(np.float32)


def spread(points: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` different points, each the farthest from those before it; the first is the farthest from their mean."""
    if not len(points):
        return points
    gap = ((points - points.mean(0)) ** 2).sum(1)
    chosen: list[int] = []
    while len(chosen) < count:
        best = int(gap.argmax())
        if chosen and gap[best] <= 0:
            break
        chosen.append(best)
        own = ((points - points[best]) ** 2).sum(1)
        gap = own if len(chosen) == 1 else np.minimum(gap, own)
    return points[chosen]


def shape_of(rows: DataFrame, pivots: int = PIVOTS) -> Shape:
    """Number, length, largest norm and pivots; vectors of other lengths count as filled up with zeros."""
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    count, width, square = rows.agg(F.count("*"), F.max(F.size("v")), F.max(norm)).first()
    if not count:
        return Shape(0, 0, 0.0, np.zeros((1, 1)))
    if square >= 2**53:
        raise ValueError("squared norms of 2**53 and more have no exact score here; use a smaller scale")
    sample = rows.select("v", F.xxhash64("id", "label", "v").alias("h")).orderBy("h").limit(PIVOT_SAMPLE).collect()
    points = np.zeros((len(sample), width + 1))
    for k, r in enumerate(sample):
        points[k, : len(r["v"])] = r["v"]
    points[:, -1] = np.sqrt(np.maximum(square - (points[:, :-1] ** 2).sum(1), 0))
    return Shape(count, width, float(square), spread(points, pivots))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


_STORED = "row bigint, block int, id bigint, label bigint, is_anchor boolean, v binary, rows_far binary, anchor_far binary"


def pivot_table(rows: DataFrame, shape: Shape, anchor: Column, blocks: int) -> DataFrame:
    """The written table of all different rows: number, block, id, label, vector and distances from the pivots, as a row and, for anchors, as an anchor."""
    own = rows.withColumn("is_anchor", F.coalesce(anchor, F.lit(False))).dropDuplicates(["id", "label", "v"])
    own = own.select(F.monotonically_increasing_id().alias("row"), "id", "label", "is_anchor", "v")
    own = own.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    kind = shape.exact

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), shape.width)
            anchors = np.flatnonzero(batch.column("is_anchor").to_numpy(zero_copy_only=False))
            far = [x.tobytes() for x in shape.distances(v, False)]
            near: list[bytes | None] = [None] * len(far)
            for k, x in zip(anchors, shape.distances(v[anchors], True), strict=True):
                near[k] = x.tobytes()
            columns = [*(batch.column(c) for c in ("row", "block", "id", "label", "is_anchor")), *(pa.array(x, pa.binary()) for x in ([x.tobytes() for x in v.astype(kind)], far, near))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "block", "id", "label", "is_anchor", "v", "rows_far", "anchor_far"])

    return cut(own.mapInArrow(run, _STORED))


@dataclass
class Part:
    """Rows of one block, or some anchors, as arrays."""

    row: np.ndarray
    id: np.ndarray
    label: np.ndarray
    v: np.ndarray
    far: np.ndarray

    def take(self, at: np.ndarray | slice) -> Part:
        return Part(self.row[at], self.id[at], self.label[at], self.v[at], self.far[at])


def _part(batches: list[pa.RecordBatch], shape: Shape) -> Part:
    whole = pa.Table.from_batches(batches).combine_chunks()
    number = [whole.column(c).to_numpy() for c in ("row", "id", "label")]
    matrix = lambda c, kind, w: np.frombuffer(b"".join(whole.column(c).to_pylist()), kind).reshape(whole.num_rows, w)
    return Part(*number, matrix("v", shape.exact, shape.width), matrix("far", np.float32, len(shape.pivots)))


def brackets(anchors: Part, rows: Part, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Bounds from below and above of the scores of all anchors (down) with all rows (across)."""
    least = np.zeros((len(anchors.row), len(rows.row)), np.float32)
    most = np.full_like(least, np.inf)
    for j in range(len(shape.pivots)):
        a, r = anchors.far[:, j, None], rows.far[None, :, j]
        np.maximum(least, np.abs(a - r), out=least)
        np.minimum(most, a + r, out=most)
    square = (anchors.v.astype(np.float64) ** 2).sum(1)[:, None] + shape.square
    return ((square - most.astype(np.float64) ** 2) / 2 - shape.slack, (square - least.astype(np.float64) ** 2) / 2 + shape.slack)


def scored(anchors: Part, rows: Part, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Exact scores of the pairs (a, r); where they are most of all pairs, from one product of matrices."""
    if 4 * len(a) > len(anchors.row) * len(rows.row):
        return (anchors.v @ rows.v.T)[a, r].astype(np.int64)
    out = np.empty(len(a), np.int64)
    for k in range(0, len(a), 1 << 16):
        out[k : k + (1 << 16)] = np.einsum("ij,ij->i", anchors.v[a[k : k + (1 << 16)]], rows.v[r[k : k + (1 << 16)]])
    return out


def _first(count: int, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of the first ``count`` of each group, by falling score and rising id."""
    order = np.lexsort((ids, -score, group))
    sorted_group = group[order]
    start = np.flatnonzero(np.append(True, sorted_group[1:] != sorted_group[:-1])) if len(order) else np.zeros(0, np.int64)
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[place < count]


def block_positives(anchors: Part, rows: Part, shape: Shape, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, id, score) of the best ``count`` other rows of each anchor's label; ``rows`` are sorted by label."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for label in np.unique(anchors.label):
        lo, hi = np.searchsorted(rows.label, [label, label + 1])
        mine = np.flatnonzero(anchors.label == label)
        own = anchors.take(mine)
        step = max(count + 1, TILE_BYTES // (8 * len(mine)))
        for at in range(lo, hi, step):
            tile = rows.take(slice(at, min(hi, at + step)))
            other = own.row[:, None] != tile.row[None, :]
            _, above = brackets(own, tile, shape)
            above[~other] = -np.inf
            if len(tile.row) > 4 * count:
                # The rows of the highest bounds first: what their scores exceed need not be scored.
                likely = np.argpartition(-above, 2 * count, axis=1)[:, : 2 * count]
                a = np.repeat(np.arange(len(mine)), 2 * count)
                exact = scored(own, tile, a, likely.ravel()).reshape(likely.shape).astype(np.float64)
                exact[~np.isfinite(np.take_along_axis(above, likely, 1))] = -np.inf
                floor = -np.partition(-exact, count - 1, axis=1)[:, count - 1]
                a, r = np.nonzero((above >= floor[:, None]) & other)
            else:
                a, r = np.nonzero(other)
            score = scored(own, tile, a, r)
            best = _first(count, a, score, tile.id[r])
            found.append((mine[a[best]], tile.id[r[best]], score[best]))
    return _best(found, count)


def _best(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    group, ids, score = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
    best = _first(count, group, score, ids)
    return group[best], ids[best], score[best]


def block_negatives(anchors: Part, wanted: list[np.ndarray], rows: Part, shape: Shape, count: int, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, place of the positive, id, score) of the best ``count`` rows of other labels with a score in
    [positive * low / high, positive], for each score of a positive in ``wanted``."""
    low, high = share
    most = max((len(w) for w in wanted), default=0)
    table = np.full((len(wanted), most), -1, np.int64)  # a negative score leaves no room for a negative
    for k, w in enumerate(wanted):
        table[k, : len(w)] = w
    top, bottom = table.max(1, initial=-1), np.where(table >= 0, table, np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max) * (low / high)
    own_at = np.flatnonzero(top >= 0)
    own, top, bottom, table = anchors.take(own_at), top[own_at], bottom[own_at], table[own_at]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, TILE_BYTES // (8 * max(1, len(own_at))))
    for at in range(0, len(rows.row) if len(own_at) else 0, step):
        tile = rows.take(slice(at, at + step))
        below, above = brackets(own, tile, shape)
        a, r = np.nonzero((below <= top[:, None]) & (above >= bottom[:, None]) & (own.label[:, None] != tile.label[None, :]))
        score = scored(own, tile, a, r)
        for k in range(most):
            limit = table[a, k]
            fit = np.flatnonzero((limit >= 0) & (high * score <= high * limit) & (high * score >= low * limit))
            best = fit[_first(count, a[fit], score[fit], tile.id[r[fit]])]
            found.append((own_at[a[best]] * most + k, tile.id[r[best]], score[best]))
    group, ids, score = _best(found, count)
    return group // max(1, most), group % max(1, most), ids, score


def _past_blocks(table: DataFrame, anchors: DataFrame, blocks: int, shape: Shape, schema: str, work) -> DataFrame:
    """``work(anchors, scores of each one's positives, rows of a block sorted by label)`` for every block and all anchors, some at a time."""
    columns = ["row", "id", "label", "v", "far", "wanted"]
    none = F.lit(None).cast("array<bigint>")
    rows = table.select("block", F.lit(0).alias("kind"), "row", "id", "label", "v", F.col("rows_far").alias("far"), none.alias("wanted"))
    sent = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), *columns)
    dealt = rows.unionByName(sent).withColumn("id", F.coalesce("id", F.lit(_NO_ID))).repartitionById(blocks, "block").sortWithinPartitions("block", "kind", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        block: Part | None = None
        for batch in batches:
            # One partition is one block: its rows come first, then the anchors.
            rows = int(np.searchsorted(batch.column("kind").to_numpy(), 1))
            if rows:
                held.append(batch.slice(0, rows))
            for at in range(rows, batch.num_rows, ANCHORS_AT_ONCE):
                if block is None and held:
                    block, held = _part(held, shape), []
                if block is not None:
                    piece = batch.slice(at, ANCHORS_AT_ONCE)
                    wanted = [np.array(w or [], np.int64) for w in piece.column("wanted").to_pylist()]
                    yield work(_part([piece], shape), wanted, block)

    return dealt.mapInArrow(run, schema)


def mine(
    rows: DataFrame, anchor: Column, id_col: str = "id", vector_col: str = "v", label_col: str = "label", positives: int = 5, negatives: int = 5,
    share: tuple[int, int] = (80, 100), scale: int | None = None, pivots: int = PIVOTS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and each of its positives.

    Scores are inner products of vectors of whole numbers (``scale`` makes them so by floor(scale * component)); higher ones come
    first, ties by smaller id.  ``anchor`` is a condition on the columns id, label and v.  An anchor's positives are its first
    ``positives`` other rows of the same label; their negatives the first ``negatives`` rows of another label with
    ``share[0] * positive_score <= share[1] * negative_score <= share[1] * positive_score``.  Fewer are given where there are fewer.

    Rows with a null label, a null vector or a component that is null or not finite take no part.  A shorter vector counts as
    filled up with zeros.  Rows that are alike in id, label and vector count once; rows that share no more than the id are rows of
    their own.  Rows without an id come last among ties, and are anchors only if ``anchor`` says so.  An empty table gives an empty
    one.  Other columns are not used.  Squared norms of 2**53 and more are an error, since no score would be exact.
    """
    spark = rows.sparkSession
    known = prepared(rows, id_col, vector_col, label_col, scale)
    shape = shape_of(known, pivots)
    each = 8 * (shape.width + len(shape.pivots))
    blocks = max(shuffle_partitions(spark), -(-shape.count * each // BLOCK_BYTES))
    table = pivot_table(known, shape, anchor, blocks)
    anchors = table.where("is_anchor").select("row", "id", "label", "v", F.col("anchor_far").alias("far"))

    def first_pass(own: Part, _: list[np.ndarray], block: Part) -> pa.RecordBatch:
        a, ids, score = block_positives(own, block, shape, positives)
        return pa.RecordBatch.from_arrays([pa.array(own.row[a]), pa.array(ids), pa.array(score)], names=["row", "id", "score"])

    near = _past_blocks(table, anchors.withColumn("wanted", F.lit(None).cast("array<bigint>")), blocks, shape, "row bigint, id bigint, score bigint", first_pass)
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), "id"))
    best = cut(near.withColumn("k", place - 1).where(F.col("k") < positives))
    wanted = best.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "score"))), lambda x: x["score"]).alias("wanted"))

    def second_pass(own: Part, scores: list[np.ndarray], block: Part) -> pa.RecordBatch:
        a, k, ids, score = block_negatives(own, scores, block, shape, negatives, share)
        return pa.RecordBatch.from_arrays([pa.array(own.row[a]), pa.array(k.astype(np.int32)), pa.array(ids), pa.array(score)], names=["row", "k", "negative", "negative_score"])

    hard = _past_blocks(table, anchors.join(wanted, "row"), blocks, shape, "row bigint, k int, negative bigint, negative_score bigint", second_pass)
    rank = F.row_number().over(Window.partitionBy("row", "k").orderBy(F.col("negative_score").desc(), "negative"))
    hard = hard.withColumn("rank", rank).where(F.col("rank") <= negatives)
    names = table.where("is_anchor").select("row", F.col("id").alias("anchor"))
    known_id = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return hard.join(best.select("row", "k", F.col("id").alias("positive"), F.col("score").alias("positive_score")), ["row", "k"]).join(names, "row").select(
        F.col("anchor").alias("anchor_id"), known_id("positive").alias("positive_id"), "rank", known_id("negative").alias("negative_id"), "positive_score", "negative_score"
    )
