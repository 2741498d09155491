"""Similarity join of documents on their sets of five-word shingles.

1.  Equal sets form one class; only classes are compared further, however many
    documents they hold.
2.  Shingles found in many classes are frequent.  Their marks are kept in a bitmap
    of fixed size, so a few rare shingles may be marked too; that costs time, not
    links, because any fixed division into the two kinds is right.
3.  Shingles are ordered, rare ones first.  A class's prefix is extended until no
    set that is similar enough can avoid it: rare shingles are indexed singly; the
    frequent ones are dealt into small hash ranges and indexed as pairs within a
    range, where a range of m shingles counts m - 1 towards the prefix.
4.  Classes with a common index entry are candidates.  First each class is verified
    against hubs: the class that an entry's classes have most to do with, such as the
    text that all copies were made from; then, for some rounds, against neighbours
    from other components in a random order.  That links groups of near copies without pairing them all.  At last
    all candidate pairs that are still in different components are verified, but for
    those whose number of common entries is too small for their sizes.  Classes are dealt into
    blocks; what is sent for a pair of blocks is the lists with members in both, and one product
    of matrices counts the common entries of all its pairs.  They are verified by pairs of blocks
    too, so that a set is sent once for each block that it is compared with.

Classes are named by 64 bits of a 128-bit key; names that two keys share are found and
replaced by the other half, so classes are told apart by 128 bits.  Verification compares
whole shingle sets, by the upper 48 bits of their 64-bit hashes: over c comparisons of sets of n
and m shingles, n * m * c / 2**48 false common shingles are expected, each of which counts only
where a pair is one shingle short of a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandweave.llm._common import cut, pieces_by_bytes, release, shuffle_partitions, utf8_of
from strandweave.llm._words import LOWER, mixed, runs, words_of
from strandweave.llm.components import components

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A shingle is frequent if it is counted this often in the classes of batches that hold it at least twice.
FREQUENT = 8
#: Bits of the bitmap of frequent shingles, and of each part of it that one task fills.
BITMAP_BITS, PART_BITS = 26, 18
#: Bytes of shingles that are counted by one task, and of index entries that meet in one, about.
PART_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
#: Frequent shingles in one range, on average.
RANGE = 3
#: An entry that so many classes of one batch have is dealt over several buckets.
HOT = 1024
#: Rounds of comparison with neighbours, and neighbours of each class in a round.
ROUNDS, NEIGHBOURS = 3, 1
#: Members of a list that are put in one order.
ORDERED = 65_536
#: Sets that one task compares with one other at a time.
CHUNK = 64
#: Classes in a block, and bytes of their sets, about.
BLOCK, BLOCK_BYTES = 256, 4 << 20
#: Bytes of sets or pairs that one task holds before it passes them on.
HELD_BYTES = 16 << 20
#: Lists whose common members are counted by one product of matrices, and members of lists that are looked at together.
LISTS, MEMBERS = 4096, 200_000
#: More clashing keys than this point to broken hashes.
MAX_CLASHES = 100_000
#: Most classes, and comparisons of classes, that are broadcast when their texts are read again.
BROADCAST_ROWS, BROADCAST_PAIRS = 200_000, 1_000_000


_FIRST = np.ones(1, bool)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of each text; empty without words."""
    found = words_of(LOWER[data], offsets)
    hashes = found.hashes()
    grams = runs(hashes, SHINGLE)
    sets = []
    for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            own = np.sort(grams[a : b - SHINGLE + 1])
            sets.append(own[np.concatenate([_FIRST, own[1:] != own[:-1]])])
        elif b > a:
            sets.append(runs(np.concatenate([hashes[a:b], np.array([b - a], np.uint64)]), b - a + 1)[:1])
        else:
            sets.append(grams[:0])
    return sets


def class_keys(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Two signed 64-bit keys of each set, independent of each other."""
    size = np.array([len(x) for x in sets], np.int64)
    sums, folds = np.zeros((2, len(sets)), np.uint64), np.zeros((2, len(sets)), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        tokens = np.concatenate(sets)
        begin = (np.cumsum(size) - size)[full]
        for k, x in enumerate((mixed(tokens), mixed(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)))):
            sums[k, full], folds[k, full] = np.add.reduceat(x, begin), np.bitwise_xor.reduceat(x, begin)
    folds ^= size.astype(np.uint64)
    with np.errstate(over="ignore"):
        one = sums[0] * np.uint64(0xFF51AFD7ED558CCD) ^ folds[1]
        other = sums[1] * np.uint64(0x9E3779B97F4A7C15) + folds[0]
    return list(zip(mixed(one).view(np.int64).tolist(), mixed(other).view(np.int64).tolist(), strict=True))


def class_key(tokens: np.ndarray) -> tuple[int, int]:
    return class_keys([tokens])[0]


def _position(tokens: np.ndarray) -> np.ndarray:
    return (mixed(tokens ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def is_frequent(tokens: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    at = _position(tokens)
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def index_entries(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, bool]:
    """Index entries of one set, given which of its ascending tokens are frequent, and whether all are single tokens.

    A set that is similar enough misses at most n - ceil(0.75 n) tokens.
    """
    n = len(tokens)
    if n < 3:
        return tokens[:0], True  # similar enough only to an equal set
    need = n - -(-PERCENT * n // 100) + 1
    rare = tokens[~frequent][:need]
    need -= len(rare)
    if not need:
        return rare, True
    entries, common = [rare], tokens[frequent]
    # Two sets divide the ranges alike if they do so for the level of the smaller one.
    smallest, largest = -(-PERCENT * n // 100), 100 * n // PERCENT
    for level in range(smallest.bit_length(), min(n.bit_length(), largest.bit_length()) + 1):
        parts = max(1, (1 << (level - 1)) // RANGE)
        part = ((common >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        gain = np.zeros(len(common), np.int64)
        gain[1:] = part[1:] == part[:-1]
        upto = int(np.searchsorted(np.cumsum(gain), need)) + 1
        taken, part = common[:upto], part[:upto]
        for lag in range(1, len(taken)):
            same = part[lag:] == part[:-lag]
            if not same.any():
                break
            with np.errstate(over="ignore"):
                entries.append(mixed(taken[:-lag][same] * np.uint64(0x9E3779B97F4A7C15) + taken[lag:][same] + np.uint64(level)))
    return np.concatenate(entries), False


def least_common(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    """Entries that two similar sets of these sizes have in common at least.

    Take the set whose prefix ends first.  Its prefix counts n - ceil(0.75 n) + 1; each
    of its tokens that the other set lacks takes away one at most, and it lacks
    n - overlap at most.  What is left of the count is no more than the common
    entries: a range with m common tokens counts m - 1 and has m (m - 1) / 2 pairs.
    """
    overlap = -(-PERCENT * (small + large) // (100 + PERCENT))
    return np.maximum(1, overlap + PERCENT * -large // 100 + 1)


def _distinct_classes(batches: Iterator[pa.RecordBatch], clash: frozenset[int]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[int]]]:
    for big in batches:
        for batch in pieces_by_bytes(big, "_sw_text"):
            sets = shingle_sets(*utf8_of(batch.column("_sw_text")))
            yield batch, sets, [other if one in clash else one for one, other in class_keys(sets)]


def _survey(frame: DataFrame) -> DataFrame:
    """For each document (kind 0) its class; for each batch (kind 1) the shingles held twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "id", "n", "cls", "other", "tokens", "counts"]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        for big in batches:
            known: dict[tuple[int, int], np.ndarray] = {}
            for batch in pieces_by_bytes(big, "_sw_text"):
                sets = shingle_sets(*utf8_of(batch.column("_sw_text")))
                keys = class_keys(sets)
                known.update(zip(keys, sets, strict=True))
                m = batch.num_rows
                values = [[0] * m, batch.column("_sw_id"), [len(s) for s in sets], [k[0] for k in keys], [k[1] for k in keys], [None] * m, [None] * m]
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(values, types, strict=True)], names=names)
            if not known:
                continue
            tokens, counts = np.unique(np.concatenate(list(known.values())), return_counts=True)
            tokens, counts = tokens[counts > 1], counts[counts > 1].astype(np.uint32)
            part = _position(tokens) >> PART_BITS
            order = np.argsort(part, kind="stable")
            parts, starts = np.unique(part[order], return_index=True)
            ends = [*starts[1:], len(order)][: len(parts)]
            rows = [(1, int(p), 0, 0, 0, tokens[order[a:b]].tobytes(), counts[order[a:b]].tobytes()) for p, a, b in zip(parts, starts, ends, strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return frame.mapInArrow(run, "kind int, id bigint, n bigint, cls bigint, other bigint, tokens binary, counts binary")


def _bitmap(survey: DataFrame) -> np.ndarray:
    """The bitmap of frequent shingles, 2**BITMAP_BITS bits whatever the corpus holds.

    A task fills a part of it, the smaller the more there is to count.
    """
    marks = survey.where("kind = 1").select("id", "tokens", "counts")
    size = marks.agg(F.coalesce(F.sum(F.octet_length("tokens")), F.lit(0))).first()[0]
    bits = PART_BITS
    while bits > 3 and size >> (BITMAP_BITS - bits) > PART_BYTES:
        bits -= 1

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tokens, counts in zip(batch.column("tokens").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                t, c = np.frombuffer(tokens, np.uint64), np.frombuffer(counts, np.uint32)
                part = _position(t) >> bits
                order = np.argsort(part, kind="stable")
                parts, starts = np.unique(part[order], return_index=True)
                rows += [(int(p), t[order[a:b]].tobytes(), c[order[a:b]].tobytes()) for p, a, b in zip(parts, starts, [*starts[1:], len(order)], strict=True)]
            types = (pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names=["id", "tokens", "counts"])

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        tokens = np.concatenate([np.frombuffer(x, np.uint64) for x in frame["tokens"]])
        counts = np.concatenate([np.frombuffer(x, np.uint32) for x in frame["counts"]])
        order = np.argsort(tokens, kind="stable")
        tokens, counts = tokens[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        often = tokens[starts][np.add.reduceat(counts.astype(np.int64), starts) >= FREQUENT]
        held = np.zeros(1 << bits, np.uint8)
        held[_position(often) & ((1 << bits) - 1)] = 1
        return pd.DataFrame({"part": [int(frame["id"].iloc[0])], "bits": [np.packbits(held).tobytes()]})

    if bits < PART_BITS:
        marks = marks.mapInArrow(split, "id bigint, tokens binary, counts binary")
    bitmap, step = np.zeros(1 << (BITMAP_BITS - 3), np.uint8), 1 << (bits - 3)
    for row in marks.groupBy("id").applyInPandas(fill, "part bigint, bits binary").collect():  # 2**BITMAP_BITS bits in all
        bitmap[row["part"] * step : (row["part"] + 1) * step] = np.frombuffer(row["bits"], np.uint8)
    return bitmap


def _shared_entries(frame: DataFrame, bitmap: np.ndarray, buckets: int, clash: frozenset[int]) -> DataFrame:
    """Lists (run, members, sizes, times) of classes that share an index entry, and how many entries share them.

    ``sizes`` holds twice a class's size, plus one if all its entries are single tokens.  A batch deals an entry that ``HOT`` of
    its classes have to a bucket of its own choice, and leaves a mark in the entry's bucket.  The parts of such an entry
    have the same run; other lists that are equal become one.
    """
    shared = frame.sparkSession.sparkContext.broadcast(bitmap)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            known: dict[int, np.ndarray] = {}
            entries, owners, sizes = [], [], []
            for _, sets, keys in _distinct_classes(iter([big]), clash):
                for tokens, key in zip(sets, keys, strict=True):
                    if len(tokens) < 3 or key in known:
                        continue
                    known[key] = tokens[:0]
                    own, plain = index_entries(tokens, is_frequent(tokens, shared.value))
                    entries.append(own)
                    owners.append(np.full(len(own), key, np.int64))
                    sizes.append(np.full(len(own), 2 * len(tokens) + plain, np.uint32))
            if not entries:
                continue
            e, o, z = np.concatenate(entries), np.concatenate(owners), np.concatenate(sizes)
            if not len(e):
                continue
            bucket = (((mixed(e) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
            kind = np.zeros(len(e), np.int64)
            if len(known) >= HOT:
                slot = (mixed(e) & np.uint64((1 << 20) - 1)).astype(np.int64)
                near = np.flatnonzero(np.bincount(slot, minlength=1 << 20)[slot] >= HOT)
                each, back, count = np.unique(e[near], return_inverse=True, return_counts=True)
                hot = count >= HOT
                if hot.any():
                    at = near[hot[back]]
                    marks, place = each[hot], (((mixed(each[hot]) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
                    own_choice = mixed(e[at] ^ np.uint64(next(iter(known)) & (2**64 - 1)))
                    kind[at], bucket[at] = 1, (((own_choice >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
                    e, o, z = np.concatenate([e, marks]), np.concatenate([o, np.zeros(len(marks), np.int64)]), np.concatenate([z, np.zeros(len(marks), np.uint32)])
                    bucket, kind = np.concatenate([bucket, place]), np.concatenate([kind, np.full(len(marks), 2)])
            deal = 3 * bucket + kind
            order = np.argsort(deal, kind="stable")
            which, starts = np.unique(deal[order], return_index=True)
            for b, i, j in zip(which, starts, [*starts[1:], len(order)], strict=True):
                at = order[i:j]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(b) // 3], pa.int64()), pa.array([int(b) % 3], pa.int64()), *(pa.array([x[at].tobytes()], pa.binary()) for x in (e, o, z))],
                    names=["bucket", "kind", "entries", "owners", "sizes"],
                )

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        def column(name: str, kind: int, dtype) -> np.ndarray:
            return np.concatenate([np.zeros(0, dtype), *[np.frombuffer(x, dtype) for x in frame.loc[frame["kind"] == kind, name]]])

        marks = np.unique(column("entries", 2, np.uint64))
        lists: dict[bytes, list] = {}
        parts: list[list] = []
        for kind in (0, 1):
            e, o, z = column("entries", kind, np.uint64), column("owners", kind, np.int64), column("sizes", kind, np.uint32)
            order = np.argsort(e, kind="stable")
            ranked = e[order]
            starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(e) else np.zeros(0, np.int64)
            ends = np.append(starts[1:], len(e))[: len(starts)]
            split = np.isin(ranked[starts], marks) | (kind == 1)
            for i in np.flatnonzero((ends - starts > 1) | split):
                at = order[starts[i] : ends[i]]
                owner, first = np.unique(o[at], return_index=True)
                size = z[at][first]
                if split[i]:
                    parts.append([int(ranked[starts[i]].view(np.int64)), owner, size.astype(np.int64), 1])
                elif len(owner) > 1:
                    by_size = np.argsort(size, kind="stable")
                    held = lists.setdefault(owner[by_size].tobytes(), [None, owner[by_size], size[by_size].astype(np.int64), 0])
                    held[3] += 1
        rows = [*lists.values(), *parts]
        return pd.DataFrame({"run": pd.Series([x[0] for x in rows], dtype=object), "members": [x[1] for x in rows], "sizes": [x[2] for x in rows], "times": [x[3] for x in rows]})

    blocks = frame.mapInArrow(emit, "bucket bigint, kind bigint, entries binary, owners binary, sizes binary")
    met = blocks.groupBy("bucket").applyInPandas(meet, "run bigint, members array<bigint>, sizes array<bigint>, times bigint")
    # Of a divided entry each part stays by itself; its members are a part of the key only so that all parts do.
    name = F.coalesce("run", F.xxhash64("members"))
    one = met.groupBy(name.alias("run"), F.xxhash64("members").alias("part"), F.size("members").alias("m")).agg(F.first(F.struct("members", "sizes")).alias("r"), F.sum("times").alias("times"))
    return one.select("run", "r.members", "r.sizes", "times")


def _memberships(shared: DataFrame) -> DataFrame:
    """Rows (run, times, m, cls, size)."""
    at = shared.select("run", "times", F.size("members").alias("m"), F.explode(F.arrays_zip("members", "sizes")).alias("x"))
    return at.select("run", "times", "m", F.col("x.members").alias("cls"), F.col("x.sizes").alias("size"))


def _summed(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.sum("times").alias("times"))


def _closest(pairs: DataFrame, count: int) -> DataFrame:
    """Of each class's pairs the ``count`` with most entries in common."""
    sides = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"), "times").select("p.a", "p.b", "times")
    place = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("times"), "a"))
    return sides.withColumn("_r", place).where(F.col("_r") <= count).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _fit(size: str, other: str) -> Column:
    """Whether two classes of these (doubled) sizes may be similar."""
    small, large = F.least(size, other), F.greatest(size, other)
    return 100 * F.shiftright(small, 1) >= PERCENT * F.shiftright(large, 1)


def _ordered_pair(one: str, other: str) -> list[Column]:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b"), F.col("times")]


def _hub_pairs(shared: DataFrame) -> DataFrame:
    """Each class of a list with the list's hub, summed: the class of largest degree, where their sizes may be similar.  The degree of a
    class is the number of others in its lists."""
    at = _memberships(shared)
    degree = at.groupBy("cls").agg(F.sum((F.col("m") - 1) * F.col("times")).alias("degree"))
    at = at.join(degree, "cls")
    hub = at.groupBy("run").agg(F.max(F.struct("degree", "cls", "size")).alias("hub"))
    pairs = at.join(hub, "run").select("times", "cls", "size", F.col("hub.cls").alias("to"), F.col("hub.size").alias("to_size"))
    return _summed(pairs.where((F.col("cls") != F.col("to")) & _fit("size", "to_size")).select(*_ordered_pair("cls", "to")))


def _between_components(shared: DataFrame, comps: DataFrame) -> DataFrame:
    """Memberships (run, times, m, cls, size, comp, members) of the lists whose classes are in several components."""
    at = _memberships(shared)
    at = at.join(comps, at["cls"] == comps["node"], "left").select(*at.columns, F.coalesce("component", "cls").alias("comp"))
    runs = at.groupBy("run").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members")).where("lo <> hi")
    return at.join(runs.select("run", "members"), "run")


def _neighbours(rows: DataFrame, turn: int) -> DataFrame:
    """Classes of different components next to each other in the turn's random order of a list; long lists are divided."""
    part = F.pmod(F.xxhash64(F.lit(turn), "cls"), F.ceil(F.col("members") / ORDERED))
    own = Window.partitionBy("run", "_part").orderBy(F.xxhash64("cls", F.lit(turn + 1)), "cls")
    before = {f"{c}_before": F.lag(c).over(own) for c in ("cls", "size", "comp")}
    met = rows.withColumn("_part", part).withColumns(before).where(F.col("comp") != F.col("comp_before"))
    return met.where(_fit("size", "size_before")).select(*_ordered_pair("cls", "cls_before"))


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Pairs of blocks (lo, hi) with the members ``x`` and ``y`` that a list has in them, where they are of several components.

    A class's home is the class of largest degree that leads one of its lists; the classes of a home are dealt into
    blocks of bounded count and size.  ``y`` is empty if both blocks are one.
    """
    degree = rows.groupBy("cls").agg(F.sum((F.col("m") - 1) * F.col("times")).alias("degree"))
    at = rows.join(degree, "cls")
    lead = at.groupBy("run").agg(F.max(F.struct("degree", "cls")).alias("lead"))
    home = at.join(lead, "run").groupBy("cls").agg(F.max("lead")["cls"].alias("home"), F.first(F.shiftright("size", 1)).alias("n"))
    blocks = home.groupBy("home").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).alias("blocks"))
    dealt = home.join(blocks, "home").select("cls", F.xxhash64("home", F.pmod(F.xxhash64("cls"), F.col("blocks"))).alias("block"))
    inside = rows.join(dealt, "cls").groupBy("run", "block").agg(
        F.collect_list(F.struct("cls", F.shiftright("size", 1).alias("n"), "comp")).alias("x"), F.min("comp").alias("least"), F.max("comp").alias("most"), F.max("times").alias("times")
    )
    other = inside.select(F.col("run").alias("_run"), F.col("block").alias("hi"), F.col("x").alias("y"), F.col("least").alias("_least"), F.col("most").alias("_most"))
    pairs = inside.join(other, (F.col("run") == F.col("_run")) & (F.col("block") <= F.col("hi"))).where(F.least("least", "_least") < F.greatest("most", "_most"))
    same = F.col("block") == F.col("hi")
    return pairs.select(F.col("block").alias("lo"), "hi", "times", "x", F.when(same, F.slice("y", 1, 0)).otherwise(F.col("y")).alias("y"))


def _bounds(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins, and the end."""
    n = len(keys[0])
    new = np.ones(n + 1, bool)
    if n:
        new[1:n] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


class _Side:
    """The classes of one block in the order in which they are met."""

    def __init__(self) -> None:
        self.at: dict[int, int] = {}
        self.rows: list[tuple[int, int, int]] = []

    def places(self, cls: np.ndarray, n: np.ndarray, comp: np.ndarray) -> np.ndarray:
        each, first, back = np.unique(cls, return_index=True, return_inverse=True)
        found = np.empty(len(each), np.int64)
        for k, (c, f) in enumerate(zip(each.tolist(), first.tolist(), strict=True)):
            if c not in self.at:
                self.at[c] = len(self.rows)
                self.rows.append((c, int(n[f]), int(comp[f])))
            found[k] = self.at[c]
        return found[back]

    def columns(self) -> np.ndarray:
        return np.array(self.rows, np.int64).reshape(-1, 3).T


class _Tally:
    """Common entries of the classes of a pair of blocks.  It grows with the blocks, not with the lists that are added."""

    def __init__(self, same: bool):
        self.same, self.one = same, _Side()
        self.other = self.one if same else _Side()
        self.common = np.zeros((0, 0), np.float32)

    def add(self, members: np.ndarray, length: np.ndarray, times: np.ndarray) -> None:
        """Lists: class, size, component and side (1 for the later block) of all members, the members of each list, and its times."""
        late = members[3].astype(bool)
        list_of = np.repeat(np.arange(len(length)), length)
        x = self.one.places(*members[:3, ~late]), list_of[~late]
        y = x if self.same else (self.other.places(*members[:3, late]), list_of[late])
        shape = len(self.one.rows), len(self.other.rows)
        if shape != self.common.shape:
            old, self.common = self.common, np.zeros(shape, np.float32)
            self.common[: old.shape[0], : old.shape[1]] = old
        for a in range(0, len(length), LISTS):
            b = min(a + LISTS, len(length))
            left, right = np.zeros((b - a, shape[0]), np.float32), np.zeros((b - a, shape[1]), np.float32)
            for table, (place, of) in ((left, x), (right, y)):
                i, j = np.searchsorted(of, (a, b))  # members lie in the order of their lists
                table[of[i:j] - a, place[i:j]] = 1.0
            self.common += (left * times[a:b, None]).T @ right

    def found(self) -> tuple[list[int], bytes] | None:
        """The classes, and pairs of them as places, that have enough entries in common."""
        i, j = np.nonzero(self.common)
        if self.same:
            i, j = i[i < j], j[i < j]
        (c, n, comp), (d, m, other) = self.one.columns(), self.other.columns()
        small, large = np.minimum(n[i], m[j]), np.maximum(n[i], m[j])
        fit = (comp[i] != other[j]) & (100 * small >= PERCENT * large) & (self.common[i, j] >= least_common(small, large))
        if not fit.any():
            return None
        held, back = np.unique(np.concatenate([c[i[fit]], d[j[fit]]]), return_inverse=True)
        return held.tolist(), back.reshape(2, -1).astype(np.uint32).tobytes()


def _by_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``MEMBERS`` members of lists."""
    for batch in batches:
        upto, a = np.cumsum(sum(batch.column(k).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 4))), 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + MEMBERS, side="right")))
            yield batch.slice(a, b - a)
            a = b


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidate pairs that have enough entries in common, of lists sorted by pairs of blocks."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["a", "chunk", "classes", "pairs"])

    rows: list[tuple] = []
    open_, tally = None, None

    def closed() -> None:
        found = tally.found() if tally is not None else None
        if found is not None:
            rows.append((*open_, *found))

    for batch in _by_members(batches):
        lo, hi, times = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        nx, ny = (batch.column(k).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 4))
        parts = [[batch.column(k).flatten().field(f).to_numpy(zero_copy_only=False) for f in range(3)] for k in (3, 4)]
        # Members of a list: those of x, then those of y.
        total = nx + ny
        begin = np.cumsum(total) - total
        where = [np.repeat(begin - (np.cumsum(nx) - nx), nx) + np.arange(nx.sum()), np.repeat(begin + nx - (np.cumsum(ny) - ny), ny) + np.arange(ny.sum())]
        members = np.empty((4, int(total.sum())), np.int64)
        for k in (0, 1):
            for f in range(3):
                members[f, where[k]] = parts[k][f]
            members[3, where[k]] = k
        upto = np.append(begin, total.sum())
        groups = _bounds(lo, hi)
        # Most pairs of blocks have one list of two members in common; those are settled at once.
        single = (total == 2) & (np.diff(groups)[np.searchsorted(groups, np.arange(len(lo)), side="right") - 1] == 1)
        single[[0, -1]] = False  # the first and the last pair of blocks may go on in another batch
        at = begin[np.flatnonzero(single)]
        n, m = members[1, at], members[1, at + 1]
        small, large = np.minimum(n, m), np.maximum(n, m)
        good = (members[2, at] != members[2, at + 1]) & (100 * small >= PERCENT * large) & (times[single] >= least_common(small, large))
        for a, c, one, other in zip(lo[single][good].tolist(), hi[single][good].tolist(), members[0, at][good].tolist(), members[0, at + 1][good].tolist(), strict=True):
            rows.append((a, c, [one, other], b"\0\0\0\0\1\0\0\0"))
        for i, j in zip(groups[:-1].tolist(), groups[1:].tolist(), strict=True):
            if single[i]:
                continue
            key = (int(lo[i]), int(hi[i]))
            if key != open_:
                closed()
                open_, tally = key, _Tally(key[0] == key[1])
            tally.add(members[:, upto[i] : upto[j]], total[i:j], times[i:j])
        if sum(len(r[3]) for r in rows) >= HELD_BYTES:
            yield batch_of(rows)
            rows.clear()
    closed()
    if rows:
        yield batch_of(rows)


def _sets(frame: DataFrame, speakers: DataFrame, wanted: DataFrame, clash: frozenset[int]) -> DataFrame:
    """The shingle set of each class for each task (a, chunk) that wants it, from the texts of the classes' speakers."""
    tasks = wanted.groupBy("cls").agg(F.collect_list(F.struct("a", "chunk", "pivot")).alias("_sw_tasks")).join(speakers, "cls")
    tasks = cut(tasks.select(F.col("speaker").alias("_sw_speaker"), F.col("cls").alias("_sw_cls"), "_sw_tasks"))
    size = tasks.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("_sw_tasks")), F.lit(0)).alias("pairs")).first()
    few = size["rows"] <= BROADCAST_ROWS and size["pairs"] <= BROADCAST_PAIRS
    texts = frame.join(F.broadcast(tasks) if few else tasks.hint("shuffle_hash"), frame["_sw_id"] == tasks["_sw_speaker"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["a", "chunk", "pivot", "cls", "tokens"])

        for batch, sets, keys in _distinct_classes(batches, clash):
            held, todo = batch.column("_sw_cls").to_pylist(), batch.column("_sw_tasks").to_pylist()
            rows, size = [], 0
            for i, key in enumerate(keys):
                if key != held[i]:  # a repeated id may have another text than the one that speaks for the class
                    continue
                tokens = _sent(sets[i])
                for t in todo[i]:
                    rows.append((t["a"], t["chunk"], t["pivot"], held[i], tokens))
                    size += len(tokens)
                    if size >= HELD_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
            if rows:
                yield batch_of(rows)

    return texts.select("_sw_text", "_sw_cls", "_sw_tasks").mapInArrow(measure, "a bigint, chunk bigint, pivot boolean, cls bigint, tokens binary")


def _sent(tokens: np.ndarray) -> bytes:
    """Ascending hashes by their upper 48 bits; sets of 20,000 shingles have 0.0000014 false common ones on average."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _received(data: bytes) -> np.ndarray:
    tokens = np.zeros((len(data) // 6, 8), np.uint8)
    tokens[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return tokens.reshape(-1).view("<u8")


def _similar(one: np.ndarray, other: np.ndarray) -> bool:
    at = np.minimum(np.searchsorted(one, other), len(one) - 1)
    common = int((one[at] == other).sum())
    return 100 * common >= PERCENT * (len(one) + len(other) - common)


def _verified(frame: DataFrame, speakers: DataFrame, pairs: DataFrame, clash: frozenset[int]) -> DataFrame:
    """Of the class pairs (a, b), those whose whole sets are similar enough.

    Sets are sorted behind the one that they are compared with, so a task holds that one and a batch.
    """
    chunks = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = pairs.join(chunks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"))
    wanted = dealt.select("a", "chunk", F.col("b").alias("cls"), F.lit(False).alias("pivot")).unionByName(
        dealt.select("a", "chunk").distinct().select("a", "chunk", F.col("a").alias("cls"), F.lit(True).alias("pivot"))
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, one = None, None
        for batch in batches:
            a, chunk, cls = (batch.column(c).to_pylist() for c in ("a", "chunk", "cls"))
            found = []
            for i, pivot in enumerate(batch.column("pivot").to_pylist()):
                if now != (a[i], chunk[i]):  # a repeated id may have hidden the text of its pivot
                    now, one = (a[i], chunk[i]), None
                if pivot:
                    one = _received(batch.column("tokens")[i].as_py())
                elif one is not None and _similar(one, _received(batch.column("tokens")[i].as_py())):
                    found.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in found], pa.int64()) for x in (a, cls)], names=["a", "b"])

    sets = _sets(frame, speakers, wanted, clash).repartition(shuffle_partitions(frame.sparkSession), "a", "chunk")
    return sets.sortWithinPartitions("a", "chunk", F.desc("pivot")).mapInArrow(compare, "a bigint, b bigint")


def _verified_blocks(frame: DataFrame, speakers: DataFrame, tasks: DataFrame, clash: frozenset[int]) -> DataFrame:
    """Links (a, b) that join the same classes as all similar pairs of the tasks do."""

    def compare(sets: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        known = {c: _received(t) for c, t in zip(sets["cls"], sets["tokens"], strict=True)}
        links = []
        for classes, pairs in zip(plan["classes"], plan["pairs"], strict=True):
            root = list(range(len(classes)))
            for i, j in np.frombuffer(pairs, np.uint32).reshape(2, -1).T.tolist():
                p, q = i, j
                while root[p] != p:
                    p = root[p] = root[root[p]]
                while root[q] != q:
                    q = root[q] = root[root[q]]
                if p != q and classes[i] in known and classes[j] in known and _similar(known[classes[i]], known[classes[j]]):
                    root[q] = p
                    links.append((classes[i], classes[j]))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    wanted = tasks.select("a", "chunk", F.explode("classes").alias("cls"), F.lit(False).alias("pivot"))
    sets = _sets(frame, speakers, wanted, clash)
    return sets.groupBy("a", "chunk").cogroup(tasks.groupBy("a", "chunk")).applyInPandas(compare, "a bigint, b bigint")


def _clashes(survey: DataFrame) -> frozenset[int]:
    """First keys that sets of different second keys share: of n sets, n * n / 2**65 are expected."""
    each = survey.where("kind = 0 and n > 0").groupBy("cls").agg(F.min("other").alias("lo"), F.max("other").alias("hi"))
    found = each.where("lo <> hi").select("cls").limit(MAX_CLASHES + 1).collect()
    if len(found) > MAX_CLASHES:
        raise ValueError("more keys clash than hashes of 64 bits can explain")
    return frozenset(r["cls"] for r in found)


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components with further links (a, b)."""
    return components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns: the id, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    A text of fewer than five words has its whole word sequence as one shingle; a
    null text or one without words has none and is linked with nothing.  Rows
    that repeat an id are all returned; an id is linked by any of its rows.  A row
    with a null id is linked with nothing and has a null component.  An empty table
    gives an empty one.  Columns of ``docs`` other than these two are not used.
    """
    frame = docs.select(F.col(id_col).cast("bigint").alias("_sw_id"), F.col(text_col).alias("_sw_text"))
    survey = cut(_survey(frame))
    clash = _clashes(survey)
    cls = F.when(F.col("cls").isin(list(clash)), F.col("other")).otherwise(F.col("cls")) if clash else F.col("cls")
    rows = survey.where("kind = 0").select("id", "n", cls.alias("cls"))
    held = rows.where("id is not null and n > 0")
    speakers = held.groupBy("cls").agg(F.min("id").alias("speaker"))
    known = frame.where("_sw_id is not null")
    # About a quarter of a set is indexed, by 20 bytes an entry.
    buckets = max(shuffle_partitions(docs.sparkSession), -(-5 * (rows.agg(F.sum("n")).first()[0] or 0) // BUCKET_BYTES))
    shared = cut(_shared_entries(known, _bitmap(survey), buckets, clash))
    release(docs.sparkSession)
    seen = cut(_closest(_hub_pairs(shared), 1))
    comps = components(cut(_verified(known, speakers, seen, clash)))
    for turn in range(ROUNDS):
        release(docs.sparkSession)
        near = _neighbours(_between_components(shared, comps), turn)
        more = cut(_closest(_summed(near), NEIGHBOURS).join(seen, ["a", "b"], "left_anti"))
        found = cut(_verified(known, speakers, more, clash))
        seen, comps = seen.unionByName(more), _joined(comps, found)
        if found.count() < 0.05 * more.count():
            break
    release(docs.sparkSession)
    blocks = _in_blocks(cut(_between_components(shared, comps)))
    blocks = blocks.repartition(4 * shuffle_partitions(docs.sparkSession), "lo", "hi").sortWithinPartitions("lo", "hi")
    rest = cut(blocks.mapInArrow(_settled, "a bigint, chunk bigint, classes array<bigint>, pairs binary"))
    release(docs.sparkSession)
    if not rest.isEmpty():
        comps = _joined(comps, cut(_verified_blocks(known, speakers, rest, clash)))
    # An id with several rows of different texts joins their classes too.
    bridges = held.groupBy("id").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b")
    bridges = bridges.join(held, "id").select("a", F.col("cls").alias("b")).where("a <> b")
    if not bridges.isEmpty():
        comps = _joined(comps, bridges)
    labelled = speakers.join(comps, speakers["cls"] == comps["node"], "left").select("cls", "speaker", F.coalesce("component", "cls").alias("comp"))
    least = labelled.groupBy("comp").agg(F.min("speaker").alias("component_id"))
    by_class = labelled.join(least, "comp").select("cls", "component_id")
    linked = rows.join(by_class, "cls", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return linked.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), own).alias("component_id"))
