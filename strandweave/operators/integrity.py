"""Digests, gates and verdict tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.errors import IntegrityError
from strandweave.operators.ordered import cut

NULL_MARK = "\\N"


def json_digest(value: object) -> str:
    """SHA-256 of the canonical JSON text: sorted keys, no spaces."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def row_digest(columns: list[str]) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit(NULL_MARK)) for c in columns]), 256)


#: Row digests that one group holds, about.
GROUP_ROWS = 4096


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, n, h) of sorted (g, d, n): the hash of each group's digests one behind the other, of which none but the batch is held."""
    now, n, h, names = None, 0, None, ["g", "n", "h"]
    kinds = [pa.string(), pa.int64(), pa.string()]
    row = lambda: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((now, n, h.hexdigest()), kinds, strict=True)], names=names)
    for batch in batches:
        for g, d, k in zip(*(batch.column(c).to_pylist() for c in ("g", "d", "n")), strict=True):
            if g != now:
                if h is not None:
                    yield row()
                now, n, h = g, 0, hashlib.sha256()
            h.update((d if k == 1 else f"{d}*{k}").encode())
            n += k
    if h is not None:
        yield row()


def logical_digest(df: DataFrame, columns: list[str], digits: int | None = None) -> DataFrame:
    """(rows, digest) independent of layout and order.

    With ``digits`` the digests are hashed within each group of so many equal first digits, and then the groups' hashes, whatever the
    table's size; a group is read as a sorted stream, so it may be of any size too.  Without it:

    Equal row digests are counted.  The digests (with their counts, where above 1) are sorted and hashed within each
    group of equal first digits, as many as make groups of about ``GROUP_ROWS``, 2 at least; then the groups' hashes within groups
    of two digits less, and so on, so no task holds more than a few thousand of them.
    """
    rows = df.groupBy(row_digest(columns).alias("d")).agg(F.count("*").alias("n"))
    whole = lambda group: group.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda x: x["h"]), ""), 256).alias("digest"))
    if digits is not None:
        own = rows.select(F.substring("d", 1, digits).alias("g"), "d", "n").repartition(16**digits, "g").sortWithinPartitions("g", "d")
        return whole(own.mapInArrow(_hashed, "g string, n bigint, h string"))
    rows, prefix = cut(rows), 2
    while GROUP_ROWS * 16**prefix < rows.count():
        prefix += 2
    spelled = F.when(F.col("n") > 1, F.concat_ws("*", "d", F.col("n").cast("string"))).otherwise(F.col("d"))
    group = rows.groupBy(F.substring("d", 1, prefix).alias("g")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(spelled)), ""), 256).alias("h"))
    for k in range(prefix - 2, 0, -2):
        ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda x: x["h"]), "")
        group = group.groupBy(F.substring("g", 1, k).alias("g")).agg(F.sum("n").alias("n"), F.sha2(ordered, 256).alias("h"))
    return whole(group)


def additive_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, digest): a sum of row hashes, for tables of any size."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string").alias("digest"))


def same_content(a: DataFrame, b: DataFrame, columns: list[str]) -> bool:
    return logical_digest(a, columns).first() == logical_digest(b, columns).first()


def duplicate_content(df: DataFrame, key: str, content: str) -> DataFrame:
    """(digest, copies, first_key) of contents held more than once."""
    own = df.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("digest"))
    return own.groupBy("digest").agg(F.count("*").alias("copies"), F.min(key).alias("first_key")).where("copies > 1")


def refuse_spent(requested: DataFrame, spent: DataFrame, key: str) -> None:
    hit = requested.join(spent.select(key), key, "left_semi").limit(1).collect()
    if hit:
        raise IntegrityError(f"{key} {hit[0][key]} was already used")


def overlap(requested: DataFrame, spent: DataFrame, key: str) -> DataFrame:
    return requested.select(key).distinct().join(spent.select(key).distinct(), key, "left_semi")


def score_legs(legs: DataFrame) -> DataFrame:
    """Legs (gate, leg, kind, limit, value, retired) with ``passed``: ``expect`` is equality, ``at_least`` inclusive,
    ``below`` strict; a missing value fails; retired legs are checked but don't count."""
    k, v, x = F.col("kind"), F.col("value"), F.col("limit")
    good = F.when(k == "expect", v == x).when(k == "at_least", v >= x).when(k == "below", v < x)
    return legs.withColumn("passed", F.coalesce(good, F.lit(False)))


def gates(legs: DataFrame) -> DataFrame:
    """(gate, legs, failed, passed): a gate passes if no leg in force fails."""
    own = score_legs(legs)
    return own.groupBy("gate").agg(F.count("*").alias("legs"), F.count_if(~F.col("passed") & ~F.col("retired")).alias("failed")).withColumn("passed", F.col("failed") == 0)


def highest_tier(evidence: DataFrame, order: list[str]) -> DataFrame:
    """(subject, tier): the highest tier with valid evidence."""
    rank = F.array_position(F.array(*[F.lit(t) for t in order]), F.col("tier"))
    return evidence.where("valid").groupBy("subject").agg(F.max_by("tier", rank).alias("tier"))


def lock_status(locked: DataFrame, observed: DataFrame) -> DataFrame:
    """(artifact, status) of locked (artifact, digest, bytes) against observed: ok, missing, size, mismatch or unlocked."""
    o = observed.select("artifact", F.col("digest").alias("_d"), F.col("bytes").alias("_b"))
    j = locked.join(o, "artifact", "full_outer")
    status = F.when(F.col("digest").isNull(), "unlocked").when(F.col("_d").isNull(), "missing").when(F.col("bytes") != F.col("_b"), "size").when(F.col("digest") != F.col("_d"), "mismatch").otherwise("ok")
    return j.select("artifact", status.alias("status"))


def consistent(variants: DataFrame, columns: list[str]) -> DataFrame:
    """(property, distinct_values, consistent) of properties that all variants must share."""
    one = variants.agg(*[F.count_distinct(c).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("property"), F.col(c).alias("distinct_values")) for c in columns])).alias("p")).select("p.property", "p.distinct_values", (F.col("p.distinct_values") == 1).alias("consistent"))


def reservations(names: DataFrame, declared: DataFrame) -> DataFrame:
    """(name, verdict): every name must be declared exactly once, as reserved or released, and exist."""
    d = declared.groupBy("name").agg(F.count("*").alias("n"))
    j = names.select("name", F.lit(True).alias("_in")).join(d, "name", "full_outer")
    verdict = F.when(F.col("_in").isNull(), "absent").when(F.col("n").isNull(), "unclassified").when(F.col("n") > 1, "contradictory").otherwise("ok")
    return j.select("name", verdict.alias("verdict"))
