"""Threshold-scaled document sketches.

A sketch keeps every five-word shingle hash below a fixed fraction of the hash
range, so its size follows the document's, and sketches of documents of very
unequal length can be merged and compared: the kept hashes of two documents are
the same sample of one hash range.  Where no hash falls below the threshold, the
smallest one is kept, so that only a text without words has an empty sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandweave.llm._common import cut

#: One hash in so many is kept.
SCALE = 4
SHINGLE = 5


def with_sketch(df: DataFrame, text_col: str, out_col: str, scale: int = SCALE) -> DataFrame:
    """Adds ``out_col``, the ascending array of a text's kept hashes.

    A text of fewer than five words has one shingle, its whole word sequence; a
    null text or one without words has an empty sketch.
    """
    limit = _limit(scale)
    following = ", ".join(f"get(_sw_w, i + {k})" for k in range(1, SHINGLE))
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    shingles = F.expr(
        "case when size(_sw_w) = 0 then array() "
        f"when size(_sw_w) < {SHINGLE} then array(aggregate(_sw_w, 17L, (a, x) -> xxhash64(a, x))) "
        f"else transform(slice(_sw_w, 1, size(_sw_w) - {SHINGLE - 1}), (x, i) -> xxhash64(x, {following})) end"
    ).cast("array<bigint>")
    kept = F.expr(f"filter(_sw_h, x -> x < {limit}L)")
    return (
        df.withColumn("_sw_w", F.transform(words, lambda w: F.xxhash64(w)))
        .withColumn("_sw_h", shingles)
        .withColumn("_sw_k", kept)
        .withColumn(out_col, F.expr("case when size(_sw_k) > 0 or size(_sw_h) = 0 then array_sort(array_distinct(_sw_k)) else array(array_min(_sw_h)) end"))
        .drop("_sw_w", "_sw_h", "_sw_k")
    )


def _limit(scale: int) -> int:
    """Hashes below this are kept."""
    return -(1 << 63) + (1 << 64) // scale


def _settled(hashes: Column, scale: int) -> Column:
    """The sketch of the shingles whose sketches' hashes these are: those below the threshold, or else the least."""
    below = F.filter(hashes, lambda h: h < _limit(scale))
    least = F.when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(hashes)
    return F.when(F.size(below) > 0, below).otherwise(least)


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two texts' shingles together."""
    return F.array_sort(_settled(F.array_union(a, b), scale))


def likeness(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated Jaccard similarity, 1 for two empty sketches: the share of the joint sketch that both hold."""
    joint = _settled(F.array_union(a, b), scale)
    both = F.size(F.array_intersect(joint, F.array_intersect(a, b)))
    return F.when(F.size(joint) == 0, F.lit(1.0)).otherwise(both / F.size(joint)).cast("double")


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has, 1 for an empty ``a``.

    Of a text so short that none of its hashes is below the threshold, ``b`` holds a sample only if it
    is as short; otherwise the result is null.
    """
    told = (F.size(b) == 0) | (F.array_min(a) < _limit(scale)) | (F.array_min(b) >= _limit(scale))
    share = (F.size(F.array_intersect(a, b)) / F.size(a)).cast("double")
    return F.when(F.size(a) == 0, F.lit(1.0)).when(told, share)


def as_text(sketch: Column) -> Column:
    """16 hexadecimal digits for each kept hash, ascending."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def predecessors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each distinct id the one before it on the ring of ascending ids.

    Columns ``_sw_id``, ``_sw_prev``, ``_sw_prev_n`` (code points of the
    predecessor's text), ``_sw_mark`` (hash of the row that speaks for a repeated
    id) and ``_sw_rows``.  The ids are sorted by range partition; between
    partitions only the last id of each is passed on.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    ids = cut(
        docs.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("_sw_id"), F.length(text).alias("n"), F.xxhash64(text).alias("h"))
        .groupBy("_sw_id")
        .agg(F.min(F.struct("h", "n")).alias("one"), F.count("*").alias("_sw_rows"))
        .select("_sw_id", F.col("one.n").alias("n"), F.col("one.h").alias("_sw_mark"), "_sw_rows")
    )
    part = cut(ids.repartitionByRange("_sw_id").withColumn("part", F.spark_partition_id()))
    ends = part.groupBy("part").agg(F.max(F.struct("_sw_id", "n")).alias("last"))
    # One row for each partition.
    order = Window.orderBy("part")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("last").over(order), F.last("last").over(whole)).alias("carry"))
    run = Window.partitionBy("part").orderBy("_sw_id")
    inner = F.lag(F.struct("_sw_id", "n")).over(run)
    return (
        part.withColumn("inner", inner)
        .join(F.broadcast(ends), "part")
        .select("_sw_id", F.coalesce("inner", "carry").alias("p"), "_sw_mark", "_sw_rows")
        .select("_sw_id", F.col("p._sw_id").alias("_sw_prev"), F.col("p.n").alias("_sw_prev_n"), "_sw_mark", "_sw_rows")
    )


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE) -> DataFrame:
    """Sketches of each text, of its edited text, and their likeness.

    The edited text has its last quarter of code points replaced by as many from
    the start of the next document in ascending id (after the last: the first).

    Null text counts as empty.  Rows that repeat an id are all returned; to its
    predecessor the row of smallest text hash speaks for it.  A row with a null
    id has no next document: its edited text loses the quarter, and its likeness
    to the next is 0.  Columns of ``docs`` other than these two are not used.
    """
    base = docs.select(F.col(id_col).alias("_sw_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_sw_text"))
    known = base.where(F.col("_sw_id").isNotNull())
    before = predecessors(docs, id_col, text_col)
    # Both sides below read one shuffle of the texts, so sketches are made behind it, and the
    # comparison with the mark is written so that it doesn't become a second join key.
    heads = known.join(before.hint("shuffle_hash"), "_sw_id").where(F.xxhash64("_sw_text").bitwiseXOR(F.col("_sw_mark")) == 0)
    heads = with_sketch(heads, "_sw_text", "_sw_fp", scale).select(
        F.col("_sw_prev").alias("_sw_to"), F.expr("substring(_sw_text, 1, div(_sw_prev_n, 4))").alias("_sw_head"), F.col("_sw_fp").alias("_sw_next_fp"), "_sw_rows"
    )
    heads = heads.where("_sw_rows = 1").unionByName(heads.where("_sw_rows > 1").dropDuplicates(["_sw_to"])).drop("_sw_rows")
    joined = known.join(heads.hint("shuffle_hash"), known["_sw_id"] == heads["_sw_to"], "left").drop("_sw_to")
    alone = base.where(F.col("_sw_id").isNull()).select("*", F.lit("").alias("_sw_head"), F.lit(None).cast("array<bigint>").alias("_sw_next_fp"))
    both = joined.unionByName(alone)
    n = F.length("_sw_text")
    both = both.withColumn("_sw_edited", F.expr("concat(substring(_sw_text, 1, length(_sw_text) - div(length(_sw_text), 4)), _sw_head)"))
    both = with_sketch(with_sketch(both, "_sw_text", "_sw_fp", scale), "_sw_edited", "_sw_efp", scale)
    return both.select(
        F.col("_sw_id").alias(id_col),
        n.cast("bigint").alias("n_chars"),
        F.sha2(F.col("_sw_edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("_sw_fp")).alias("fingerprint"),
        as_text(F.col("_sw_efp")).alias("edited_fingerprint"),
        likeness(F.col("_sw_fp"), F.col("_sw_efp"), scale).alias("near_edited"),
        F.coalesce(likeness(F.col("_sw_fp"), F.col("_sw_next_fp"), scale), F.lit(0.0)).alias("near_next"),
        containment(F.col("_sw_fp"), F.col("_sw_efp"), scale).alias("contained_edited"),
    )
