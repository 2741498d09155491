"""Exact line deduplication across documents.

Every line's key (ASCII-trimmed, A-Z lower-cased) is hashed to 128 bits.  The
hashes are partitioned by range and sorted by hash, document and position, so
that one pass over a partition meets the first holder of each key first.  What
comes back is a compressed bitmap per document, not text: 64 lines to a word,
and only the words in which some line goes.

A key that fills a third of all rows is handled by salt: in a first pass it is
spread by document over places of the hash ring, about a quarter as many as there are
partitions, and only the lines of the first document of each place go on to the
second, unsalted pass.  The first pass is written down, so texts are split once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandweave.llm._common import ASCII_SPACE, cut, lower_ascii, shuffle_partitions

#: Least bits of the number of places over which the documents of one key are spread.
SALT_BITS = 4


def _ring_slot(position: Column, slots: int) -> Column:
    """Which of ``slots`` equal ranges of the signed 64-bit ring holds a position."""
    high = F.shiftright(position, 32) + F.lit(1 << 31)
    return F.shiftright(high * F.lit(slots), 32).cast("int")


def _first_holder(rows: DataFrame, position: str, slots: int) -> DataFrame:
    """Adds ``_sw_first``, the smallest document of a row's (position, check) pair."""
    placed = rows.withColumn("_sw_slot", _ring_slot(F.col(position), slots)).repartitionById(slots, F.col("_sw_slot"))
    run = Window.partitionBy("_sw_slot", position, "_sw_check").orderBy("_sw_doc", "_sw_pos")
    return placed.withColumn("_sw_first", F.first("_sw_doc").over(run))


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """Rows (_sw_doc, _sw_pos, _sw_hash, _sw_check) of the lines long enough to compare."""
    lines = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("_sw_doc"), F.posexplode(F.split(lower_ascii(F.col(text_col)), "\n", -1)).alias("_sw_pos", "_sw_line")
    )
    key = F.trim(F.col("_sw_line"), F.lit(ASCII_SPACE))
    return (
        lines.select("_sw_doc", "_sw_pos", key.alias("_sw_key"))
        .where(F.length("_sw_key") >= min_chars)
        .select("_sw_doc", "_sw_pos", F.xxhash64("_sw_key").alias("_sw_hash"), F.xxhash64(F.lit(1), F.col("_sw_key")).alias("_sw_check"))
    )


def drop_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """One row per document that loses lines.

    Columns: the id, ``n_dropped`` and ``drop_words``, an ascending array of
    (word, mask): bit ``b`` of ``word`` stands for line ``64 * word + b``; words
    that are absent keep all their lines.

    Rows with a null id or null text hold no key.  Rows that repeat an id count
    as one document.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    slots = shuffle_partitions(spark)
    keys = line_keys(docs, id_col, text_col, min_chars)
    bits = max(SALT_BITS, (slots // 4).bit_length())
    salt = F.shiftleft(F.xxhash64("_sw_doc").bitwiseAND(F.lit((1 << bits) - 1)), 64 - bits)
    spread = _first_holder(keys.withColumn("_sw_place", F.col("_sw_hash").bitwiseXOR(salt)), "_sw_place", slots)
    # Of lines that go only the place is needed further on.
    goes = F.col("_sw_doc") > F.col("_sw_first")
    kept = [F.when(~goes, F.col(c)).alias(c) for c in ("_sw_hash", "_sw_check")]
    spread = cut(spread.select("_sw_doc", "_sw_pos", "_sw_first", *kept))
    later = spread.where("_sw_doc > _sw_first").select("_sw_doc", "_sw_pos")
    firsts = spread.where("_sw_doc = _sw_first").select("_sw_doc", "_sw_pos", "_sw_hash", "_sw_check")
    beaten = _first_holder(firsts, "_sw_hash", slots).where("_sw_doc > _sw_first").select("_sw_doc", "_sw_pos")
    words = (
        later.unionByName(beaten)
        .groupBy("_sw_doc", F.shiftright("_sw_pos", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, _sw_pos & 63)")).alias("mask"))
    )
    return words.groupBy(F.col("_sw_doc").alias(id_col)).agg(
        F.sum(F.bit_count("mask")).cast("bigint").alias("n_dropped"),
        F.array_sort(F.collect_list(F.struct("word", "mask"))).alias("drop_words"),
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "kept_text") -> DataFrame:
    """``docs`` with ``out_col`` (the lines that stay, joined by a newline),
    ``n_lines`` (before dropping) and ``n_dropped``.

    A null text counts as one empty line and gives an empty ``out_col``.  Of
    clashing names, the columns made here win.
    """
    made = {out_col, "n_lines", "n_dropped"}
    base = docs.select(*[F.col(c) for c in docs.columns if c not in made or c == text_col])
    marks = bitmaps.select(F.col(id_col).alias("_sw_id"), F.col("n_dropped").alias("_sw_n"), F.col("drop_words").alias("_sw_words"))
    joined = base.join(marks.hint("shuffle_hash"), base[id_col] == marks["_sw_id"], "left")
    text = F.coalesce(F.col(text_col), F.lit(""))
    dense = F.expr(
        "flatten(transform(_sw_words, (x, i) -> concat("
        "array_repeat(0L, x.word - coalesce(get(_sw_words, i - 1).word, -1) - 1), array(x.mask))))"
    )
    joined = joined.withColumn("_sw_dense", F.when(F.col("_sw_words").isNotNull(), dense)).withColumn("_sw_text", text)
    kept = F.expr(
        "array_join(filter(split(_sw_text, '\\n', -1), (x, i) -> "
        "(shiftright(coalesce(get(_sw_dense, shiftright(i, 6)), 0L), i & 63) & 1L) = 0L), '\\n')"
    )
    return joined.select(
        *base.columns,
        F.when(F.col("_sw_words").isNull(), F.col("_sw_text")).otherwise(kept).alias("_sw_kept"),
        (F.octet_length("_sw_text") - F.octet_length(F.replace(F.col("_sw_text"), F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("n_lines"),
        F.coalesce(F.col("_sw_n"), F.lit(0)).cast("bigint").alias("n_dropped"),
    ).transform(lambda d: d.withColumn(out_col, F.col("_sw_kept")).drop("_sw_kept"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """Drops every repeated line except in the smallest document that holds it."""
    return apply_bitmaps(docs, drop_bitmaps(docs, id_col, text_col, min_chars), id_col, text_col)
