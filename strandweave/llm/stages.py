"""The text pipeline's stages: each takes (spark, docs, sf_dir) and returns a DataFrame.

``docs`` has doc_id, text and lang, and any other columns, which are passed on whatever
their names.  All but the last stage return the columns of ``docs``.  An empty table
gives an empty one.  Rows that repeat are judged alike.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import jaccard, langid, line_dedup, packing, quality

#: Below this mean probability no language is accepted.
MIN_LANG_SCORE = 0.35
#: Most ids that are broadcast to be left out.
BROADCAST_IDS = 500_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands.

    Null and empty texts fail; a null id or language does not matter.
    """
    names = {c: f"_sw_{k}" for k, c in enumerate(docs.columns)}
    judged = quality.judge_quality(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col("text").alias("_sw_judged")), "_sw_judged", tuple(names.values()))
    return judged.where("kept").select(*[F.col(n).alias(c) for c, n in names.items()])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told.

    Null texts and texts without a letter go.  The model is fitted on rows with a language whose id is outside the
    held-out fold (a null id counts as outside); if there are none, no language can be told and all documents go.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = langid.fit(docs.where(F.coalesce(fold != 1, F.lit(True))))
    names = {c: f"_sw_{k}" for k, c in enumerate(docs.columns)}
    named = langid.identify(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col("text").alias("_sw_read")), model, "_sw_read", tuple(names.values()))
    return named.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANG_SCORE)).select(*[F.col(n).alias(c) for c, n in names.items()])


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier document holds.

    ``text`` and, where there is one, ``n_chars`` are those of what is left.  A null text becomes an empty one; rows with
    a null id keep all their lines; rows that repeat an id count as one document.
    """
    names = {c: f"_sw_{k}" for k, c in enumerate(docs.columns)}
    kept = line_dedup.dedup_lines(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names["doc_id"], names["text"])
    made = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("bigint")}
    return kept.select(*[made.get(c, F.col(n)).alias(c) for c, n in names.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of linked documents, one row for each id.

    Texts without words are linked with nothing and stay; so do all rows with a null id.  Of several rows of an id the one
    whose columns have the smallest hash stays.
    """
    links = jaccard.link_documents(docs.select("doc_id", "text"))
    gone = links.where("component_id <> doc_id").select(F.col("doc_id").alias("_sw_gone")).distinct()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    kept = docs.join(gone, docs["doc_id"] == gone["_sw_gone"], "left_anti")
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("_sw_rep")).agg(F.count("*").alias("_sw_n"), F.min(row).alias("_sw_row")).where("_sw_n > 1")
    if repeated.isEmpty():
        return kept
    alike = kept["doc_id"] == repeated["_sw_rep"]
    several = kept.join(repeated, alike & (row == F.col("_sw_row")), "left_semi").dropDuplicates(["doc_id"])
    return kept.join(repeated, alike, "left_anti").unionByName(several)


def token_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in packed sequences.

    A null text is empty and has the end id alone; repeated rows and null ids are packed like any others.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
