"""From raw documents to packed token sequences, by five of the text operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandweave.llm import stages
from strandweave.llm._common import shared_folder

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("language_id", stages.language_id),
    ("line_dedup", stages.line_deduplication),
    ("ngram_jaccard_join", stages.near_duplicates),
    ("packing", stages.token_packing),
]

#: Language models, token ids and bin packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again.

    A stage's input goes once its output is written; the last stage's stays until the caller has read the result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            gone = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return STAGES[-1][1](spark, docs, sf_dir)
