import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with extra columns whose names clash with those that operators make."""

    def make(rows, clash=True):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        if clash:
            from pyspark.sql import functions as F

            for name in ("n_lines", "kept", "score", "shard", "rank", "word", "h", "a", "b", "cls", "n", "id", "size", "kept_text", "is_listed", "_doc"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make
