"""Tables that lie on disk as later joins and groupings need them."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from strandweave.operators.ordered import shared_folder


@dataclass
class Bucketed:
    """A written table whose rows are dealt into buckets by key and sorted in each."""

    name: str
    path: str
    df: DataFrame

    def drop(self) -> None:
        """Takes the table out of the catalog and removes its files."""
        spark = self.df.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS `{self.name}`")
        gone = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def write_bucketed(df: DataFrame, keys: list[str], buckets: int | None = None, sort: list[str] | None = None, path: str | None = None, name: str | None = None) -> Bucketed:
    """``df`` written as Parquet in ``buckets`` (by default as many as there are shuffle partitions) by ``keys``.

    Joins and groupings by these keys with tables of as many buckets need no exchange.  Without a path it lies
    in the shared folder, under a name of its own, until ``drop`` is called.  A path that holds something is refused.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = name or f"strandweave_{uuid.uuid4().hex}"
    path = path or f"{shared_folder(spark)}/{name}"
    # One file a bucket: rows go to the task that writes their bucket.
    writer = df.repartition(buckets, *keys).write.mode("errorifexists").format("parquet").option("compression", "zstd")
    writer.bucketBy(buckets, *keys).sortBy(*(sort or keys)).option("path", path).saveAsTable(name)
    return Bucketed(name, path, spark.table(name))


def open_bucketed(spark: SparkSession, name: str, path: str, schema: str, keys: list[str], buckets: int, sort: list[str] | None = None) -> Bucketed:
    """A table that an earlier session wrote with ``write_bucketed``, entered into this one's catalog."""
    by = lambda columns: ", ".join(f"`{c}`" for c in columns)
    spark.sql(f"CREATE TABLE `{name}` ({schema}) USING parquet CLUSTERED BY ({by(keys)}) SORTED BY ({by(sort or keys)}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return Bucketed(name, path, spark.table(name))
