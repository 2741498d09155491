"""Order over a whole table without gathering it in one task."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where it is unset and the master is local."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="strandweave-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` materialised in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def with_next(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: ``value`` of the next row in the order, null for the last row.

    Rows are sorted by range partition; only the first row of each partition is
    passed to the partition before it.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    firsts = parts.groupBy("_part").agg(F.min_by(value, F.struct(*order)).alias("_first"))
    # One row for each partition.
    firsts = firsts.select("_part", F.lead("_first").over(Window.orderBy("_part")).alias("_carry"))
    own = Window.partitionBy("_part").orderBy(*order)
    last = F.row_number().over(Window.partitionBy("_part").orderBy(*[F.col(c).desc() for c in order])) == 1
    return (
        parts.withColumn("_lead", F.lead(value).over(own)).withColumn("_last", last).join(F.broadcast(firsts), "_part")
        .withColumn(out, F.when(F.col("_last"), F.col("_carry")).otherwise(F.col("_lead")))
        .drop("_part", "_lead", "_last", "_carry")
    )


def next_from(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the first ``value`` that is not null, of this row and those behind it in the order; null if there is none.

    Rows are sorted by range partition; only the first such value of each partition is passed to those before it.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    held = F.when(F.col(value).isNotNull(), F.struct(*order))
    # One row for each partition.
    firsts = parts.groupBy("_part").agg(F.min_by(value, held).alias("_first"))
    firsts = firsts.select("_part", F.first("_first", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)).alias("_carry"))
    # From the end, as a frame that ends with the row is filled in one pass.
    back = Window.partitionBy("_part").orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = parts.withColumn("_own", F.last(value, ignorenulls=True).over(back)).join(F.broadcast(firsts), "_part")
    return own.withColumn(out, F.coalesce("_own", "_carry")).drop("_part", "_own", "_carry")


def ranked(df: DataFrame, column: str, out: str = "rank") -> DataFrame:
    """Adds average ranks from 1, ties sharing theirs.

    Ranks are counted on distinct values: values and their counts are sorted by
    range partition, and each partition starts from the total of those before it.
    """
    values = df.groupBy(column).agg(F.count("*").alias("_n"))
    parts = cut(values.repartitionByRange(column).withColumn("_part", F.spark_partition_id()))
    totals = parts.groupBy("_part").agg(F.sum("_n").alias("_total"))
    before = F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    upto = F.sum("_n").over(Window.partitionBy("_part").orderBy(column))
    ranks = parts.withColumn("_upto", upto).join(F.broadcast(totals), "_part")
    ranks = ranks.select(F.col(column).alias("_value"), (F.col("_before") + F.col("_upto") - (F.col("_n") - 1) / 2).alias(out))
    return df.join(ranks, df[column].eqNullSafe(ranks["_value"])).drop("_value")


def positions(df: DataFrame, order: list[str], out: str = "position") -> DataFrame:
    """Adds ``out``, the place from 0 in the order over the whole table; rows alike in ``order`` follow each other anyhow.

    Rows are sorted by range partition, and only the row count of each partition is passed on.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # One row for each partition.
    carry = parts.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_own", own).join(F.broadcast(carry), "_part").withColumn(out, F.col("_before") + F.col("_own") - 1).drop("_part", "_own", "_before")


def quantiles(df: DataFrame, group: list[str], value: str, at: tuple[float, ...], out: str = "q") -> DataFrame:
    """(group, ``out``): exact quantiles with linear interpolation as an array, of the values that are not null.

    Values are counted first, then sorted by range partition of group and value; each partition takes up the counts of
    its groups from those before it, so a group of any size is spread over tasks.
    """
    named = [F.col(c).alias(f"_g{k}") for k, c in enumerate(group)]
    keys = [f"_g{k}" for k in range(len(group))]
    counts = df.where(F.col(value).isNotNull()).groupBy(*named, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    parts = cut(counts.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()))
    shares = parts.groupBy(*keys, "_part").agg(F.sum("_n").alias("_own"))
    over = Window.partitionBy(*keys)
    shares = shares.withColumn("_before", F.coalesce(F.sum("_own").over(over.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_own").over(over))
    shares = shares.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_s{k}") for k in keys], "_before", "_all")
    met = F.col("_part") == F.col("_p")
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_s{k}"))
    each = parts.join(shares, met).select(*keys, "_part", "_v", "_n", "_before", "_all")
    upto = F.sum("_n").over(Window.partitionBy("_part", *keys).orderBy("_v")) + F.col("_before")
    each = each.withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col("_n"))

    def held(place):
        return F.max(F.when((F.col("_from") <= place) & (place < F.col("_upto")), F.col("_v")))

    found = []
    for k, a in enumerate(at):
        place = (F.col("_all") - 1) * F.lit(float(a))
        found += [held(F.floor(place)).alias(f"_lo{k}"), held(F.ceil(place)).alias(f"_hi{k}")]
    got = each.groupBy(*keys).agg(F.max("_all").alias("_all"), *found)
    parts_of = [(F.col("_all") - 1) * F.lit(float(a)) - F.floor((F.col("_all") - 1) * F.lit(float(a))) for a in at]
    values = [F.when(f == 0, F.col(f"_lo{k}")).otherwise(F.col(f"_lo{k}") * (1 - f) + F.col(f"_hi{k}") * f) for k, f in enumerate(parts_of)]
    return got.select(*[F.col(k).alias(c) for k, c in zip(keys, group, strict=True)], F.array(*values).alias(out))
