"""Audits of contact tables: keys, endpoints, totals, fan-out, thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, key: Column) -> DataFrame:
    """One row ``observed``: rows minus distinct keys.  Keys are counted where they lie, then merged."""
    return df.select(key.alias("k")).groupBy("k").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n")).otherwise(F.col("n") - 1)), F.lit(0)).cast("bigint").alias("observed"))


def unmatched(rows: DataFrame, reference: DataFrame, on: list[str]) -> DataFrame:
    """Rows that agree with no reference row in all of ``on``."""
    return rows.join(reference.select(*on).distinct(), on, "left_anti")


def unresolved(rows: DataFrame, reference: DataFrame, on: tuple[str, str], agree: tuple[tuple[str, str], ...]) -> DataFrame:
    """Rows whose key meets no reference row with the same attributes; pairs name a column of either side, nulls agree with nothing.

    The join is by key alone, with the attributes compared behind it, so that tables bucketed by key need no exchange.
    """
    a, b = rows.alias("a"), reference.select(*{on[1], *[y for _, y in agree]}).alias("b")
    met = F.col(f"a.{on[0]}") == F.col(f"b.{on[1]}")
    for x, y in agree:
        met = met & F.col(f"a.{x}").between(F.col(f"b.{y}"), F.col(f"b.{y}"))  # not an equality, which would be a join key
    return a.join(b, met, "left_anti")


def reconcile(observed: DataFrame, official: DataFrame, keys: list[str], weight: str = "weight") -> DataFrame:
    """Keys whose re-aggregated weight is not the official one, with both (null where absent)."""
    a = observed.select(*keys, F.col(weight).alias("observed_weight"))
    b = official.select(*keys, F.col(weight).alias("official_weight"))
    return a.join(b, keys, "full_outer").where(~F.col("observed_weight").eqNullSafe(F.col("official_weight")))


def fanout_profile(df: DataFrame, site: list[str]) -> DataFrame:
    """Sites, those with more than one partner, and the largest number of partners."""
    per_site = df.groupBy(*site).agg(F.count("*").alias("n"))
    return per_site.agg(F.count("*").alias("sites"), F.count_if(F.col("n") > 1).alias("polyadic_sites"), F.coalesce(F.max("n"), F.lit(0)).cast("bigint").alias("max_fanout"))


def fanout_histogram(df: DataFrame, site: list[str]) -> DataFrame:
    return df.groupBy(*site).agg(F.count("*").alias("fanout")).groupBy("fanout").agg(F.count("*").alias("sites"))


def threshold_counts(df: DataFrame, score: Column, thresholds: tuple[float, ...]) -> DataFrame:
    """(threshold, kept) for each threshold, in one pass, and whether counts never rise with it."""
    one = df.select(score.alias("s")).agg(*[F.count_if(F.col("s") >= t).alias(f"c{i}") for i, t in enumerate(thresholds)])
    falling = reduce(lambda a, b: a & b, [F.col(f"c{i}") >= F.col(f"c{i + 1}") for i in range(len(thresholds) - 1)], F.lit(True))
    pairs = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"c{i}").alias("kept")) for i, t in enumerate(thresholds)])
    return one.select(falling.alias("monotone"), F.explode(pairs).alias("p")).select("p.threshold", "p.kept", "monotone")


def audit(checks: list[tuple[str, DataFrame, int]]) -> DataFrame:
    """One table (check_name, observed, expected, passed) from one-row frames with ``observed``."""
    rows = [
        df.select(F.lit(name).alias("check_name"), F.col("observed").cast("bigint").alias("observed"), F.lit(expected).cast("bigint").alias("expected"))
        for name, df, expected in checks
    ]
    return reduce(DataFrame.unionByName, rows).withColumn("passed", F.col("observed") == F.col("expected"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def exactly_one(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Each wanted key with its number of matches and whether that is one."""
    counts = table.groupBy(key).agg(F.count("*").alias("matches"))
    return keys.select(key).distinct().join(counts, key, "left").select(key, F.coalesce("matches", F.lit(0)).cast("bigint").alias("matches")).withColumn("passed", F.col("matches") == 1)


def claimed_events(events: DataFrame, trace: DataFrame, on: str, state: str) -> DataFrame:
    """Claimed events whose moment has no trace row, or one in another state."""
    t = trace.select(on, F.col(state).alias("_state"))
    return events.join(t, on, "left").where(~F.col("_state").eqNullSafe(F.col(state))).withColumn("fault", F.when(F.col("_state").isNull(), "absent").otherwise("state")).drop("_state")


def structural_review(measured: DataFrame, published: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(name, measured, published, relative_error, passed)."""
    err = F.abs(F.col("measured") - F.col("published")) / F.abs(F.col("published"))
    return measured.join(published, "name").withColumn("relative_error", err).withColumn("passed", err <= tolerance)
