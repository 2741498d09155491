"""Declarative predicates over annotation columns.

A query is ``{"field": name, "operator": "exact" or "regex", "value": text}``.
Nulls count as the empty string; a regex is searched anywhere, without case.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandweave.errors import SchemaError


def query_mask(query: dict) -> Column:
    value = F.coalesce(F.col(query["field"]).cast("string"), F.lit(""))
    match query["operator"]:
        case "exact":
            return value == query["value"]
        case "regex":
            return value.rlike("(?i)" + query["value"])
    raise SchemaError(f"unknown operator {query['operator']!r}")


def combined(queries: list[dict], how: str = "all") -> Column:
    masks = [query_mask(q) for q in queries]
    match how:
        case "all":
            return reduce(lambda a, b: a & b, masks, F.lit(True))
        case "any":
            return reduce(lambda a, b: a | b, masks, F.lit(False))
    raise SchemaError(f"unknown combination {how!r}")


def captured(column: Column, pattern: str, group: int = 1) -> Column:
    """The captured group, null where the anchored pattern does not match."""
    return F.when(column.rlike(pattern), F.regexp_extract(column, pattern, group))


def stripped(column: Column, prefix: str) -> Column:
    """What follows the prefix, null without it."""
    return F.when(column.startswith(prefix), F.substring(column, len(prefix) + 1, 1 << 30))


def side_of(instance: Column) -> Column:
    """What follows the last underscore."""
    return F.substring_index(instance, "_", -1)


def finite(column: Column) -> Column:
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) != float("inf"))


def outside_unit(columns: list[str]) -> Column:
    """Whether any probability is not finite or outside 0 to 1."""
    return reduce(lambda a, b: a | b, [~F.coalesce(finite(F.col(c)) & F.col(c).between(0.0, 1.0), F.lit(False)) for c in columns])


def composite_key(parts: list[Column], unknown: str = "unknown") -> Column:
    return F.concat_ws(":", *[F.coalesce(F.nullif(p, F.lit("")), F.lit(unknown)) for p in parts])


def nested(path: str, default: float) -> Column:
    """A nested field, or the default where any step is absent."""
    return F.coalesce(F.col(path), F.lit(default))


def json_number(column: Column, path: str, default: float) -> Column:
    return F.coalesce(F.get_json_object(column, path).try_cast("double"), F.lit(default))


def packed_key(z: Column, y: Column, x: Column) -> Column:
    """(z << 42) | (y << 21) | x, null where a coordinate is out of range."""
    valid = x.between(0, (1 << 21) - 1) & y.between(0, (1 << 21) - 1) & z.between(0, (1 << 22) - 1)
    return F.when(valid, packed_bits(z, y, x))


def packed_bits(z: Column, y: Column, x: Column) -> Column:
    """(z << 42) | (y << 21) | x, whatever the coordinates: of one out of range the bits run into the next, which an audit counts."""
    return F.shiftleft(z.cast("bigint"), 42).bitwiseOR(F.shiftleft(y.cast("bigint"), 21)).bitwiseOR(x.cast("bigint"))


def unpacked(key: Column) -> tuple[Column, Column, Column]:
    low = F.lit((1 << 21) - 1)
    return F.shiftright(key, 42), F.shiftright(key, 21).bitwiseAND(low), key.bitwiseAND(low)


def selectivity(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), 0 where the sum is not positive."""
    return F.when(a + b > 0, (a - b) / (a + b)).otherwise(F.lit(0.0))


def saturating(x: Column, most: float, half: float, threshold: float = 0.0, floor: float = 0.0) -> Column:
    """most * d / (d + half) with d = |x| - threshold; 0 at or below the threshold and below the floor."""
    d = F.abs(x) - threshold
    rate = most * d / (d + half)
    return F.when(d <= 0, 0.0).when(rate < floor, 0.0).otherwise(rate)
