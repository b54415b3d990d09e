"""Merging metrics: sums and last values, bags of named metrics, and set operations on bags.

A bag is a DataFrame of name, record_type, value with any key columns before them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import full_match
from .facts import AGGREGATE

BAG = ["name", "record_type", "value"]
WIDE = "decimal(38,0)"


def total(value: str = "value", wide: bool = False) -> Column:
    """The sum, nulls as 0. wide: exact beyond 64 bits, as DECIMAL(38,0)."""
    v = F.col(value).cast(WIDE) if wide else F.col(value)
    return F.coalesce(F.sum(v), F.lit(0).cast(WIDE if wide else "bigint")).cast(WIDE if wide else "bigint")


def last(order: Column, value: str = "value") -> Column:
    """The last value that is not null, by order."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), order))


def summarize(rows: DataFrame, keys: Sequence[str], order: Column, wide: bool = True) -> DataFrame:
    """Fold bags in order: keys, name, record_type, value. A name of both record types is an error."""
    out = rows.groupBy(*keys, "name").agg(
        F.min("record_type").alias("record_type"), F.max("record_type").alias("_other"),
        total(wide=wide).alias("_sum"), last(order).alias("_last"),
    )
    clash = F.raise_error(F.concat(F.lit("cannot combine different record types: "), F.col("name"))).cast("string")
    record_type = F.when(F.col("record_type") != F.col("_other"), clash).otherwise(F.col("record_type"))
    value = F.when(F.col("_other") == AGGREGATE, F.col("_sum")).otherwise(F.col("_last").cast(WIDE if wide else "bigint"))
    return out.select(*keys, "name", record_type.alias("record_type"), value.alias("value"))


def overlay(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Where a bag has a name in both record types, the aggregate stands for both."""
    rest = [c for c in rows.columns if c not in (*keys, "name")]
    top = F.max_by(F.struct(*rest), F.col("record_type")).alias("t")  # 'aggregate' sorts after 'absolute'
    return rows.groupBy(*keys, "name").agg(top).select(*keys, "name", *[F.col(f"t.{c}").alias(c) for c in rest])


def keep_matching(bag: DataFrame, pattern: str) -> DataFrame:
    """The metrics whose whole name matches pattern."""
    return bag.where(full_match(F.col("name"), pattern))


def combine_matching(bag: DataFrame, pattern: str) -> DataFrame:
    """All metrics whose whole name matches pattern as one named `result`; an aggregate of 0 if none
    does. Absolute ones give the last by name; both record types together are an error."""
    found = keep_matching(bag, pattern).agg(
        F.coalesce(F.min("record_type"), F.lit(AGGREGATE)).alias("record_type"),
        F.coalesce(F.max("record_type"), F.lit(AGGREGATE)).alias("other"),
        total(wide=True).alias("sum"),
        F.max_by(F.col("value").cast(WIDE), "name").alias("last"),
    )
    clash = F.raise_error(F.lit("cannot combine different record types")).cast("string")
    return found.select(
        F.lit("result").alias("name"),
        F.when(F.col("record_type") != F.col("other"), clash).otherwise(F.col("record_type")).alias("record_type"),
        F.when(F.col("record_type") == AGGREGATE, F.col("sum")).otherwise(F.col("last")).alias("value"),
    )


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """The union of two bags; metrics of one name are summed, or the second one's stands."""
    both = first.select(*BAG, F.lit(0).alias("turn")).unionByName(second.select(*BAG, F.lit(1).alias("turn")))
    return summarize(both, [], F.col("turn"))


def difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """The metrics that only one of two bags has, name, record type and value taken together."""
    a, b = first.select(*BAG), second.select(*BAG)
    return a.subtract(b).unionByName(b.subtract(a))


def intersection(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.select(*BAG).intersect(second.select(*BAG))
