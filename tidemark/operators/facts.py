"""Metric facts: entity_id, ts, name, record_type, value, arrival_seq."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGGREGATE, ABSOLUTE = "aggregate", "absolute"
COLUMNS = ["entity_id", "ts", "name", "record_type", "value", "arrival_seq"]


def metric(entity: Column, name: Column, value: Column, record_type: str = AGGREGATE) -> Column:
    return F.struct(
        entity.cast("string").alias("entity_id"), name.alias("name"), F.lit(record_type).alias("record_type"), value.try_cast("bigint").alias("value")
    )


def fan_out(df: DataFrame, metrics: Sequence[Column], ts: str = "ts", seq: str = "arrival_seq") -> DataFrame:
    """One fact for each metric of each row; null metrics give none."""
    each = F.explode(F.filter(F.array(*metrics), lambda m: m.isNotNull()))
    return df.select(F.col(ts).alias("ts"), F.col(seq).alias("arrival_seq"), each.alias("m")).select(
        "m.entity_id", "ts", "m.name", "m.record_type", "m.value", "arrival_seq"
    )


def from_events(events: DataFrame) -> DataFrame:
    """Per event: a count and the truncated value as sums, the value as a last value. A value that is no
    64-bit number once cut (not finite, too large) is null, and null values are left out when stored."""
    user = F.concat(F.lit("user-"), F.col("user_id"))
    kind, whole = F.col("event_type"), F.col("value").try_cast("bigint")
    made = [
        metric(user, kind, F.lit(1)),
        metric(user, F.concat(kind, F.lit("-value")), whole),
        metric(user, F.concat(F.lit("last-"), kind), whole, ABSOLUTE),
    ]
    return fan_out(events.withColumn("ts", F.col("ts").cast("timestamp_ntz")), made, seq="event_id")


def from_orders(orders: DataFrame) -> DataFrame:
    """Per order: a count by priority and the last whole price; years of days, for long ranges."""
    customer = F.concat(F.lit("cust-"), F.col("o_custkey"))
    made = [
        metric(customer, F.col("o_orderpriority"), F.lit(1)),
        metric(customer, F.lit("last-price"), F.col("o_totalprice").try_cast("bigint"), ABSOLUTE),
    ]
    return fan_out(orders.withColumn("ts", F.col("o_orderdate").cast("timestamp_ntz")), made, seq="o_orderkey")


def _reserved(c: str) -> Column:
    return F.col(c).startswith("__") & F.col(c).endswith("__")


def reserved(facts: DataFrame) -> DataFrame:
    """Facts whose entity or name starts and ends with two underscores."""
    return facts.where(_reserved("entity_id") | _reserved("name"))


def accepted(facts: DataFrame, on_reserved: str = "raise") -> DataFrame:
    """Facts that may be stored. Empty and null names and null values are left out; reserved
    names raise an error, or are left out with on_reserved="drop"."""
    facts = facts.where((F.col("name") != "") & F.col("value").isNotNull())
    bad = _reserved("entity_id") | _reserved("name")
    if on_reserved == "drop":
        return facts.where(~bad)
    said = F.lit("entities and metrics that start and end with two underscores are reserved for meta data")
    return facts.withColumn("entity_id", F.when(bad, F.raise_error(said).cast("string")).otherwise(F.col("entity_id")))
