"""The queries over tiers: point, range, series, entities, and the admin verbs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.periods import (
    DEFAULT_TIERS, Period, bucket_end, bucket_start, end_of, least_granular, most_granular, spine, start_of,
    supported_granularity, to_dates,
)
from ..plans.cover import cover
from .combine import WIDE, combine_matching, keep_matching, overlay, summarize
from .tiers import entity_keys, fetch, within


class BadRequest(ValueError):
    """A request that cannot be answered; the message is the one a client sees."""


def required(name: str, value):
    if value is None:
        raise BadRequest(f"Parameter {name} required.")
    return value


def parse_instant(text: str) -> datetime:
    for f in ("%Y-%m-%d %H:%M:%S:%f", "%Y-%m-%d"):
        try:
            return datetime.strptime(text, f)
        except ValueError:
            continue
    raise BadRequest(f"Unable to parse date {text}")


def parse_period(text: str) -> Period:
    try:
        return Period.parse(text)
    except ValueError as e:
        raise BadRequest(str(e)) from None


def _tidy(bag: DataFrame, combine: str | None, field: str | None) -> DataFrame:
    """Combine first, then field: after a combine only `result` is left to match."""
    bag = combine_matching(bag, combine) if combine else bag
    return keep_matching(bag, field) if field else bag


def _bags(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    rows = overlay(rows, ["entity_id", "period", "bucket_start"])
    return summarize(rows, keys, F.struct("bucket_start", "last_seq"))


def point(tiers: DataFrame, entity: str, period: Period, date: datetime, combine: str | None = None, field: str | None = None, supported: Sequence[Period] = DEFAULT_TIERS) -> DataFrame:
    """The bag of the bucket that holds date, at exactly this period."""
    if period not in supported:
        raise BadRequest(f"Unable to parse period : {period} is not kept")
    return _tidy(_bags(fetch(tiers, entity, period, start_of(date, period))), combine, field)


def range_(tiers: DataFrame, entity: str, start: datetime, end: datetime, combine: str | None = None, field: str | None = None, supported: Sequence[Period] = DEFAULT_TIERS) -> DataFrame:
    """The bag of a range of time, the finest bucket of its end included, from the tiers that cover it."""
    rows = tiers.where((F.col("entity_id") == entity) & within(cover(start, end, supported)))
    return _tidy(_bags(rows), combine, field)


#: Up to so many entities are a literal list, which the scan filters by; more, or a table, are joined.
FEW = 100


def _asked(tiers: DataFrame, entities: Sequence[str] | DataFrame) -> DataFrame:
    """entity_id, each once."""
    if isinstance(entities, DataFrame):
        return entities.select("entity_id").where(F.col("entity_id").isNotNull()).distinct()
    return tiers.sparkSession.createDataFrame([(e,) for e in dict.fromkeys(entities)], "entity_id string")


def _of(tiers: DataFrame, entities: Sequence[str] | DataFrame) -> DataFrame:
    """The rows of the entities. A table of them is semi-joined: Spark broadcasts it where it is small, and else shuffles by entity, as the
    aggregation that follows does anyway."""
    if not isinstance(entities, DataFrame) and len(entities) <= FEW:
        return tiers.where(F.col("entity_id").isin(*entities))
    return tiers.join(_asked(tiers, entities), "entity_id", "left_semi")


def ranges(tiers: DataFrame, entities: Sequence[str] | DataFrame, start: datetime, end: datetime, combine: str | None = None, field: str | None = None, supported: Sequence[Period] = DEFAULT_TIERS) -> DataFrame:
    """A bag for each of many entities, given as a list or as a table with the column entity_id."""
    rows = _of(tiers.where(within(cover(start, end, supported))), entities)
    bags = _bags(rows, ["entity_id"])
    if combine:
        keep = keep_matching(bags, combine)
        found = summarize(keep.select("entity_id", F.lit("result").alias("name"), "record_type", "value", F.col("name").alias("o")), ["entity_id"], F.col("o"))
        bags = _asked(tiers, entities).join(found, "entity_id", "left").select(
            "entity_id", F.lit("result").alias("name"), F.coalesce("record_type", F.lit("aggregate")).alias("record_type"),
            F.coalesce("value", F.lit(0).cast(WIDE)).alias("value"),
        )
    return keep_matching(bags, field) if field else bags


def series(tiers: DataFrame, entities: Sequence[str] | DataFrame, period: Period, start: datetime, end: datetime, supported: Sequence[Period] = DEFAULT_TIERS) -> DataFrame:
    """entity_id, bucket_start, bucket_end, name, record_type, value for every bucket that starts
    before end, those without data with a null name, in order of entity, time and name. A period that is not kept is rolled up from
    the next finer tier; its edge buckets hold only what the range holds."""
    tier = supported_granularity(period, supported)
    dates = to_dates(start, end, tier)
    frame = _asked(tiers, entities).select("entity_id", F.explode(spine(start, end, tier)).alias("bucket_start"))
    if not dates:
        rows = tiers.where("false")
    else:
        rows = _of(tiers.where(within([(tier, dates[0], dates[-1])])), entities)
    rows = overlay(rows, ["entity_id", "period", "bucket_start"])
    if period is not tier:
        frame = frame.select("entity_id", bucket_start(F.col("bucket_start"), period).alias("bucket_start")).distinct()
        rows = rows.withColumn("at", F.col("bucket_start")).withColumn("bucket_start", bucket_start(F.col("bucket_start"), period))
        rows = summarize(rows, ["entity_id", "bucket_start"], F.struct("at", "last_seq"))
    rows = rows.select("entity_id", "bucket_start", "name", "record_type", F.col("value").cast(WIDE).alias("value"))
    return frame.join(rows, ["entity_id", "bucket_start"], "left").select(
        "entity_id", "bucket_start", bucket_end(F.col("bucket_start"), period).alias("bucket_end"), "name", "record_type", "value"
    ).orderBy("entity_id", "bucket_start", "name")


def find(tiers: DataFrame, entity: str, period: Period, date: datetime, supported: Sequence[Period] = DEFAULT_TIERS) -> DataFrame:
    """The rows of the bucket of period that holds date, from the next finer tier (and unmerged) where
    the period is not kept."""
    tier = supported_granularity(period, supported)
    return tiers.where((F.col("entity_id") == entity) & within([(tier, start_of(date, period), end_of(date, period))]))


def find_range(tiers: DataFrame, entity: str, period: Period, start: datetime, end: datetime) -> DataFrame:
    """The rows of one tier's buckets that start before end, without another tier's help."""
    dates = to_dates(start, end, period)
    return tiers.where((F.col("entity_id") == entity) & (within([(period, dates[0], dates[-1])]) if dates else F.lit(False)))


def entities(tiers: DataFrame, contains: str | None = None, limit: int = -1, supported: Sequence[Period] = DEFAULT_TIERS) -> DataFrame:
    """The distinct entities, those that contain a text, the first `limit` by id."""
    found = entity_keys(tiers, least_granular(supported))
    found = found.where(F.col("entity_id").contains(contains)) if contains else found
    return found.orderBy("entity_id").limit(limit) if limit >= 0 else found


def list_entities(tiers: DataFrame, filters: Sequence[str], supported: Sequence[Period] = DEFAULT_TIERS) -> DataFrame:
    """The distinct entities that contain any of the texts; all without one."""
    found = entity_keys(tiers, least_granular(supported))
    some: Column | None = reduce(lambda a, b: a | b, [F.col("entity_id").contains(f) for f in filters]) if filters else None
    return found if some is None else found.where(some)


def dump(tiers: DataFrame, filters: Sequence[str] = (), supported: Sequence[Period] = DEFAULT_TIERS) -> DataFrame:
    """The finest tier's rows of the entities that contain any of the texts, as a dump file has them."""
    from ..functions.periods import millis

    rows = tiers.where(F.col("period") == str(most_granular(supported)))
    if filters:
        rows = rows.where(reduce(lambda a, b: a | b, [F.col("entity_id").contains(f) for f in filters]))
    return rows.select("entity_id", millis(F.col("bucket_start")).alias("timestamp"), "name", "record_type", "value")


class DumpMismatch(RuntimeError):
    """The coarsest and the finest tier name different metrics, so a dump would not be whole."""


def write_verified(tiers: DataFrame, path: str, write: Callable[[DataFrame, str], None], filters: Sequence[str] = (), supported: Sequence[Period] = DEFAULT_TIERS) -> int:
    """Write a dump (`dump`) with write(rows, path) and return its number of rows.

    In each bucket of the coarsest tier both tiers must name the same metrics. That is found while the rows are written: one scan
    reads the two tiers, a window brings a bucket's metric together, and observed counts of what a side lacks are read
    when the write is done. If there is any, the error names the counts; the file is then not to be used.
    """
    coarse, fine = least_granular(supported), most_granular(supported)
    rows = tiers.where(F.col("period").isin(str(coarse), str(fine)))
    if filters:
        rows = rows.where(reduce(lambda a, b: a | b, [F.col("entity_id").contains(f) for f in filters]))
    is_fine = F.col("period") == str(fine)
    metric = Window.partitionBy("entity_id", bucket_start(F.col("bucket_start"), coarse), "name")
    rows = rows.withColumn("_fine", F.max(is_fine).over(metric)).withColumn("_coarse", F.max(~is_fine).over(metric))
    seen = Observation()
    rows = rows.observe(
        seen, F.count_if(is_fine).alias("rows"), F.count_if(is_fine & ~F.col("_coarse")).alias("not_coarse"), F.count_if(~is_fine & ~F.col("_fine")).alias("not_fine")
    )
    write(dump(rows, supported=supported), path)
    got = seen.get
    if got["not_coarse"] or got["not_fine"]:
        raise DumpMismatch(f"{got['not_fine']} {coarse} metrics have no {fine} rows, {got['not_coarse']} {fine} rows have no {coarse} metric")
    return got["rows"]


def slice_counts(tiers: DataFrame, period: Period) -> DataFrame:
    """How many names each bucket of a tier has."""
    return tiers.where(F.col("period") == str(period)).groupBy("entity_id", "bucket_start").agg(F.countDistinct("name").alias("names"))


def fill(dumped: DataFrame, supported: Sequence[Period] = DEFAULT_TIERS) -> DataFrame:
    """Facts from dump rows, at the finest tier's bucket starts; the tiers of these are the store's."""
    from ..functions.periods import from_millis

    ts = bucket_start(from_millis(F.col("timestamp").cast("bigint")), most_granular(supported))
    return dumped.select(
        "entity_id", ts.alias("ts"), "name", F.lower("record_type").alias("record_type"), F.col("value").cast("bigint").alias("value"),
        F.col("timestamp").cast("bigint").alias("arrival_seq"),
    )


def fsck(tiers: DataFrame, supported: Sequence[Period] = DEFAULT_TIERS) -> DataFrame:
    """The buckets of each tier that differ from what the next finer tier sums up to.

    One row per differing metric: period, entity_id, bucket_start, name, stored, expected; null
    where a side lacks it. Every bucket of every tier but the finest is checked. The tiers are read once:
    a row stands for itself and, in the bucket above it, for what that should hold, and one
    aggregation brings both together.
    """
    steps = sorted(supported)
    above = {str(down): up for up, down in zip(steps, steps[1:], strict=False)}
    row = ["period", "bucket_start", "stored"]
    own = F.struct(F.col("period"), F.col("bucket_start"), F.lit(True).alias("stored"))
    up = F.lit(None).cast("struct<period:string,bucket_start:timestamp_ntz,stored:boolean>")
    for down, p in above.items():
        at = F.struct(F.lit(str(p)).alias("period"), bucket_start(F.col("bucket_start"), p).alias("bucket_start"), F.lit(False).alias("stored"))
        up = F.when(F.col("period") == down, at).otherwise(up)
    rows = tiers.where(F.col("period").isin(*map(str, steps))).select(
        "entity_id", "name", "record_type", "value", F.col("bucket_start").alias("at"), "last_seq", F.explode(F.array(own, up)).alias("t")
    )
    rows = rows.where(F.col("t").isNotNull() & (F.col("t.period") != str(steps[-1])))
    rows = rows.select(*[F.col(f"t.{c}").alias(c) for c in row], "entity_id", "name", "record_type", "value", "at", "last_seq")
    keys = ["period", "entity_id", "bucket_start"]
    sums = summarize(rows, [*keys, "stored"], F.struct("at", "last_seq"))
    both = sums.groupBy(*keys, "name").agg(
        F.max(F.when(F.col("stored"), F.col("value"))).alias("stored"), F.max(F.when(~F.col("stored"), F.col("value"))).alias("expected")
    )
    return both.where(~F.col("stored").eqNullSafe(F.col("expected")))


def health(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("ok").alias("status"))
