"""The registered queries over the driver's tables, and the SQL that each must agree with."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import identifiers as ids
from .functions import periods as per
from .functions.periods import DEFAULT_TIERS, Period
from .operators import combine, domain_events, facts, tiers, verbs
from .plans.cover import cover
from .sources import files, messages, records
from .streaming import held, ingest, progress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

START, END = datetime(2024, 1, 10, 8, 7), datetime(2024, 1, 12, 17, 20)
USER, USERS = "user-7", ["user-3", "user-7", "user-11", "nobody"]

#: The facts of the events table in SQL.
FACTS = """
    SELECT 'user-' || user_id AS entity_id, ts, event_type AS name, 'aggregate' AS record_type, 1::BIGINT AS value, event_id AS arrival_seq FROM events
    UNION ALL SELECT 'user-' || user_id, ts, event_type || '-value', 'aggregate', trunc(value)::BIGINT, event_id FROM events
    UNION ALL SELECT 'user-' || user_id, ts, 'last-' || event_type, 'absolute', trunc(value)::BIGINT, event_id FROM events
"""
#: How SQL starts a bucket.
TRUNC = {
    Period.SECONDLY: "date_trunc('second', ts)", Period.MINUTELY: "date_trunc('minute', ts)", Period.FIFTEEN_MINUTE: "time_bucket(INTERVAL 15 MINUTE, ts)",
    Period.HOURLY: "date_trunc('hour', ts)", Period.DAILY: "date_trunc('day', ts)", Period.WEEKLY: "(date_trunc('day', ts) - to_days(dayofweek(ts)::INT))",
    Period.MONTHLY: "date_trunc('month', ts)", Period.YEARLY: "date_trunc('year', ts)",
}
WIDTH = {
    Period.SECONDLY: "1 SECOND", Period.MINUTELY: "1 MINUTE", Period.FIFTEEN_MINUTE: "15 MINUTE", Period.HOURLY: "1 HOUR", Period.DAILY: "1 DAY",
    Period.WEEKLY: "7 DAY", Period.MONTHLY: "1 MONTH", Period.YEARLY: "1 YEAR",
}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz")) if table == "events" else df


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events")


def event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.from_events(events(spark, sf_dir))


#: (application, sf_dir, its files) -> the store that its reads share.
_STORES: dict[tuple, tiers.Store] = {}


def _stamp(spark: SparkSession, path: str) -> tuple:
    """The files at a path with their lengths and times: another one where they have changed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


def event_tiers(spark: SparkSession, sf_dir: str, entities: list[str] | None = None) -> DataFrame:
    """The tiers of the events, read from a store that a session writes once; with entities, from the files that may hold them."""
    key = (spark.sparkContext.applicationId, sf_dir, _stamp(spark, f"{sf_dir}/events.parquet"))
    if key not in _STORES:
        store = tiers.Store(spark, scratch(spark, "event-tiers"))
        store.persist(event_facts(spark, sf_dir), index=True)
        _STORES[key] = store
    return _STORES[key].read(entities)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share; on one machine a temporary one, where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Periods

for _p in TRUNC:

    @query(
        f"trunc_{_p}",
        f"SELECT event_id, {TRUNC[_p]}::TIMESTAMP AS bucket_start, {TRUNC[_p]} + INTERVAL {WIDTH[_p]} - INTERVAL 1 MILLISECOND AS bucket_end FROM events",
    )
    def _trunc(spark, sf_dir, p=_p):
        e = events(spark, sf_dir)
        return e.select("event_id", per.bucket_start(F.col("ts"), p).alias("bucket_start"), per.bucket_end(F.col("ts"), p).alias("bucket_end"))


@query("trunc_forever", "SELECT event_id, TIMESTAMP '0001-01-01 00:00:00' AS bucket_start FROM events")
def _forever(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", per.bucket_start(F.col("ts"), Period.FOREVER).alias("bucket_start"))


@query(
    "boundary_test",
    "SELECT event_id, ts = date_trunc('day', ts) OR ts = date_trunc('day', ts) + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND AS daily, "
    "ts = date_trunc('minute', ts) OR ts = date_trunc('minute', ts) + INTERVAL 1 MINUTE - INTERVAL 1 MILLISECOND AS minutely FROM events",
)
def _boundary(spark, sf_dir):
    ts = F.col("ts")
    return events(spark, sf_dir).select(
        "event_id", per.lies_on_boundary(ts, Period.DAILY).alias("daily"), per.lies_on_boundary(ts, Period.MINUTELY).alias("minutely")
    )


@query("range_includes", f"SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'")
def _includes(spark, sf_dir):
    return events(spark, sf_dir).where(per.includes(F.col("ts"), START, END)).select("event_id", "ts")


@query("aligned_dates", "SELECT unnest(generate_series(TIMESTAMP '2024-01-10 08:00:00', TIMESTAMP '2024-01-12 17:00:00', INTERVAL 1 HOUR)) AS bucket_start")
def _dates(spark, sf_dir):
    return spark.range(1).select(F.explode(per.spine(START, END, Period.HOURLY)).alias("bucket_start"))


@query("slice_floor", "SELECT event_id, epoch_ms(epoch_ms(date_trunc('millisecond', ts)) - epoch_ms(date_trunc('millisecond', ts)) % 120000) AS slice FROM events")
def _slice(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", per.slice_floor(F.col("ts")).alias("slice"))


@query(
    "parse_dates",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE o_orderdate END AS parsed FROM orders",
)
def _parse_dates(spark, sf_dir):
    day, key = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 3
    text = F.when(key == 0, day).when(key == 1, F.concat(day, F.lit(" 00:00:00:000"))).otherwise(F.concat(day, F.lit(" junk")))
    return read(spark, sf_dir, "orders").select("o_orderkey", ids.parse_date(text).alias("parsed"))


@query(
    "parse_values",
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN trunc(value)::BIGINT WHEN 1 THEN trunc(value)::BIGINT WHEN 2 THEN NULL ELSE NULL END AS parsed FROM events",
)
def _parse_values(spark, sf_dir):
    k, v = F.col("event_id") % 4, F.col("value")
    text = F.when(k == 0, v.cast("string")).when(k == 1, v.cast("bigint").cast("string")).when(k == 2, "NULL").otherwise("x1")
    return events(spark, sf_dir).select("event_id", ids.parse_value(text).alias("parsed"))


# Tiers

for _p in DEFAULT_TIERS:
    for _t in ("aggregate", "absolute"):
        _agg = "sum(value)::BIGINT" if _t == "aggregate" else "arg_max(value, arrival_seq)"

        @query(
            f"tier_{_p}_{_t}",
            f"SELECT entity_id, {TRUNC[_p]}::TIMESTAMP AS bucket_start, name, {_agg} AS value FROM ({FACTS}) WHERE record_type = '{_t}' GROUP BY ALL",
        )
        def _tier(spark, sf_dir, p=_p, t=_t):
            rows = tiers.build(event_facts(spark, sf_dir)).where((F.col("period") == str(p)) & (F.col("record_type") == t))
            return rows.select("entity_id", "bucket_start", "name", "value")


@query(
    "tier_orders_yearly",
    "SELECT 'cust-' || o_custkey AS entity_id, date_trunc('year', o_orderdate)::TIMESTAMP AS bucket_start, o_orderpriority AS name, count(*) AS value FROM orders GROUP BY ALL",
)
def _orders_yearly(spark, sf_dir):
    rows = tiers.build(facts.from_orders(read(spark, sf_dir, "orders")), (Period.DAILY, Period.MONTHLY, Period.YEARLY))
    rows = rows.where("period = 'yearly' and record_type = 'aggregate'")
    return rows.select("entity_id", "bucket_start", "name", "value")


def _tier_sql(p: Period) -> str:
    return (
        f"SELECT '{p}' AS period, record_type, entity_id, {TRUNC[p]}::TIMESTAMP AS bucket_start, name, "
        "CASE WHEN record_type = 'aggregate' THEN sum(value)::BIGINT ELSE arg_max(value, arrival_seq) END AS value, max(arrival_seq) AS last_seq "
        f"FROM ({FACTS}) GROUP BY record_type, entity_id, bucket_start, name"
    )


ALL_TIERS = " UNION ALL ".join(_tier_sql(p) for p in DEFAULT_TIERS)


@query("store_persist", f"SELECT period, record_type, entity_id, bucket_start, name, value, last_seq FROM ({ALL_TIERS})")
def _persist(spark, sf_dir):
    """Two batches, one of them written twice; the store merges them."""
    f = event_facts(spark, sf_dir)
    store = tiers.Store(spark, scratch(spark, "tiers"))
    store.persist(f.where("arrival_seq % 2 = 0"), 0)
    store.persist(f.where("arrival_seq % 2 = 1"), 1)
    store.persist(f.where("arrival_seq % 2 = 1"), 1)
    return store.read()


@query("store_compacted", f"SELECT period, record_type, entity_id, bucket_start, name, value, last_seq FROM ({ALL_TIERS})")
def _compacted(spark, sf_dir):
    """Batches before and after a compaction, one of them replayed after it."""
    f = event_facts(spark, sf_dir)
    store = tiers.Store(spark, scratch(spark, "tiers"))
    store.persist(f.where("arrival_seq % 3 = 0"), 0)
    store.persist(f.where("arrival_seq % 3 = 1"), 1)
    store.compact()
    store.persist(f.where("arrival_seq % 3 = 1"), 1)
    store.persist(f.where("arrival_seq % 3 = 2"), 2)
    return store.read()


_DAY = datetime(2024, 1, 12)


@query(
    "bucket_fetch",
    f"SELECT record_type, name, value FROM ({_tier_sql(Period.DAILY)}) WHERE entity_id = '{USER}' AND bucket_start = TIMESTAMP '{_DAY}'",
)
def _fetch(spark, sf_dir):
    return tiers.fetch(event_tiers(spark, sf_dir, [USER]), USER, Period.DAILY, _DAY).select("record_type", "name", "value")


@query(
    "family_scan",
    f"SELECT name, value FROM ({_tier_sql(Period.DAILY)}) WHERE record_type = 'absolute' AND entity_id = '{USER}' AND bucket_start = TIMESTAMP '{_DAY}'",
)
def _family(spark, sf_dir):
    return tiers.family(event_tiers(spark, sf_dir, [USER]), "absolute", USER, Period.DAILY, _DAY).select("name", "value")


@query("distinct_keys", "SELECT DISTINCT 'user-' || user_id AS entity_id FROM events")
def _keys(spark, sf_dir):
    return tiers.entity_keys(event_tiers(spark, sf_dir), Period.YEARLY)


def _plan_sql() -> str:
    return " OR ".join(f"(period = '{p}' AND bucket_start BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}')" for p, a, b in cover(START, END))


@query("multi_bucket_read", f"SELECT period, bucket_start, name, value FROM ({ALL_TIERS}) WHERE entity_id = '{USER}' AND ({_plan_sql()})")
def _multi(spark, sf_dir):
    rows = event_tiers(spark, sf_dir).where((F.col("entity_id") == USER) & tiers.within(cover(START, END)))
    return rows.select("period", "bucket_start", "name", "value").orderBy("bucket_start", "period", "name")


@query(
    "composite_keys",
    "SELECT DISTINCT 'user-' || user_id || '-' || epoch_ms(date_trunc('day', ts)) AS row_key, 'user-' || user_id AS entity_id, 'daily_aggregate' AS table_name FROM events",
)
def _composite(spark, sf_dir):
    rows = event_tiers(spark, sf_dir).where("period = 'daily' and record_type = 'aggregate'")
    key = ids.row_key(F.col("entity_id"), per.millis(F.col("bucket_start")))
    return rows.select(
        key.alias("row_key"), ids.strip_timestamp(key).alias("entity_id"), ids.table_name(F.col("period"), F.col("record_type")).alias("table_name")
    ).distinct()


# Reads


def _bag_sql(where: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return (
        f"SELECT {k}name, min(record_type) AS record_type, CASE WHEN min(record_type) = 'aggregate' THEN sum(value) "
        f"ELSE arg_max(value, arrival_seq) END::DECIMAL(38,0) AS value FROM ({FACTS}) WHERE {where} GROUP BY {k}name"
    )


RANGE = "ts >= TIMESTAMP '2024-01-10 08:00:00' AND ts < TIMESTAMP '2024-01-12 17:30:00'"
ONE_RANGE = _bag_sql(f"entity_id = '{USER}' AND {RANGE}")


@query("point_daily", _bag_sql(f"entity_id = '{USER}' AND ts >= TIMESTAMP '2024-01-12' AND ts < TIMESTAMP '2024-01-13'"))
def _point_daily(spark, sf_dir):
    return verbs.point(event_tiers(spark, sf_dir, [USER]), USER, Period.DAILY, datetime(2024, 1, 12, 17, 20))


@query("point_yearly", _bag_sql(f"entity_id = '{USER}'"))
def _point_yearly(spark, sf_dir):
    return verbs.point(event_tiers(spark, sf_dir, [USER]), USER, Period.YEARLY, END)


@query("range_planned", ONE_RANGE)
def _range(spark, sf_dir):
    return verbs.range_(event_tiers(spark, sf_dir, [USER]), USER, START, END)


@query("range_raw", ONE_RANGE)
def _range_raw(spark, sf_dir):
    """The same from the facts, without tiers."""
    f, fine = event_facts(spark, sf_dir), Period.FIFTEEN_MINUTE
    ts = F.col("ts")
    rows = f.where((F.col("entity_id") == USER) & (ts >= per.lit_ts(per.start_of(START, fine))) & (ts < per.lit_ts(per.next_start(END, fine))))
    return combine.summarize(rows, [], F.col("arrival_seq"))


@query("range_many", _bag_sql(f"entity_id IN ('user-3', 'user-7', 'user-11', 'nobody') AND {RANGE}", "entity_id"))
def _range_many(spark, sf_dir):
    return verbs.ranges(event_tiers(spark, sf_dir, USERS), USERS, START, END)


def _customers(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.concat(F.lit("user-"), F.col("c_custkey")).alias("entity_id"))


_CUSTOMERS = "entity_id IN (SELECT 'user-' || c_custkey FROM customer)"


@query("range_table", _bag_sql(f"{_CUSTOMERS} AND {RANGE}", "entity_id"))
def _range_table(spark, sf_dir):
    """The range of every user who is a customer: the entities are a table."""
    return verbs.ranges(event_tiers(spark, sf_dir), _customers(spark, sf_dir), START, END)


@query("range_combine_table", f"SELECT u AS entity_id, 'result' AS name, 'aggregate' AS record_type, coalesce(sum(value), 0)::DECIMAL(38,0) AS value FROM (SELECT DISTINCT 'user-' || c_custkey AS u FROM customer) LEFT JOIN ({FACTS}) ON entity_id = u AND regexp_full_match(name, '.*-value') AND {RANGE} GROUP BY u")
def _range_combine_table(spark, sf_dir):
    return verbs.ranges(event_tiers(spark, sf_dir), _customers(spark, sf_dir), START, END, combine=".*-value")


@query("range_combine", f"SELECT 'result' AS name, 'aggregate' AS record_type, coalesce(sum(value), 0)::DECIMAL(38,0) AS value FROM ({ONE_RANGE}) WHERE regexp_full_match(name, '.*-value')")
def _range_combine(spark, sf_dir):
    return verbs.range_(event_tiers(spark, sf_dir, [USER]), USER, START, END, combine=".*-value")


@query("range_combine_empty", "SELECT 'result' AS name, 'aggregate' AS record_type, 0::DECIMAL(38,0) AS value")
def _range_combine_empty(spark, sf_dir):
    return verbs.range_(event_tiers(spark, sf_dir, [USER]), USER, START, END, combine="value")


@query("range_field", f"SELECT * FROM ({ONE_RANGE}) WHERE regexp_full_match(name, 'c.*|last-.*')")
def _range_field(spark, sf_dir):
    return verbs.range_(event_tiers(spark, sf_dir, [USER]), USER, START, END, field="c.*|last-.*")


@query("range_combine_field", f"SELECT 'result' AS name, 'aggregate' AS record_type, coalesce(sum(value), 0)::DECIMAL(38,0) AS value FROM ({ONE_RANGE}) WHERE regexp_full_match(name, '.*-value')")
def _range_combine_field(spark, sf_dir):
    return verbs.range_(event_tiers(spark, sf_dir, [USER]), USER, START, END, combine=".*-value", field="result")


@query("range_combine_many", f"SELECT u AS entity_id, 'result' AS name, 'aggregate' AS record_type, coalesce(sum(value), 0)::DECIMAL(38,0) AS value FROM (SELECT unnest(['user-3', 'user-7', 'user-11', 'nobody']) AS u) LEFT JOIN ({FACTS}) ON entity_id = u AND regexp_full_match(name, '.*-value') AND {RANGE} GROUP BY u")
def _range_combine_many(spark, sf_dir):
    return verbs.ranges(event_tiers(spark, sf_dir, USERS), USERS, START, END, combine=".*-value")


_ORDERS = (Period.DAILY, Period.MONTHLY, Period.YEARLY)


def order_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of all orders, as two entities: those of even customers and those of odd ones."""
    f = facts.from_orders(read(spark, sf_dir, "orders")).where("record_type = 'aggregate'")
    even = F.regexp_extract("entity_id", "[02468]$", 0) != ""
    return tiers.build(f.withColumn("entity_id", F.when(even, "even").otherwise("odd")), _ORDERS)


@query("range_orders", "SELECT o_orderpriority AS name, 'aggregate' AS record_type, count(*)::DECIMAL(38,0) AS value FROM orders WHERE o_orderdate >= TIMESTAMP '1995-11-20' AND o_orderdate < TIMESTAMP '2000-03-06' AND o_custkey % 2 = 0 GROUP BY o_orderpriority")
def _range_orders(spark, sf_dir):
    """Years of days through yearly, monthly and daily tiers, all even customers as one entity of two."""
    return verbs.range_(order_tiers(spark, sf_dir), "even", datetime(1995, 11, 20, 4), datetime(2000, 3, 5), supported=_ORDERS)


@query("range_orders_many", "SELECT CASE WHEN o_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS entity_id, o_orderpriority AS name, 'aggregate' AS record_type, count(*)::DECIMAL(38,0) AS value FROM orders WHERE o_orderdate >= TIMESTAMP '1995-11-20' AND o_orderdate < TIMESTAMP '2000-03-06' GROUP BY 1, 2")
def _range_orders_many(spark, sf_dir):
    """The range of every order: both entities' bags."""
    return verbs.ranges(order_tiers(spark, sf_dir), ["even", "odd"], datetime(1995, 11, 20, 4), datetime(2000, 3, 5), supported=_ORDERS)


def _series_sql(p: Period, first: str, last: str, users: str, data: str) -> str:
    return (
        f"WITH spine AS (SELECT u AS entity_id, b AS bucket_start FROM (SELECT unnest([{users}]) AS u), (SELECT unnest(generate_series(TIMESTAMP '{first}', TIMESTAMP '{last}', INTERVAL {WIDTH[p]})) AS b)), "
        f"rows AS (SELECT entity_id, {TRUNC[p]}::TIMESTAMP AS bucket_start, name, min(record_type) AS record_type, CASE WHEN min(record_type) = 'aggregate' THEN sum(value) ELSE arg_max(value, arrival_seq) END::DECIMAL(38,0) AS value FROM ({FACTS}) WHERE {data} GROUP BY 1, 2, 3) "
        f"SELECT entity_id, bucket_start, bucket_start + INTERVAL {WIDTH[p]} - INTERVAL 1 MILLISECOND AS bucket_end, name, record_type, value FROM spine LEFT JOIN rows USING (entity_id, bucket_start)"
    )


@query("series_hourly", _series_sql(Period.HOURLY, "2024-01-10 08:00:00", "2024-01-12 17:00:00", f"'{USER}'", "true"))
def _series_hourly(spark, sf_dir):
    return verbs.series(event_tiers(spark, sf_dir, [USER]), [USER], Period.HOURLY, START, END)


@query("series_daily_many", _series_sql(Period.DAILY, "2023-12-30", "2024-01-12", "'user-3', 'user-7', 'user-11', 'nobody'", "true"))
def _series_daily(spark, sf_dir):
    return verbs.series(event_tiers(spark, sf_dir, USERS), USERS, Period.DAILY, datetime(2023, 12, 30), END)


@query("series_table", _series_sql(Period.DAILY, "2023-12-30", "2024-01-12", "'@'", "true").replace("(SELECT unnest(['@']) AS u)", "(SELECT DISTINCT 'user-' || c_custkey AS u FROM customer)"))
def _series_table(spark, sf_dir):
    """Dense days of every user who is a customer, with or without data."""
    return verbs.series(event_tiers(spark, sf_dir), _customers(spark, sf_dir), Period.DAILY, datetime(2023, 12, 30), END)


@query("series_weekly_rollup", _series_sql(Period.WEEKLY, "2023-12-31", "2024-01-21", f"'{USER}'", "ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-25'"))
def _series_weekly(spark, sf_dir):
    return verbs.series(event_tiers(spark, sf_dir, [USER]), [USER], Period.WEEKLY, datetime(2024, 1, 2), datetime(2024, 1, 24, 5))


@query("find_fallback", f"SELECT period, bucket_start, name, value FROM ({_tier_sql(Period.DAILY)}) WHERE entity_id = '{USER}' AND bucket_start >= TIMESTAMP '2024-01-07' AND bucket_start < TIMESTAMP '2024-01-14'")
def _find(spark, sf_dir):
    return verbs.find(event_tiers(spark, sf_dir, [USER]), USER, Period.WEEKLY, datetime(2024, 1, 12)).select("period", "bucket_start", "name", "value")


@query("find_range", f"SELECT bucket_start, name, value FROM ({_tier_sql(Period.HOURLY)}) WHERE entity_id = '{USER}' AND bucket_start >= TIMESTAMP '2024-01-10 08:00:00' AND bucket_start < TIMESTAMP '2024-01-12 17:20:00'")
def _find_range(spark, sf_dir):
    return verbs.find_range(event_tiers(spark, sf_dir, [USER]), USER, Period.HOURLY, START, END).select("bucket_start", "name", "value")


@query("entities", "SELECT DISTINCT 'user-' || user_id AS entity_id FROM events")
def _entities(spark, sf_dir):
    return verbs.entities(event_tiers(spark, sf_dir))


@query("entities_filter", "SELECT DISTINCT 'user-' || user_id AS entity_id FROM events WHERE contains('user-' || user_id, 'r-1')")
def _entities_filter(spark, sf_dir):
    return verbs.entities(event_tiers(spark, sf_dir), contains="r-1")


@query("entities_limit", "SELECT DISTINCT 'user-' || user_id AS entity_id FROM events ORDER BY entity_id LIMIT 5")
def _entities_limit(spark, sf_dir):
    return verbs.entities(event_tiers(spark, sf_dir), limit=5)


@query("list_union", "SELECT DISTINCT 'user-' || user_id AS entity_id FROM events WHERE contains('user-' || user_id, '-1') OR contains('user-' || user_id, '4')")
def _list(spark, sf_dir):
    return verbs.list_entities(event_tiers(spark, sf_dir), ["-1", "4"])


@query("health", "SELECT 'ok' AS status")
def _health(spark, sf_dir):
    return verbs.health(spark)


# Bags

_TWO = f"SELECT entity_id, date_trunc('day', ts)::TIMESTAMP AS day, event_type AS name, count(*) AS n, arg_max(trunc(value)::BIGINT, event_id) AS v FROM (SELECT *, 'user-' || user_id AS entity_id FROM events) GROUP BY 1, 2, 3"


@query("overlay_types", f"SELECT entity_id, day, name, CASE WHEN hash_odd THEN 'aggregate' ELSE 'absolute' END AS record_type, CASE WHEN hash_odd THEN n ELSE v END AS value FROM (SELECT *, length(name) % 2 = 1 AS hash_odd FROM ({_TWO}))")
def _overlay(spark, sf_dir):
    """Names in both record types where their length is odd: the aggregate stands."""
    t = event_tiers(spark, sf_dir).where("period = 'daily'").withColumn("day", F.col("bucket_start"))
    agg = t.where("record_type = 'aggregate' and name not like '%-value' and length(name) % 2 = 1")
    last = t.where("record_type = 'absolute'").withColumn("name", F.expr("substring(name, 6)"))
    return combine.overlay(agg.unionByName(last).select("entity_id", "day", "name", "record_type", "value"), ["entity_id", "day"])


def _two_bags(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    t = event_tiers(spark, sf_dir)
    return verbs.point(t, "user-3", Period.YEARLY, END), verbs.point(t, USER, Period.DAILY, END)


A, B = (_bag_sql("entity_id = 'user-3'"), _bag_sql(f"entity_id = '{USER}' AND ts >= TIMESTAMP '2024-01-12' AND ts < TIMESTAMP '2024-01-13'"))


@query("merge_bags", f"SELECT coalesce(a.name, b.name) AS name, coalesce(a.record_type, b.record_type) AS record_type, CASE WHEN coalesce(a.record_type, b.record_type) = 'aggregate' THEN coalesce(a.value, 0) + coalesce(b.value, 0) ELSE coalesce(b.value, a.value) END::DECIMAL(38,0) AS value FROM ({A}) a FULL JOIN ({B}) b USING (name)")
def _merge(spark, sf_dir):
    return combine.merge(*_two_bags(spark, sf_dir))


@query("difference_bags", f"(SELECT * FROM ({A}) EXCEPT SELECT * FROM ({B})) UNION ALL (SELECT * FROM ({B}) EXCEPT SELECT * FROM ({A}))")
def _difference(spark, sf_dir):
    return combine.difference(*_two_bags(spark, sf_dir))


@query("intersect_bags", f"SELECT * FROM ({A}) INTERSECT SELECT * FROM ({B})")
def _intersect(spark, sf_dir):
    return combine.intersection(*_two_bags(spark, sf_dir))


@query("intersect_part", f"SELECT * FROM ({A}) WHERE contains(name, '-value')")
def _intersect_part(spark, sf_dir):
    """A bag and a part of it."""
    bag = verbs.point(event_tiers(spark, sf_dir), "user-3", Period.YEARLY, END)
    return combine.intersection(bag, combine.keep_matching(bag, ".*-value"))


@query("sum_widening", "SELECT event_type AS name, 'aggregate' AS record_type, sum(CASE WHEN event_id % 10 = 0 THEN 0 ELSE 9000000000000000000 + event_id END)::DECIMAL(38,0) AS value FROM events GROUP BY event_type")
def _widening(spark, sf_dir):
    """Sums beyond 64 bits, with nulls as 0."""
    v = F.when(F.col("event_id") % 10 != 0, F.lit(9000000000000000000) + F.col("event_id"))
    rows = events(spark, sf_dir).select(F.col("event_type").alias("name"), F.lit("aggregate").alias("record_type"), v.alias("value"), "event_id")
    return combine.summarize(rows, [], F.col("event_id"))


# Admin


@query("fsck_clean", "SELECT '' AS period, '' AS entity_id, TIMESTAMP '2024-01-01' AS bucket_start, '' AS name, 0::DECIMAL(38,0) AS stored, 0::DECIMAL(38,0) AS expected WHERE false")
def _fsck(spark, sf_dir):
    return verbs.fsck(event_tiers(spark, sf_dir))


@query("fsck_corrupt", f"SELECT 'daily' AS period, entity_id, bucket_start, name, (value + 1)::DECIMAL(38,0) AS stored, value::DECIMAL(38,0) AS expected FROM ({_tier_sql(Period.DAILY)}) WHERE record_type = 'aggregate' AND name = 'click' AND entity_id = '{USER}' UNION ALL SELECT 'monthly', entity_id, bucket_start, name, value::DECIMAL(38,0), (value + d)::DECIMAL(38,0) FROM ({_tier_sql(Period.MONTHLY)}) JOIN (SELECT count(*) AS d FROM ({_tier_sql(Period.DAILY)}) WHERE record_type = 'aggregate' AND name = 'click' AND entity_id = '{USER}') ON d > 0 WHERE record_type = 'aggregate' AND name = 'click' AND entity_id = '{USER}'")
def _fsck_corrupt(spark, sf_dir):
    hit = F.expr(f"period = 'daily' and record_type = 'aggregate' and name = 'click' and entity_id = '{USER}'")
    t = event_tiers(spark, sf_dir)
    return verbs.fsck(t.withColumn("value", F.when(hit, F.col("value") + 1).otherwise(F.col("value"))))


@query("dump_rows", f"SELECT entity_id, epoch_ms(bucket_start) AS timestamp, name, record_type, value FROM ({_tier_sql(Period.FIFTEEN_MINUTE)})")
def _dump(spark, sf_dir):
    return verbs.dump(event_tiers(spark, sf_dir))


@query("dump_verified", f"SELECT entity_id, epoch_ms(bucket_start) AS timestamp, name, record_type, value FROM ({_tier_sql(Period.FIFTEEN_MINUTE)})")
def _dump_verified(spark, sf_dir):
    """A dump that was checked as it was written, read back."""
    path = scratch(spark, "dump")
    verbs.write_verified(event_tiers(spark, sf_dir), path, messages.write_dump)
    return messages.read_dump(spark, path)


@query("dump_filtered", f"SELECT entity_id, epoch_ms(bucket_start) AS timestamp, name, record_type, value FROM ({_tier_sql(Period.FIFTEEN_MINUTE)}) WHERE contains(entity_id, 'r-1') OR contains(entity_id, '-4')")
def _dump_filtered(spark, sf_dir):
    return verbs.dump(event_tiers(spark, sf_dir), ["r-1", "-4"])


@query("slice_counts", f"SELECT entity_id, bucket_start, count(DISTINCT name) AS names FROM ({_tier_sql(Period.FIFTEEN_MINUTE)}) GROUP BY ALL")
def _slice_counts(spark, sf_dir):
    return verbs.slice_counts(event_tiers(spark, sf_dir), Period.FIFTEEN_MINUTE)


@query("fill_roundtrip", f"SELECT period, record_type, entity_id, bucket_start, name, value FROM ({ALL_TIERS})")
def _fill(spark, sf_dir):
    """Dump to CSV files, read them, and rebuild every tier."""
    path = scratch(spark, "dump")
    messages.write_dump(verbs.dump(event_tiers(spark, sf_dir)), path)
    return tiers.build(verbs.fill(messages.read_dump(spark, path))).drop("last_seq")


@query("fill_count", f"SELECT count(*) AS records FROM ({_tier_sql(Period.FIFTEEN_MINUTE)})")
def _fill_count(spark, sf_dir):
    return verbs.fill(verbs.dump(event_tiers(spark, sf_dir))).agg(F.count("*").alias("records"))


# Guards


def _odd_names(spark, sf_dir) -> DataFrame:
    k = F.col("arrival_seq") % 10
    f = event_facts(spark, sf_dir)
    return f.withColumn("name", F.when(k == 0, "").when(k == 1, F.concat(F.lit("__"), "name", F.lit("__"))).otherwise(F.col("name")))


@query("reserved_names", f"SELECT arrival_seq, '__' || name || '__' AS name FROM ({FACTS}) WHERE arrival_seq % 10 = 1")
def _reserved(spark, sf_dir):
    return facts.reserved(_odd_names(spark, sf_dir)).select("arrival_seq", "name")


@query("drop_empty", f"SELECT arrival_seq, name, value FROM ({FACTS}) WHERE arrival_seq % 10 > 1")
def _drop(spark, sf_dir):
    return facts.accepted(_odd_names(spark, sf_dir), "drop").select("arrival_seq", "name", "value")


@query("record_type_split", f"SELECT record_type, count(*) AS n FROM ({FACTS}) GROUP BY record_type")
def _split(spark, sf_dir):
    return event_facts(spark, sf_dir).groupBy("record_type").agg(F.count("*").alias("n"))


# Domain events: the columns they carry, made from the events table.

_IN = """(SELECT event_id, ts, 'v' || user_id AS view, (user_id % 7)::VARCHAR AS domain, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 't' || event_id % 5 END AS token,
    ['share', 'comment', 'rating', 'view', 'favorite'][event_id % 5 + 1] AS action, ['download', 'website', 'api'][event_id % 3 + 1] AS channel,
    [NULL, '', 'map', 'chart', 'table'][event_id % 5 + 1] AS display, trunc(value)::BIGINT AS n FROM events)"""


def _inputs(spark, sf_dir) -> DataFrame:
    k = F.col("event_id")

    def pick(values, by):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (k % by + 1).cast("int"))

    return events(spark, sf_dir).select(
        "event_id", "ts", F.concat(F.lit("v"), "user_id").alias("view"), (F.col("user_id") % 7).cast("string").alias("domain"),
        F.when(k % 3 != 0, F.concat(F.lit("t"), k % 5)).alias("token"), pick(["share", "comment", "rating", "view", "favorite"], 5).alias("action"),
        pick(["download", "website", "api"], 3).alias("channel"), pick([None, "", "map", "chart", "table"], 5).alias("display"),
        F.col("value").cast("bigint").alias("n"),
    )


def _fan(spark, sf_dir, metrics) -> DataFrame:
    return facts.fan_out(_inputs(spark, sf_dir), metrics, seq="event_id").drop("ts")


def _emit(*rows: tuple[str, str, str, str, str]) -> str:
    return " UNION ALL ".join(f"SELECT {e} AS entity_id, {n} AS name, '{t}' AS record_type, ({v})::BIGINT AS value, event_id AS arrival_seq FROM {_IN} WHERE {w}" for e, n, v, t, w in rows)


_G = "aggregate"
_TOKEN = [("view || '-apps'", "token", "1", _G, "token IS NOT NULL"), ("'app-' || token", "view", "1", _G, "token IS NOT NULL")]
_APP = "'application-' || coalesce(token, '%unknown%')"
_BOTH = ("view", "domain")
_VIEWS = ("maps-created", "maps-deleted", "charts-created", "charts-deleted", "filters-created", "filters-deleted")


def _metrics(name: str) -> list:
    """The metrics of one query, over the columns of _inputs."""
    e = domain_events
    v, d, t, n = (F.col(c) for c in ("view", "domain", "token", "n"))
    action, channel = F.col("action"), F.col("channel")
    return {
        "child_loaded": lambda: e.child_loaded(v, t, F.col("display")),
        "searches": lambda: e.search(v, action) + e.search(d, action, "users-search-") + e.search(d, action, "datasets-search-"),
        "created": lambda: e.created(d, "users-created") + e.created(d, "app-token-created"),
        "token_request": lambda: e.token_request(t, d, F.lit("10.0.0.1")),
        "token_for_view": lambda: e.token_request_for_view(v, t),
        "api_query": lambda: e.api_query(v, t),
        "views_changed": lambda: [m for w in _VIEWS for m in e.view_changed(d, v, w)],
        "datasets_changed": lambda: e.dataset_changed(d, action == "share", channel == "api", "datasets-created")
        + e.dataset_changed(d, action == "view", F.lit(False), "datasets-deleted"),
        "rows_changed": lambda: e.rows_created(n, d, v) + e.rows_deleted(n, d, v, t),
        "action": lambda: e.action(action, v, d, n, t),
        "bytes": lambda: e.transferred("in", t, d, n) + e.transferred("out", v, d, n),
        "row_access": lambda: e.row_access(channel, d, v, n, t),
        "geocoding": lambda: e.geocoding(d, v, n),
        "disk_usage": lambda: e.dataset_disk(v, action, n) + e.domain_disk(d, n) + e.user_domain_disk(v, d, n),
    }[name]()


_FANS = {
    "child_loaded": [
        ("'children-loaded-' || view", "CASE WHEN display IN ('map', 'chart') THEN display ELSE 'filter' END || '-' || token", "1", _G,
         "display IS NULL OR display <> 'table'"),
    ],
    "searches": [
        ("'searches-' || view", "'search-' || action", "1", _G, "true"), ("'searches-' || domain", "'users-search-' || action", "1", _G, "true"),
        ("'searches-' || domain", "'datasets-search-' || action", "1", _G, "true"),
    ],
    "created": [("domain", "'users-created'", "1", _G, "true"), ("domain", "'app-token-created'", "1", _G, "true")],
    "token_request": [
        ("'ip-applications'", f"{_APP} || '-10.0.0.1'", "1", _G, "true"), ("domain || '-applications'", _APP, "1", _G, "true"),
        ("'applications'", _APP, "1", _G, "true"), (_APP, "'requests'", "1", _G, "true"),
    ],
    "token_for_view": [("'view-' || view || '-apps'", "coalesce(token, 'anon')", "1", _G, "true")],
    "api_query": [("'view-' || view || '-query'", "coalesce(token, 'select *')", "1", _G, "true"), ("view", "'queries-served'", "1", _G, "true")],
    "views_changed": [(o, f"'{w}'", "1", _G, "true") for w in _VIEWS for o in _BOTH],
    "datasets_changed": [
        ("domain", "'datasets-created-blobby'", "1", _G, "action = 'share'"), ("domain", "'datasets-created-href'", "1", _G, "channel = 'api'"),
        ("domain", "'datasets-created'", "1", _G, "true"), ("domain", "'datasets-deleted-blobby'", "1", _G, "action = 'view'"),
        ("domain", "'datasets-deleted'", "1", _G, "true"),
    ],
    "rows_changed": [(o, f"'{w}'", "n", _G, "true") for w in ("rows-created", "rows-deleted") for o in _BOTH] + _TOKEN,
    "action": [
        *[(o, "'ratings-total'", "n", _G, "action = 'rating'") for o in _BOTH], *[(o, "'ratings-count'", "1", _G, "action = 'rating'") for o in _BOTH],
        *[(o, "'view-loaded'", "1", _G, "action = 'view'") for o in _BOTH], *[(o, "action || 's'", "n", _G, "action NOT IN ('rating', 'view')") for o in _BOTH],
        ("'views-loaded-' || domain", "'view-' || view", "1", _G, "action = 'view'"), *_TOKEN,
    ],
    "bytes": [
        ("token", "'bytes-in'", "n", _G, "token IS NOT NULL"), ("domain", "'bytes-in'", "n", _G, "true"), ("view", "'bytes-out'", "n", _G, "true"),
        ("domain", "'bytes-out'", "n", _G, "true"),
    ],
    "row_access": [
        *[(o, "'rows-accessed-' || channel", "1", _G, "true") for o in _BOTH], *[(o, "'rows-loaded-' || channel", "n", _G, "true") for o in _BOTH],
        ("'views-downloaded-' || domain", "'view-' || view", "1", _G, "channel = 'download'"), *_TOKEN,
    ],
    "geocoding": [(o, "'geocoding-requests'", "n", _G, "true") for o in _BOTH],
    "disk_usage": [
        ("view", "'disk-usage'", "n", "absolute", "true"), ("'user-' || action || '-views-disk-usage'", "'view-' || view", "n", "absolute", "true"),
        ("domain", "'disk-usage'", "n", "absolute", "true"), ("domain || '-users-disk-usage'", "'user-' || view", "n", "absolute", "true"),
    ],
}

for _name, _rows in _FANS.items():

    @query(f"fanout_{_name}", _emit(*_rows))
    def _fan_query(spark, sf_dir, name=_name):
        return _fan(spark, sf_dir, _metrics(name))


_URL = "(SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) || '-' || regexp_extract(url, '^[a-z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) || CASE WHEN trim(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1)) <> '' THEN '?' || regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) ELSE '' END AS path FROM pages)"


@query("referrer_parts", f"SELECT page_id, substr(url, 1, 500) AS referrer, host, path FROM {_URL}")
def _referrer(spark, sf_dir):
    u = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", ids.referrer(u).alias("referrer"), ids.referrer_host(u).alias("host"), ids.referrer_path(u).alias("path"))


def _visit_sql(kind: str, owner: str) -> str:
    return (
        f"SELECT '{kind}-hosts-' || {owner} AS entity_id, 'referrer-' || host AS name, 1::BIGINT AS value, page_id AS arrival_seq FROM {_URL} "
        f"UNION ALL SELECT '{kind}-paths-' || {owner} || '-' || host, 'path-' || path, 1, page_id FROM {_URL}"
    )


@query(
    "fanout_referrers",
    f"{_visit_sql('referrer', 'page_id')} UNION ALL SELECT 'publishes-uids-' || page_id % 7, 'uid-' || page_id, 1, page_id FROM pages "
    f"UNION ALL {_visit_sql('publishes', 'page_id')} UNION ALL {_visit_sql('publishes', '(page_id % 7)')}",
)
def _referrers(spark, sf_dir):
    p, v, d = read(spark, sf_dir, "pages"), F.col("page_id").cast("string"), (F.col("page_id") % 7).cast("string")
    made = domain_events.dataset_referrer(F.col("url"), v) + domain_events.publish(F.col("url"), v, d)
    return facts.fan_out(p.withColumn("ts", F.lit(None).cast("timestamp_ntz")), made, seq="page_id").select("entity_id", "name", "value", "arrival_seq")


@query("id_parts", "SELECT event_id, 'view-' || user_id || '-apps' AS joined, false AS plain, true AS unresolved, 'x-' || user_id AS replaced, user_id % 2 = 0 AS has_two FROM events")
def _id_parts(spark, sf_dir):
    user = F.col("user_id").cast("string")
    parts = F.array(F.lit("%who%"), F.lit("-"), user, (F.col("user_id") % 2).cast("string"))
    return events(spark, sf_dir).select(
        "event_id", ids.join_parts("view-", user, "-apps").alias("joined"), ids.is_unresolved(user).alias("plain"), ids.is_unresolved(parts[0]).alias("unresolved"),
        F.array_join(F.slice(ids.replace_part(parts, "%who%", "x"), 1, 3), "").alias("replaced"),
        ids.has_part(F.slice(parts, 4, 1), "0").alias("has_two"),
    )


# Messages and files


@query("chunk_150", f"SELECT entity_id, ts, name, ceil(row_number() OVER (PARTITION BY entity_id, ts ORDER BY name, record_type, arrival_seq) / 150)::INT AS chunk FROM (SELECT entity_id, date_trunc('month', ts)::TIMESTAMP AS ts, name, record_type, arrival_seq FROM ({FACTS}))")
def _chunk(spark, sf_dir):
    f = event_facts(spark, sf_dir).withColumn("ts", per.bucket_start(F.col("ts"), Period.MONTHLY))
    return messages.chunks(f).select("entity_id", "ts", "name", "chunk")


_DAILY_FACTS = f"SELECT entity_id, bucket_start AS ts, name, record_type, value FROM ({_tier_sql(Period.DAILY)})"


def _daily(spark, sf_dir) -> DataFrame:
    return event_tiers(spark, sf_dir).where("period = 'daily'").select("entity_id", F.col("bucket_start").alias("ts"), "name", "record_type", "value", F.col("last_seq").alias("arrival_seq"))


@query("json_roundtrip", _DAILY_FACTS)
def _json(spark, sf_dir):
    return messages.from_json(messages.to_json(_daily(spark, sf_dir)))


@query("protobuf_roundtrip", _DAILY_FACTS)
def _proto(spark, sf_dir):
    return messages.from_protobuf(messages.to_protobuf(_daily(spark, sf_dir)))


@query("protobuf_batches", _DAILY_FACTS)
def _proto_batches(spark, sf_dir):
    return messages.from_protobuf(messages.to_protobuf(_daily(spark, sf_dir), batch=50), batch=True)


@query("bag_protobuf", ONE_RANGE)
def _bag_protobuf(spark, sf_dir):
    return messages.bag_from_protobuf(messages.bag_protobuf(verbs.range_(event_tiers(spark, sf_dir, [USER]), USER, START, END)))


@query("json_rejects", "SELECT CASE page_id % 3 WHEN 0 THEN '{bad' WHEN 1 THEN '{\"entityId\":\"e\",\"metrics\":{}}' ELSE '{\"entityId\":\"e\",\"timestamp\":1,\"metrics\":{\"m\":{\"value\":1,\"type\":\"sum\"}}}' END AS value, 'Error parsing a metrics message' AS error FROM pages")
def _json_rejects(spark, sf_dir):
    """Messages that do not parse, lack a time or have an unknown type, among whole ones."""
    k = F.col("page_id") % 3
    bad = F.when(k == 0, "{bad").when(k == 1, '{"entityId":"e","metrics":{}}')
    bad = bad.otherwise('{"entityId":"e","timestamp":1,"metrics":{"m":{"value":1,"type":"sum"}}}')
    return messages.rejected(read(spark, sf_dir, "pages").select(bad.alias("value")).unionByName(messages.to_json(_daily(spark, sf_dir))))


@query("file_run", f"SELECT period, record_type, entity_id, bucket_start, name, value FROM ({ALL_TIERS})")
def _file_run(spark, sf_dir):
    """Facts written as record files, half of them after a first run over the folder, with a bad file among each; both runs fill one store."""
    folder, store, work = scratch(spark, "records"), tiers.Store(spark, scratch(spark, "tiers")), scratch(spark, "run")
    facts_ = event_facts(spark, sf_dir)
    half = facts_.agg(F.max("arrival_seq")).first()[0] // 2
    for number, part in enumerate((facts_.where(F.col("arrival_seq") <= half), facts_.where(F.col("arrival_seq") > half))):
        records.write(part.repartitionByRange("arrival_seq"), folder)
        records.write(part.limit(3).withColumn("record_type", F.lit("other")).coalesce(1), f"{folder}/bad")
        records.run(spark, folder, store, work, number)
    return store.read().select("period", "record_type", "entity_id", "bucket_start", "name", "value")


@query("record_files", f"SELECT entity_id, date_trunc('millisecond', ts) AS ts, name, record_type, value FROM ({FACTS})")
def _record_files(spark, sf_dir):
    """Facts written as record files and decoded again."""
    made = records.in_files(event_facts(spark, sf_dir)).select(F.col("file").alias("path"), "content")
    return records.decode(made).select("entity_id", "ts", "name", "record_type", "value")


@query("bag_json", f"""SELECT '{{' || string_agg('"' || name || '":{{"value":' || value || ',"type":"' || record_type || '"}}', ',' ORDER BY name) || '}}' AS body FROM ({ONE_RANGE})""")
def _bag_json(spark, sf_dir):
    return messages.bag_json(verbs.range_(event_tiers(spark, sf_dir, [USER]), USER, START, END))


@query("ready_files", """
    WITH p AS (SELECT 'd/' || page_id % 9 || '/m' || lpad(page_id::VARCHAR, 6, '0') || ['.data', '.data.COMPLETED', '.data.lock', '.broken', '.data'][page_id % 5 + 1] AS path, 'd/' || page_id % 9 AS folder FROM pages),
    f AS (SELECT * FROM p WHERE NOT lower(path) LIKE '%.lock' AND NOT lower(path) LIKE '%.broken'),
    o AS (SELECT folder, max(path) AS newest FROM f WHERE NOT lower(path) LIKE '%.completed' GROUP BY folder),
    r AS (SELECT path, folder FROM f LEFT JOIN o USING (folder) WHERE lower(path) LIKE '%.completed' OR path <> newest)
    SELECT path, folder, row_number() OVER (PARTITION BY folder ORDER BY path)::INT AS turn FROM r
""")
def _ready(spark, sf_dir):
    k = F.col("page_id")
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".data", ".data.COMPLETED", ".data.lock", ".broken", ".data")]), (k % 5 + 1).cast("int"))
    path = F.concat(F.lit("d/"), k % 9, F.lit("/m"), F.lpad(k.cast("string"), 6, "0"), suffix)
    return files.ready(read(spark, sf_dir, "pages").select(path.alias("path")))


# Buffers and streams

_SLICES = f"SELECT entity_id, epoch_ms(epoch_ms(date_trunc('millisecond', ts)) - epoch_ms(date_trunc('millisecond', ts)) % 120000) AS ts, name, record_type, CASE WHEN record_type = 'aggregate' THEN sum(value)::BIGINT ELSE arg_max(value, arrival_seq) END AS value, max(arrival_seq) AS arrival_seq FROM ({FACTS}) GROUP BY 1, 2, 3, 4"


@query("slice_buffer_120s", _SLICES)
def _buffered(spark, sf_dir):
    return ingest.buffered(event_facts(spark, sf_dir)).select("entity_id", "ts", "name", "record_type", "value", "arrival_seq")


#: Rows of a file of a stream's source, about. Spark packs files into a task by their bytes and a charge for each, so a task gets 1.3 million rows at most.
FILE_ROWS = 50_000


def incoming(spark: SparkSession, parts: Sequence[DataFrame], file_rows: int = FILE_ROWS) -> DataFrame:
    """Parts of a table, written as files and read as a stream, one part a micro-batch. All parts have as many files, which grow in number and
    not in size, so that a batch is read by many tasks; a part that has fewer rows than files gets empty ones."""
    source = scratch(spark, "incoming")
    n = max(1, -(-max(part.count() for part in parts) // file_rows))
    for number, part in enumerate(parts):
        folder = f"{source}/{number}"
        part.repartition(n).write.parquet(folder)
        for _ in range(n - len(spark.read.parquet(folder).inputFiles())):
            part.limit(0).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", n).parquet(f"{source}/*")


def _stream(spark, sf_dir, buffer: bool, sinks=()) -> DataFrame:
    """Events as files, out of order, through a stream into a store."""
    store, e = tiers.Store(spark, scratch(spark, "tiers")), events(spark, sf_dir)
    stream = incoming(spark, [e.where(F.pmod("event_id", F.lit(3)) == h) for h in (0, 1, 2)])
    ingest.ingest(stream, store, scratch(spark, "progress"), facts.from_events, buffer=buffer, sinks=sinks, compact_every=2).awaitTermination()
    return store.read()


@query("stream_ingest", f"SELECT period, record_type, entity_id, bucket_start, name, value, last_seq FROM ({ALL_TIERS})")
def _stream_ingest(spark, sf_dir):
    return _stream(spark, sf_dir, False)


@query("stream_buffered", " UNION ALL ".join(
    f"SELECT '{p}' AS period, record_type, entity_id, {TRUNC[p]}::TIMESTAMP AS bucket_start, name, CASE WHEN record_type = 'aggregate' THEN sum(value)::BIGINT ELSE arg_max(value, arrival_seq) END AS value FROM ({_SLICES}) GROUP BY record_type, entity_id, bucket_start, name"
    for p in DEFAULT_TIERS
))
def _stream_buffered(spark, sf_dir):
    return _stream(spark, sf_dir, True).drop("last_seq")


_CUTS = ("2024-01-08 11:01:00", "2024-01-17 05:33:00")


@query("stream_held", " UNION ALL ".join(
    f"SELECT '{p}' AS period, record_type, entity_id, {TRUNC[p]}::TIMESTAMP AS bucket_start, name, CASE WHEN record_type = 'aggregate' THEN sum(value)::BIGINT ELSE arg_max(value, arrival_seq) END AS value, max(arrival_seq) AS last_seq FROM ({_SLICES}) GROUP BY record_type, entity_id, bucket_start, name"
    for p in DEFAULT_TIERS
))
def _stream_held(spark, sf_dir):
    """Events in order of time, cut amid slices into three micro-batches, through slices held as state."""
    store, e = tiers.Store(spark, scratch(spark, "tiers")), events(spark, sf_dir)
    a, b = (F.lit(t).cast("timestamp_ntz") for t in _CUTS)
    stream = incoming(spark, [e.where(F.col("ts") < a), e.where((F.col("ts") >= a) & (F.col("ts") < b)), e.where(F.col("ts") >= b)])
    progress = scratch(spark, "progress")
    held.drain(ingest.ingest(stream, store, progress, facts.from_events, available_now=False, every="100 milliseconds", hold_ms=2_000, groups=32))
    return store.read()


@query(
    "stream_files",
    f"SELECT period, record_type, entity_id, bucket_start, name, value FROM ({ALL_TIERS}) UNION ALL "
    f"SELECT 'rejected', NULL, 'bad-' || half, NULL, '{records.BAD_FILE}', 1 FROM (SELECT DISTINCT (event_id > (SELECT max(event_id) // 2 FROM events))::INT AS half FROM events)",
)
def _stream_files(spark, sf_dir):
    """Record files, a bad one among each half, through a stream that is started for each half anew: the store's rows and the rejected files."""
    folder, work, store = scratch(spark, "records"), scratch(spark, "poll"), tiers.Store(spark, scratch(spark, "tiers"))
    f = event_facts(spark, sf_dir)
    middle = f.agg(F.max("arrival_seq")).first()[0] // 2
    for half, part in enumerate((f.where(F.col("arrival_seq") <= middle), f.where(F.col("arrival_seq") > middle))):
        records.write(part.repartitionByRange("arrival_seq"), f"{folder}/good-{half}")
        records.write(part.limit(3).withColumn("record_type", F.lit("other")).coalesce(1), f"{folder}/bad-{half}")
        records.poll(records.stream(spark, folder), store, f"{work}/rejects", f"{work}/staged", f"{work}/progress", every=None, by_name=True).awaitTermination()
    bad = spark.read.parquet(f"{work}/rejects").groupBy(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("entity_id"), F.col("error").alias("name"))
    none = {"record_type": F.lit(None).cast("string"), "bucket_start": F.lit(None).cast("timestamp_ntz"), "period": F.lit("rejected")}
    rejected = bad.agg(F.count("*").alias("value")).withColumns(none)
    columns = ["period", "record_type", "entity_id", "bucket_start", "name", "value"]
    return store.read().select(*columns).unionByName(rejected.select(*columns))


@query("stream_metrics", "SELECT 'rows-in' AS name, count(*) AS value FROM events UNION ALL SELECT n, count(DISTINCT event_type) FROM events, (SELECT unnest(['batches', 'heartbeats']) AS n) GROUP BY n UNION ALL SELECT n, least(count(*), 1) FROM events, (SELECT unnest(['starts', 'stops']) AS n) GROUP BY n")
def _stream_metrics(spark, sf_dir):
    """What a stream over the events, a batch for each type, tells of itself: its sums in a store of such facts."""
    store, own, e = tiers.Store(spark, scratch(spark, "tiers")), tiers.Store(spark, scratch(spark, "own")), events(spark, sf_dir)
    types = [r.event_type for r in e.select("event_type").distinct().collect()]
    stream = incoming(spark, [e.where(F.col("event_type").eqNullSafe(F.lit(t))) for t in types])
    told = progress.ProgressFacts()
    spark.streams.addListener(told)
    try:
        query_ = ingest.ingest(stream, store, scratch(spark, "progress"), facts.from_events)
        query_.awaitTermination()
        told.wait(query_)
    finally:
        spark.streams.removeListener(told)
    told.flush(own, 0)
    sums = own.read().where("period = 'yearly' and record_type = 'aggregate'")
    return sums.groupBy("name").agg(F.sum("value").alias("value"))


@query("stream_sinks", f"SELECT entity_id, ts, name, record_type, value, arrival_seq FROM ({FACTS})")
def _stream_sinks(spark, sf_dir):
    """The facts that a second sink of the stream gets."""
    path = scratch(spark, "second")
    _stream(spark, sf_dir, False, [lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")])
    return spark.read.parquet(path).drop("batch")
