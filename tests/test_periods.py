from datetime import datetime, timedelta
from random import Random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import periods as p
from tidemark.functions.periods import DEFAULT_TIERS, Period
from tidemark.plans.cover import cover


@pytest.mark.parametrize(
    ("at", "period", "start", "end"),
    [
        ("2010-02-12 16:59:12", Period.FIFTEEN_MINUTE, "2010-02-12 16:45:00", "2010-02-12 16:59:59.999"),
        ("2010-02-12", Period.MONTHLY, "2010-02-01", "2010-02-28 23:59:59.999"),
        ("2010-02-12", Period.WEEKLY, "2010-02-07", "2010-02-13 23:59:59.999"),
        ("2010-06-02", Period.WEEKLY, "2010-05-30", "2010-06-05 23:59:59.999"),
    ],
)
def test_bucket_bounds(at, period, start, end):
    at = datetime.fromisoformat(at)
    assert p.start_of(at, period) == datetime.fromisoformat(start)
    assert p.end_of(at, period) == datetime.fromisoformat(end)


def test_columns_agree_with_instants(spark):
    r = Random(4)
    times = [datetime(1960, 1, 1) + timedelta(milliseconds=r.randrange(3_000_000_000_000)) for _ in range(200)]
    df = spark.createDataFrame([(i, t.isoformat(sep=" ")) for i, t in enumerate(times)], "i int, s string").withColumn("ts", F.col("s").cast("timestamp_ntz"))
    for q in Period:
        if q in (Period.FOREVER, Period.REALTIME):
            continue
        for row in df.select("i", p.bucket_start(F.col("ts"), q).alias("a"), p.bucket_end(F.col("ts"), q).alias("b")).collect():
            assert (row.a, row.b) == (p.start_of(times[row.i], q), p.end_of(times[row.i], q)), q


def test_realtime_has_no_buckets():
    with pytest.raises(ValueError):
        p.start_of(datetime(2020, 1, 1), Period.REALTIME)


def test_navigation():
    assert p.coarser(Period.DAILY) is Period.MONTHLY and p.finer(Period.MONTHLY) is Period.DAILY
    assert p.coarser(Period.WEEKLY) is Period.MONTHLY and p.finer(Period.WEEKLY) is Period.DAILY
    assert p.supported_granularity(Period.WEEKLY, DEFAULT_TIERS) is Period.DAILY
    with pytest.raises(ValueError):
        p.supported_granularity(Period.MINUTELY, DEFAULT_TIERS)
    with pytest.raises(ValueError, match="No period named crud"):
        Period.parse("crud")


HOURS = timedelta(hours=1)
TIERS = (Period.HOURLY, Period.DAILY, Period.MONTHLY)


def test_cover_of_two_months():
    start, end = p.EPOCH + 24 * 28 * HOURS + 22 * HOURS, p.EPOCH + 24 * 60 * HOURS + 25 * HOURS
    fetches = sorted((d, q) for q, a, b in cover(start, end, TIERS) for d in p.to_dates(a, b + p.MILLI, q))
    assert [q for _, q in fetches] == [Period.HOURLY] * 2 + [Period.DAILY] * 2 + [Period.MONTHLY] + [Period.DAILY] * 2 + [Period.HOURLY] * 2
    assert len(p.to_dates(start, end, Period.HOURLY)) == 771


@pytest.mark.parametrize(
    ("start", "end", "buckets"),
    [
        ("2024-01-10 08:07", "2024-01-12 17:20", 36), ("2010-01-01 08:00", "2017-01-01 08:00", 72), ("2024-01-01", "2024-02-01", 2),
        ("2024-01-05 03:05", "2024-01-05 03:05", 1), ("2010-01-01", "2017-01-01", 8),
    ],
)
def test_cover_sizes(start, end, buckets):
    plan = cover(datetime.fromisoformat(start), datetime.fromisoformat(end))
    assert sum(len(p.to_dates(a, b + p.MILLI, q)) for q, a, b in plan) == buckets


def test_cover_tiles_its_range():
    r = Random(9)
    for _ in range(500):
        a = datetime(2001, 1, 1) + timedelta(minutes=r.randrange(6_000_000))
        b = a + timedelta(minutes=int(10 ** r.uniform(0, 6.5)))
        plan = sorted((s, e) for _, s, e in cover(a, b))
        assert plan[0][0] == p.start_of(a, Period.FIFTEEN_MINUTE) and plan[-1][1] == p.end_of(b, Period.FIFTEEN_MINUTE)
        assert all(x[1] + p.MILLI == y[0] for x, y in zip(plan, plan[1:], strict=False))
