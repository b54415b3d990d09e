"""Periods, their buckets, and time arithmetic, as Column expressions and as small driver-side helpers.

Times are TIMESTAMP_NTZ columns and naive datetimes, both meaning UTC with millisecond precision.
A bucket runs from its start to its inclusive end, one millisecond before the next one's start.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from enum import IntEnum

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = datetime(1970, 1, 1)
MILLI = timedelta(milliseconds=1)
SLICE_MS = 120_000


class Period(IntEnum):
    """From coarse to fine; the value is the granularity."""

    FOREVER = 0
    YEARLY = 1
    MONTHLY = 2
    WEEKLY = 3
    DAILY = 4
    HOURLY = 5
    FIFTEEN_MINUTE = 6
    MINUTELY = 7
    SECONDLY = 8
    REALTIME = 9

    def __str__(self) -> str:
        return self.name.lower()

    @classmethod
    def parse(cls, text: str) -> Period:
        try:
            return cls[text.upper()]
        except KeyError:
            raise ValueError(f"Unable to parse period : No period named {text}") from None


DEFAULT_TIERS = (Period.FIFTEEN_MINUTE, Period.HOURLY, Period.DAILY, Period.MONTHLY, Period.YEARLY)

_UNITS = {
    Period.YEARLY: ("YEAR", "INTERVAL '1' YEAR"),
    Period.MONTHLY: ("MONTH", "INTERVAL '1' MONTH"),
    Period.WEEKLY: (None, "INTERVAL '7' DAY"),
    Period.DAILY: ("DAY", "INTERVAL '1' DAY"),
    Period.HOURLY: ("HOUR", "INTERVAL '1' HOUR"),
    Period.FIFTEEN_MINUTE: (None, "INTERVAL '15' MINUTE"),
    Period.MINUTELY: ("MINUTE", "INTERVAL '1' MINUTE"),
    Period.SECONDLY: ("SECOND", "INTERVAL '1' SECOND"),
}


def least_granular(tiers: Sequence[Period]) -> Period:
    return min(tiers)


def most_granular(tiers: Sequence[Period]) -> Period:
    return max(tiers)


def coarser(p: Period, tiers: Sequence[Period] | None = None) -> Period | None:
    """The next coarser period; weeks are passed over unless p is a week. With tiers, the next of them."""
    if tiers is not None:
        return max((t for t in tiers if t < p and t is not Period.WEEKLY), default=None)
    up = {Period.DAILY: Period.MONTHLY}.get(p, p - 1)
    return Period(up) if up >= 0 else None


def finer(p: Period) -> Period | None:
    down = {Period.MONTHLY: Period.DAILY}.get(p, p + 1)
    return Period(down) if down <= Period.REALTIME else None


def supported_granularity(p: Period, tiers: Sequence[Period]) -> Period:
    """p if it is a tier, else the next finer tier. A period finer than every tier cannot be answered."""
    q: Period | None = p
    while q is not None and q not in tiers:
        q = finer(q)
    if q is None:
        raise ValueError(f"period {p} is finer than the finest tier")
    return q


def lit_ts(t: datetime) -> Column:
    return F.lit(t.isoformat(sep=" ", timespec="milliseconds")).cast("timestamp_ntz")


def millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a TIMESTAMP_NTZ."""
    return F.timestamp_diff("MILLISECOND", lit_ts(EPOCH), ts)


def from_millis(ms: Column) -> Column:
    return F.timestamp_add("MILLISECOND", ms, lit_ts(EPOCH))


def bucket_start(ts: Column, p: Period) -> Column:
    ts = ts.cast("timestamp_ntz")
    if p is Period.FOREVER:
        return F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    if p is Period.WEEKLY:  # weeks start on Sunday
        return F.date_sub(ts.cast("date"), F.dayofweek(ts) - 1).cast("timestamp_ntz")
    if p is Period.FIFTEEN_MINUTE:
        hour = F.date_trunc("HOUR", ts).cast("timestamp_ntz")
        return hour + F.make_dt_interval(mins=F.floor(F.minute(ts) / 15).cast("int") * 15)
    if p not in _UNITS:
        raise ValueError(f"no buckets of period {p}")
    return F.date_trunc(_UNITS[p][0], ts).cast("timestamp_ntz")


def bucket_end(ts: Column, p: Period) -> Column:
    if p is Period.FOREVER:
        return F.lit("9998-12-31 23:59:59.999").cast("timestamp_ntz")
    return bucket_start(ts, p) + F.expr(_UNITS[p][1]) - F.expr("INTERVAL '0.001' SECOND")


def lies_on_boundary(ts: Column, p: Period) -> Column:
    return (ts == bucket_start(ts, p)) | (ts == bucket_end(ts, p))


def includes(ts: Column, start: datetime, end: datetime) -> Column:
    return ts.between(lit_ts(start), lit_ts(end))


def slice_floor(ts: Column, width: int = SLICE_MS) -> Column:
    """The start of the buffer slice; the remainder truncates towards zero before 1970."""
    ms = millis(ts)
    return from_millis(ms - ms % width)


# The same for a single instant on the driver, for planning.


def start_of(t: datetime, p: Period) -> datetime:
    day = t.replace(hour=0, minute=0, second=0, microsecond=0)
    match p:
        case Period.FOREVER:
            return datetime(1, 1, 1)
        case Period.YEARLY:
            return day.replace(month=1, day=1)
        case Period.MONTHLY:
            return day.replace(day=1)
        case Period.WEEKLY:
            return day - timedelta(days=(day.weekday() + 1) % 7)
        case Period.DAILY:
            return day
        case Period.HOURLY:
            return t.replace(minute=0, second=0, microsecond=0)
        case Period.FIFTEEN_MINUTE:
            return t.replace(minute=t.minute // 15 * 15, second=0, microsecond=0)
        case Period.MINUTELY:
            return t.replace(second=0, microsecond=0)
        case Period.SECONDLY:
            return t.replace(microsecond=0)
    raise ValueError(f"no buckets of period {p}")


def next_start(t: datetime, p: Period) -> datetime:
    s = start_of(t, p)
    match p:
        case Period.FOREVER:
            return datetime(9999, 1, 1)
        case Period.YEARLY:
            return s.replace(year=s.year + 1)
        case Period.MONTHLY:
            return (s + timedelta(days=32)).replace(day=1)
        case Period.WEEKLY:
            return s + timedelta(days=7)
        case Period.DAILY:
            return s + timedelta(days=1)
        case Period.HOURLY:
            return s + timedelta(hours=1)
        case Period.FIFTEEN_MINUTE:
            return s + timedelta(minutes=15)
        case Period.MINUTELY:
            return s + timedelta(minutes=1)
    return s + timedelta(seconds=1)


def end_of(t: datetime, p: Period) -> datetime:
    return next_start(t, p) - MILLI


def on_boundary(t: datetime, p: Period) -> bool:
    return t in (start_of(t, p), end_of(t, p))


def to_dates(start: datetime, end: datetime, p: Period) -> list[datetime]:
    """Bucket starts from start's bucket on and before end; none if start equals end."""
    out, t = [], start_of(start, p)
    while start != end and t < end:
        out.append(t)
        t = next_start(t, p)
    return out


def spine(start: datetime, end: datetime, p: Period) -> Column:
    """The same as an array column."""
    step = "INTERVAL '1' MONTH" if p is Period.MONTHLY else "INTERVAL '1' YEAR" if p is Period.YEARLY else _UNITS[p][1]
    first = start_of(start, p)
    if start == end or first >= end:
        return F.array().cast("array<timestamp_ntz>")
    last = start_of(end - MILLI, p)
    return F.sequence(lit_ts(first), lit_ts(last), F.expr(step))
