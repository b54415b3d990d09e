"""Entity and metric ids, referrers, and the text forms of dates and values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_URL = 500
UNKNOWN = "%unknown%"


def join_parts(*parts: Column | str) -> Column:
    """The concatenation of an id's parts; a null part reads %unknown%."""
    return F.concat(*[F.coalesce(p, F.lit(UNKNOWN)) if isinstance(p, Column) else F.lit(p) for p in parts])


def is_unresolved(part: Column) -> Column:
    return part.startswith("%") & part.endswith("%")


def replace_part(parts: Column, old: Column | str, new: Column | str) -> Column:
    """An array of parts with each one equal to old replaced."""
    old, new = (x if isinstance(x, Column) else F.lit(x) for x in (old, new))
    return F.transform(parts, lambda p: F.when(p == old, new).otherwise(p))


def has_part(parts: Column, part: str) -> Column:
    return F.coalesce(F.array_contains(parts, part), F.lit(False))


def referrer(url: Column) -> Column:
    return F.substring(url, 1, MAX_URL)


def referrer_path(url: Column) -> Column:
    query = F.try_parse_url(url, F.lit("QUERY"))
    tail = F.when(F.trim(query) != "", F.concat(F.lit("?"), query)).otherwise("")
    return F.concat(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.coalesce(tail, F.lit("")))


def referrer_host(url: Column) -> Column:
    return F.concat_ws("-", F.try_parse_url(url, F.lit("PROTOCOL")), F.try_parse_url(url, F.lit("HOST")))


def parse_date(text: Column) -> Column:
    """`yyyy-MM-dd HH:mm:ss:SSS` or `yyyy-MM-dd`; null for anything else."""
    full, day = (F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss:SSS", "yyyy-MM-dd"))
    return F.coalesce(full, day).cast("timestamp_ntz")


def parse_value(text: Column) -> Column:
    """A value's text as BIGINT: integers as they are, other numbers cut toward zero, null for `null`,
    for what is no number, and for numbers that are not finite or beyond 64 bits."""
    whole = F.regexp_like(text, F.lit(r"\A-?[0-9]+\z"))
    return F.when(F.lower(text) == "null", None).when(whole, text.try_cast("bigint")).otherwise(
        text.try_cast("double").try_cast("bigint")
    )


def is_value(text: Column) -> Column:
    """Whether a value's text is `null` or a number that a BIGINT holds once it is cut."""
    return F.coalesce((F.lower(text) == "null") | parse_value(text).isNotNull(), F.lit(False))


def full_match(text: Column, pattern: str) -> Column:
    """Whether the whole text matches a Java regular expression."""
    return F.regexp_like(text, F.lit(rf"\A(?:{pattern})\z"))


def row_key(entity: Column, bucket_ms: Column) -> Column:
    return F.concat_ws("-", entity, bucket_ms)


def strip_timestamp(key: Column) -> Column:
    return F.regexp_replace(key, "-[0-9]+$", "")


def table_name(period: Column, record_type: Column) -> Column:
    return F.concat_ws("_", period, record_type)
