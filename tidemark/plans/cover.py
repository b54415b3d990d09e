"""Which tiers answer a range: the coarsest buckets that tile it."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from ..functions.periods import DEFAULT_TIERS, MILLI, Period, next_start, start_of

Interval = tuple[Period, datetime, datetime]


def aligned(start: datetime, end: datetime, p: Period) -> tuple[datetime, datetime]:
    """[first, last) of the whole buckets of p within [start, end); at `start` and empty if there is none."""
    first = start if start == start_of(start, p) else next_start(start, p)
    last = start_of(end, p)
    return (first, last) if first < last else (start, start)


def cover(start: datetime, end: datetime, tiers: Sequence[Period] = DEFAULT_TIERS) -> list[Interval]:
    """(period, start, inclusive end) intervals, finest period first, without overlap.

    The buckets of a tier nest in those of the coarser ones, and so do the spans that whole buckets of
    each tier fill within the range: a tier answers its own span less that of the next coarser
    tier, which leaves up to two intervals, or one where that tier fills nothing. The finest tier's
    span is the range widened to its buckets, that of the range's end included. Weeks nest in
    nothing and take no part.
    """
    if start > end:
        return []
    kept = sorted((t for t in tiers if t not in (Period.FOREVER, Period.WEEKLY)), reverse=True)
    kept = kept or [max(tiers)]
    whole = (start_of(start, kept[0]), next_start(end, kept[0]))
    spans = [whole, *(aligned(*whole, p) for p in kept[1:])]
    out: list[Interval] = []
    for p, (a, b), (x, y) in zip(kept, spans, [*spans[1:], (whole[0], whole[0])], strict=True):
        rest = [(a, x), (y, b)] if x < y else [(a, b)]
        out += [(p, lo, hi - MILLI) for lo, hi in rest if lo < hi]
    return out
