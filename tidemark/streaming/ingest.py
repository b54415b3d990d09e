"""Ingest: buffers of 120 seconds and streams into the store.

Late data are never dropped: each micro-batch is written as a batch of its own and the store merges batches as it
reads. Slices are merged within a micro-batch (`buffer`) or over micro-batches, as keyed state (`hold_ms`).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.periods import SLICE_MS, slice_floor
from ..operators.combine import last, total
from ..operators.facts import AGGREGATE
from ..operators.tiers import Store
from .held import GROUPS, held, state_store, whole


def buffered(facts: DataFrame, width: int = SLICE_MS) -> DataFrame:
    """Facts merged by entity, slice, name and type, stamped with the slice's start. Slices of 120
    seconds straddle every other quarter of an hour, and so do what they hold."""
    rows = facts.groupBy("entity_id", slice_floor(F.col("ts"), width).alias("ts"), "name", "record_type").agg(
        total().alias("_sum"), last(F.col("arrival_seq")).alias("_last"), F.max("arrival_seq").alias("arrival_seq")
    )
    value = F.when(F.col("record_type") == AGGREGATE, F.col("_sum")).otherwise(F.col("_last"))
    return rows.select("entity_id", "ts", "name", "record_type", value.alias("value"), "arrival_seq")


def ingest(
    stream: DataFrame, store: Store, checkpoint: str, to_facts: Callable[[DataFrame], DataFrame] = lambda d: d,
    buffer: bool = False, available_now: bool = True, every: str = "1 second", discard: bool = False,
    sinks: Sequence[Callable[[DataFrame, int], None]] = (), compact_every: int = 0, hold_ms: int | None = None, groups: int = GROUPS,
) -> StreamingQuery:
    """Start writing a stream into the store. A micro-batch that is replayed after a failure replaces
    what it wrote before. `buffer` merges by slice first; `discard` reads on and writes nothing.
    Each of `sinks` gets the same facts and the batch's number; a sink that fails fails the batch, which is
    then replayed to all. With `compact_every` the store's levels are compacted after each so many batches. With `hold_ms` the
    slice that a group of metrics is in is held over micro-batches (`held`), so long at most; that takes a stream which runs on."""
    if hold_ms is not None:
        stream, to_facts = held(to_facts(stream), hold_ms=hold_ms, groups=groups), lambda d: d

    once = bool(sinks) or hold_ms is not None  # whether a batch is used more than once

    def write(batch: DataFrame, number: int) -> None:
        if discard:
            batch.write.format("noop").mode("overwrite").save()
            return
        facts = to_facts(batch)
        facts = buffered(facts) if buffer else facts
        if hold_ms is not None and not buffer:
            facts = whole(facts) if sinks else facts.drop("late")  # the store adds parts up
        if once:
            facts = facts.persist()
        try:
            if hold_ms is not None and facts.isEmpty():
                return  # the clock makes batches in which nothing is sent off
            store.persist(facts, batch=number)
            for sink in sinks:
                sink(facts, number)
        finally:
            if once:
                facts.unpersist()
        if compact_every and number % compact_every == compact_every - 1:
            store.compact_levels()

    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    out = out.trigger(availableNow=True) if available_now else out.trigger(processingTime=every)
    if hold_ms is None:
        return out.start()
    with state_store(stream.sparkSession):
        return out.start()
