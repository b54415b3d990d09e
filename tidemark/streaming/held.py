"""The buffer of a slice as keyed state of a stream: a slice is held until a newer one or the clock ends it."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..functions.periods import SLICE_MS, from_millis, millis, slice_floor
from ..operators.combine import last, total
from ..operators.facts import AGGREGATE

KEY = ["entity_id", "name", "record_type"]
COLUMNS = [*KEY, "ms", "value", "seq", "late"]
#: Groups of metrics that share a slice.
GROUPS = 256
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Slice(StatefulProcessor):
    """The slice that a group of metrics is in: its start, when the clock ends it, and each metric's sum or last value in it.

    A row of an older slice than the one that the group was in before the micro-batch passes straight through with its own time. One of a newer
    slice advances the slice for the whole group: all that is held is sent off, stamped with its slice's start. What no newer slice ends is sent
    off `hold_ms` after it was begun. Spark hands a group's rows over in chunks, in no order: a slice that one chunk ended may have more rows in
    another, and is then sent off in a part for each, so that a task holds the slices of one chunk and no more.
    """

    def __init__(self, hold_ms: int):
        self.hold_ms = hold_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.now = handle.getValueState("slice", "slice bigint, due bigint")
        self.metrics = handle.getMapState("metrics", "entity_id string, name string, record_type string", "value bigint, seq bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        current, due = self.now.get() if self.now.exists() else (None, None)
        before = {tuple(k): tuple(v) for k, v in self.metrics.iterator()} if current is not None else {}
        held, started = dict(before), current
        for batch in rows:
            out, slices = [], {} if current is None else {current: held}
            for entity, name, kind, start, ms, value, seq in batch[[*KEY, "slice", "ms", "value", "seq"]].itertuples(index=False, name=None):
                if started is not None and start < started:
                    out.append((entity, name, kind, ms, value, seq, True))
                    continue
                metrics, metric = slices.setdefault(start, {}), (entity, name, kind)
                before_, at = metrics.get(metric, (None, None))
                if at is not None:
                    value = before_ + value if kind == AGGREGATE else value if seq > at else before_
                    seq = max(seq, at)
                metrics[metric] = (value, seq)
            *ended, current = sorted(slices) or [None]
            out += [(*k, start, *v, False) for start in ended for k, v in slices[start].items()]
            held = slices.get(current, {})
            yield _frame(out)
        # State is read and written once a batch, for the slice that is current at its start and its end.
        if current != started:
            if started is not None:
                self.metrics.clear()
                self.handle.deleteTimer(due)
                before = {}
            due = timerValues.getCurrentProcessingTimeInMs() + self.hold_ms
            self.handle.registerTimer(due)
            self.now.update((current, due))
        for k, v in held.items():
            if before.get(k) != v:
                self.metrics.updateValue(k, v)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.now.exists():
            start = self.now.get()[0]
            yield _frame([(*k, start, *v, False) for k, v in self.metrics.iterator()])
            self.metrics.clear()
            self.now.clear()

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=COLUMNS).astype(dict.fromkeys(COLUMNS[3:6], "int64") | {"late": bool} | dict.fromkeys(KEY, object))


def held(facts: DataFrame, width: int = SLICE_MS, hold_ms: int = SLICE_MS, groups: int = GROUPS) -> DataFrame:
    """A stream of facts, those of the current slice merged over micro-batches into one a metric, with a column `late` for those that pass.

    Metrics are dealt to groups by a hash of entity, name and type, so that the metrics of a busy entity spread over tasks; a group's
    slice advances for all of it, and with one group for everybody. Nothing is dropped: what comes late is a fact of its own. State is a row for
    each metric that has facts in its group's slice; it is part of the stream's checkpoint, from which a restart goes on. The number of groups
    belongs to the checkpoint too. Null values are left out, as they are when stored. A slice that a micro-batch begins and ends can come out
    in parts, which add up as facts do; `whole` joins those of a batch.
    """
    rows = facts.where(F.col("value").isNotNull()).select(
        F.pmod(F.xxhash64(*KEY), F.lit(groups)).alias("group"), *KEY, millis(slice_floor(F.col("ts"), width)).alias("slice"),
        millis(F.col("ts")).alias("ms"), "value", F.col("arrival_seq").alias("seq"),
    )
    merged = rows.groupBy("group").transformWithStateInPandas(
        statefulProcessor=Slice(hold_ms), outputStructType="entity_id string, name string, record_type string, ms bigint, value bigint, seq bigint, late boolean",
        outputMode="append", timeMode="ProcessingTime",
    )
    return merged.select("entity_id", from_millis(F.col("ms")).alias("ts"), "name", "record_type", "value", F.col("seq").alias("arrival_seq"), "late")


def whole(batch: DataFrame) -> DataFrame:
    """The facts of a micro-batch of `held`, the parts of a metric's slice as one. What is late stays a fact of its own."""
    own = F.when(F.col("late"), F.col("arrival_seq")).alias("own")
    rows = batch.groupBy("entity_id", "ts", "name", "record_type", own).agg(
        total().alias("_sum"), last(F.col("arrival_seq")).alias("_last"), F.max("arrival_seq").alias("arrival_seq")
    )
    value = F.when(F.col("record_type") == AGGREGATE, F.col("_sum")).otherwise(F.col("_last"))
    return rows.select("entity_id", "ts", "name", "record_type", value.alias("value"), "arrival_seq")


@contextmanager
def state_store(spark: SparkSession):
    """Spark's RocksDB state store, which such state needs, for streams started within; a stream keeps the
    setting that it was started with."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def in_state(query: StreamingQuery) -> int | None:
    """How many rows of state a running stream holds, null before its first batch."""
    last = query.lastProgress
    return last and sum(s.numRowsTotal for s in last.stateOperators)


def settle(query: StreamingQuery, every: float = 0.05) -> None:
    """Wait until a running stream has read what was there at the call: until a batch that began after it reads nothing and goes no further
    in its sources, as one of empty files does.
    A stream whose timers run by the clock makes batches without input, so processAllAvailable() would not return."""
    began = query.lastProgress.batchId + 1 if query.lastProgress else 0
    while query.isActive:
        last = query.lastProgress
        if last and last.batchId > began and last.numInputRows == 0 and all(s.startOffset == s.endOffset for s in last.sources):
            return
        time.sleep(every)
    if failed := query.exception():
        raise failed


def drain(query: StreamingQuery, every: float = 0.05) -> None:
    """Wait until a running stream has read what there is and holds nothing any more, and stop it."""
    settle(query, every)
    while query.isActive and in_state(query):
        time.sleep(every)
    failed = query.exception()
    query.stop()
    if failed:
        raise failed
