"""Slices held over micro-batches: merged, passed on when late, sent off by newer ones or the clock, kept over restarts."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import tiers
from tidemark.streaming import held, ingest

FACT = "entity_id string, ts timestamp_ntz, name string, record_type string, value bigint, arrival_seq bigint"
T = datetime(2020, 5, 3, 10, 16)


def at(seconds):
    return T + timedelta(seconds=seconds)


class Feed:
    """A folder that gets a file for each micro-batch, and a stream of it whose outputs are kept."""

    def __init__(self, spark, tmp_path):
        self.spark, self.path, self.seq = spark, tmp_path, 0
        self.store, self.out = tiers.Store(spark, f"file://{tmp_path}/store"), []
        (tmp_path / "in").mkdir()

    def put(self, *facts):
        rows = []
        for entity, ts, name, kind, value in facts:
            self.seq += 1
            rows.append((entity, ts, name, kind, value, self.seq))
        self.spark.createDataFrame(rows, FACT).coalesce(1).write.mode("append").parquet(f"file://{self.path}/in")

    def start(self, hold_ms=3_600_000, groups=4):
        stream = self.spark.readStream.schema(FACT).option("maxFilesPerTrigger", 1).parquet(f"file://{self.path}/in")
        sink = lambda batch, number: self.out.extend(tuple(r) for r in batch.collect())
        return ingest.ingest(stream, self.store, f"file://{self.path}/progress", available_now=False, every="50 milliseconds", hold_ms=hold_ms, groups=groups, sinks=[sink])

    def sums(self):
        return {(r.entity_id, r.name): r.value for r in self.store.read().where("period = 'yearly'").collect()}


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path)


def test_a_slice_over_three_batches_is_one_row_and_late_rows_pass(feed):
    q = feed.start(groups=1)
    feed.put(("one", at(1), "m", "aggregate", 1), ("one", at(2), "l", "absolute", 10))
    feed.put(("one", at(50), "m", "aggregate", 2), ("one", at(60), "l", "absolute", 20))
    feed.put(("one", at(119), "m", "aggregate", 4), ("one", at(3), "l", "absolute", 30), ("two", at(5), "m", "aggregate", 100))
    held.settle(q)
    assert feed.out == [] and held.in_state(q)
    feed.put(("one", at(-500), "m", "aggregate", 8), ("one", at(-501), "m", "aggregate", 16))  # from the past: each for itself
    held.settle(q)
    assert sorted((r[1], r[4]) for r in feed.out) == [(at(-501), 16), (at(-500), 8)]
    feed.put(("one", at(120), "m", "aggregate", 32))  # a newer slice of one advances it for everybody
    held.settle(q)
    assert sorted((r[0], r[1], r[2], r[4]) for r in feed.out[2:]) == [("one", T, "l", 30), ("one", T, "m", 7), ("two", T, "m", 100)]
    q.stop()
    assert feed.sums() == {("one", "m"): 31, ("one", "l"): 30, ("two", "m"): 100}
    # A restart goes on from the checkpoint with what was held.
    q = feed.start(groups=1)
    feed.put(("one", at(130), "m", "aggregate", 64), ("two", at(300), "m", "aggregate", 200), ("one", at(300), "m", "aggregate", 1000))
    held.settle(q)
    q.stop()
    assert feed.sums() == {("one", "m"): 31 + 96, ("one", "l"): 30, ("two", "m"): 100}
    assert (T + timedelta(seconds=120), 96) in [(r[1], r[4]) for r in feed.out]


def test_groups_keep_slices_of_their_own(feed):
    q = feed.start(hold_ms=1_500, groups=1_000)
    feed.put(*[(f"e{i}", at(1), "m", "aggregate", i) for i in range(20)])
    feed.put(("e1", at(500), "m", "aggregate", 100))
    held.drain(q)
    assert sorted(r[4] for r in feed.out) == [*range(20), 100]
    assert feed.sums() == {(f"e{i}", "m"): i + (100 if i == 1 else 0) for i in range(20)}


def test_the_clock_ends_a_slice(feed):
    q = feed.start(hold_ms=500)
    feed.put(("one", at(1), "m", "aggregate", 1), ("one", at(4), "m", "aggregate", None), ("two", at(2), "l", "absolute", 5))
    held.drain(q)
    assert sorted((r[0], r[1], r[4]) for r in feed.out) == [("one", T, 1), ("two", T, 5)]
    assert feed.sums() == {("one", "m"): 1, ("two", "l"): 5}


def test_slices_of_one_batch_come_out_in_turn(feed):
    q = feed.start(hold_ms=500)
    feed.put(*[("one", at(60 * i), "m", "aggregate", 1) for i in range(10)], ("one", at(-60), "l", "absolute", 3), ("one", at(-70), "l", "absolute", 4))
    held.drain(q)
    assert sorted((r[1], r[2], r[4]) for r in feed.out) == [(at(-120), "l", 4), *((at(120 * i), "m", 2) for i in range(5))]


def test_a_switched_off_stream_reads_on_and_writes_nothing(spark, feed):
    stream = spark.readStream.schema(FACT).parquet(f"file://{feed.path}/in")

    def run(**more):
        ingest.ingest(stream, feed.store, f"file://{feed.path}/switch", **more).awaitTermination()

    feed.put(("one", at(1), "m", "aggregate", 1))
    run(discard=True)
    assert feed.store.read().count() == 0
    feed.put(("one", at(2), "m", "aggregate", 2))
    run()
    assert feed.sums() == {("one", "m"): 2}  # what was discarded stays so


def test_a_batch_that_fails_is_written_again(feed):
    """A sink that fails once: the batch is replayed, and the store holds it once."""
    stream = feed.spark.readStream.schema(FACT).parquet(f"file://{feed.path}/in")
    feed.put(("one", at(1), "m", "aggregate", 3))
    tries = []

    def sink(batch, number):
        tries.append(number)
        if len(tries) == 1:
            raise OSError("not now")

    with pytest.raises(Exception, match="not now"):
        ingest.ingest(stream, feed.store, f"file://{feed.path}/again", sinks=[sink]).awaitTermination()
    ingest.ingest(stream, feed.store, f"file://{feed.path}/again", sinks=[sink]).awaitTermination()
    assert tries == [0, 0] and feed.sums() == {("one", "m"): 3}
    assert feed.store.read().agg(F.max("last_seq")).first()[0] == 1


def test_rows_of_one_batch_in_chunks_are_late_for_none_of_them(spark, feed):
    """A group's rows come in chunks of any order. A slice ended by an earlier chunk of the same micro-batch is still that slice, to the store and to sinks."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        q = feed.start(groups=1)
    finally:
        spark.conf.set(key, before)
    # The slice that begins at 14 past the hour holds the first minute of the next quarter too.
    hours, end = range(1, 6), 3600 * 9
    counts = [("one", at(3600 * h + s), "m", "aggregate", 1) for s in (-119, -1, 0, 30) for h in (5, 2, 4, 1, 3)]
    lasts = [("one", at(3600 * h + s), "l", "absolute", h + s) for s in (-30, -90) for h in (3, 1, 5, 2, 4)]
    feed.put(("one", at(end), "m", "aggregate", 1), *counts, *lasts)
    held.settle(q)
    late = [("one", at(3600 - 60), "m", "aggregate", 100), ("one", at(3600 - 60), "m", "aggregate", 400), ("one", at(3600 - 61), "m", "aggregate", 200)]
    feed.put(*late)
    held.settle(q)
    q.stop()
    slices = [(at(3600 * h + s), "m", 2) for h in hours for s in (-120, 0)] + [(at(3600 * h - 120), "l", h - 90) for h in hours]
    assert sorted((r[1], r[2], r[4]) for r in feed.out) == sorted(slices + [(f[1], f[2], f[4]) for f in late])
    quarters = {(r.bucket_start, r.name): r.value for r in feed.store.read().where("period = 'fifteen_minute'").collect()}
    expected = {(at(3600 * h + s), "m"): 2 for h in hours for s in (-960, -60)} | {(at(3600 * h - 960), "l"): h - 90 for h in hours}
    expected[at(3600 - 60), "m"] += 500
    expected[at(3600 - 960), "m"] += 200
    assert quarters == expected


def test_a_batch_of_empty_files_is_not_the_end(spark, feed):
    for facts in [[], [("one", at(1), "m", "aggregate", 1)], [], [], [("one", at(900), "m", "aggregate", 2)]]:
        spark.createDataFrame([(*f, n) for n, f in enumerate(facts)], FACT).coalesce(1).write.mode("append").parquet(f"file://{feed.path}/in")
    q = feed.start(hold_ms=1)
    held.drain(q)
    assert feed.sums() == {("one", "m"): 3}
