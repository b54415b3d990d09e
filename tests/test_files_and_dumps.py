"""Polled record files and rejects, rotation by slice, facts of streams, verified dumps, entities as tables."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions.periods import Period
from tidemark.operators import tiers, verbs
from tidemark.sources import messages, records
from tidemark.streaming import ingest, progress

FACT = "entity_id string, ts timestamp_ntz, name string, record_type string, value bigint, arrival_seq bigint"
T = datetime(2020, 5, 3, 10, 16)
RECORD = b"\xff1577836800000\xfee\xfem\xfe%s\xfe%s\xfe"


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def put(path, *values, kind=b"absolute"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"".join(RECORD % (v, kind) for v in values))


def test_polled_files_in_order_with_rejects_and_an_archive(spark, tmp_path):
    folder, store = tmp_path / "in", tiers.Store(spark, f"file://{tmp_path}/store")

    def run():
        stream = records.stream(spark, f"file://{folder}", archive=f"file://{tmp_path}/old", maxFilesPerTrigger=2)
        records.poll(stream, store, f"file://{tmp_path}/rejects", f"file://{tmp_path}/staged", f"file://{tmp_path}/progress", every=None).awaitTermination()
        bad = spark.read.schema("path string, error string").parquet(f"file://{tmp_path}/rejects")
        return rows(store.read().where("period = 'yearly'"), "value"), [os.path.basename(r.path) for r in bad.collect()]

    now = datetime.now().timestamp()
    for k, (name, v) in enumerate({"x/b.completed": b"1", "y/a.completed": b"2", "x/bad.completed": b"oops", "x/c.completed": b"3"}.items()):
        put(folder / name, v)
        os.utime(folder / name, (now + k // 2, now + k // 2))  # two files of one time go by name
    put(folder / "z.data", b"77")
    assert run() == ([(3,)], ["bad.completed"])
    put(folder / "a.completed", b"9", b"8")
    os.utime(folder / "a.completed", (now - 1000, now - 1000))  # older than all, but read later
    assert run() == ([(8,)], ["bad.completed"])
    assert run() == ([(8,)], ["bad.completed"])
    put(folder / "d.completed", b"10")
    assert run()[0] == [(10,)]
    assert any(p.name == "b.completed" for p in (tmp_path / "old").rglob("*")) and not (folder / "x" / "b.completed").exists()


def at(seconds):
    return T + timedelta(seconds=seconds)


def test_files_rotate_by_slice_and_count_and_replays_change_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/out"

    def batch(*times, first=0):
        return spark.createDataFrame([("e", at(t), "m", "aggregate", 1, first + i) for i, t in enumerate(times)], FACT)

    one, two, three = batch(*range(100), first=0), batch(110, 115, 130, first=100), batch(300, -3600, first=200)

    def names(end):
        return sorted(n for n in os.listdir(tmp_path / "out") if n.endswith(end))

    records.rotate(one, 0, folder, per_file=10, parts=2)
    assert names(".completed") == [] and len(names(".data")) >= 10
    records.rotate(two, 1, folder, per_file=10, parts=2)
    open_ = names(".data")
    assert len(names(".completed")) >= 10 and open_ and len({n.split("-")[0] for n in open_}) == 1
    for _ in range(2):
        records.rotate(two, 1, folder, per_file=10, parts=2)  # a replay
        assert names(".data") == open_
    records.rotate(three, 2, folder, per_file=10, parts=2)
    records.rotate(two, 1, folder, per_file=10, parts=2)  # one after its files were completed
    assert len(names(".data")) == 1
    records.complete(folder, all_=True)
    assert names(".data") == [] and names(".lock") == []
    read = records.decode(records.files(spark, folder))
    per = read.groupBy("path").agg(F.count("*").alias("n"), F.count_distinct(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 120)).alias("slices"))
    assert {r.slices for r in per.collect()} == {1} and max(r.n for r in per.collect()) <= 10
    assert rows(read, "ts") == sorted([(at(t),) for t in (*range(100), 110, 115, 130, 300, -3600)], key=str)


def test_streams_tell_of_themselves(spark, tmp_path):
    told = progress.ProgressFacts()
    spark.streams.addListener(told)
    try:
        for name, bad in (("good", False), ("bad", True)):
            source = f"file://{tmp_path}/{name}"
            for k in range(2):
                spark.createDataFrame([("e", T, "m", "aggregate", 1, k)] * (k + 2), FACT).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(FACT).option("maxFilesPerTrigger", 1).parquet(source)

            def fail(batch, number, bad=bad):
                if bad:
                    raise OSError("no room")

            q = ingest.ingest(stream, tiers.Store(spark, f"{source}-store"), f"{source}-progress", sinks=[fail])
            if bad:
                with pytest.raises(Exception, match="no room"):
                    q.awaitTermination()
            else:
                q.awaitTermination()
            assert told.wait(q)
            ended = str(q.id)
            facts = told.take(spark).groupBy("entity_id", "name", "record_type").agg(F.sum("value").alias("v")).collect()
            sums = {r.name: r.v for r in facts if r.record_type == "aggregate"}
            assert {r.entity_id for r in facts} == {f"stream-{ended}"}
            assert sums == ({"starts": 1, "stops": 1, "failures": 1} if bad else {"starts": 1, "stops": 1, "batches": 2, "heartbeats": 2, "rows-in": 5})
            assert bad or {r.name for r in facts if r.record_type == "absolute"} == {"batch-ms", "delay-ms"}
    finally:
        spark.streams.removeListener(told)
    assert told.take(spark).count() == 0


def test_a_dump_is_checked_as_it_is_written(spark, tmp_path):
    f = spark.createDataFrame([(e, at(k), n, "aggregate", 1, k) for e in "ab" for k in (0, 90_000) for n in "xy"] + [("a", at(1), "z", "absolute", 4, 9)], FACT)
    built = tiers.build(f)
    written = []

    def write(df, path):
        written.append(df)
        messages.write_dump(df, path)

    assert verbs.write_verified(built, f"file://{tmp_path}/whole", write) == 9
    plan = written[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("CollectMetrics") == 1
    assert rows(messages.read_dump(spark, f"file://{tmp_path}/whole"), "entity_id", "name") == rows(verbs.dump(built), "entity_id", "name")
    fine, coarse = F.col("period") == "fifteen_minute", F.col("period") == "yearly"
    for k, (gone, said) in enumerate([
        (fine & (F.col("name") == "z"), "1 yearly metrics"), (coarse & (F.col("name") == "x") & (F.col("entity_id") == "b"), "2 fifteen_minute rows"),
    ]):
        with pytest.raises(verbs.DumpMismatch, match=said):
            verbs.write_verified(built.where(~gone), f"file://{tmp_path}/{k}", messages.write_dump)
    assert verbs.write_verified(built.where(~(fine & (F.col("name") == "z"))), f"file://{tmp_path}/b", messages.write_dump, ["b"]) == 4
    built.write.format("noop").mode("overwrite").save()  # the sink that takes all and keeps nothing


def test_a_hundred_thousand_entities(spark):
    f = spark.createDataFrame([(f"e{i}", T, "m", "aggregate", i, i) for i in range(0, 200_000, 2_000)], FACT)
    built = tiers.build(f, (Period.DAILY, Period.YEARLY))
    asked = [f"e{i}" for i in range(100_000)]
    a, b = datetime(2020, 5, 3), datetime(2020, 5, 4)
    got = verbs.ranges(built, asked, a, b, supported=(Period.DAILY, Period.YEARLY))
    assert rows(got, "entity_id", "value") == sorted(((f"e{i}", i) for i in range(0, 100_000, 2_000)), key=str)
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    table = spark.createDataFrame([(e,) for e in [*asked, "e0", None]], "entity_id string")
    assert rows(verbs.ranges(built, table, a, b, supported=(Period.DAILY, Period.YEARLY)), "entity_id", "value") == rows(got, "entity_id", "value")
    dense = verbs.series(built, table, Period.DAILY, a, b, supported=(Period.DAILY, Period.YEARLY))
    assert dense.count() == 100_000 and dense.where("value is not null").count() == 50


def test_the_form_of_messages_is_a_setting(spark):
    f = spark.createDataFrame([("e", T, "m", "aggregate", 5, 1), ("e", T, "l", "absolute", -3, 1)], FACT)
    cols = ["entity_id", "ts", "name", "record_type", "value"]
    for name in ("json", "JSON ", "protobuf"):
        form = messages.form(name)
        assert rows(form.read(form.write(f)), *cols) == rows(f, *cols)
        assert form.bag(verbs.range_(tiers.build(f), "e", T, T)).count() == 1
    with pytest.raises(ValueError, match="no form of messages named xml; there are json, protobuf"):
        messages.form("xml")


def test_reads_share_a_store_until_the_events_change(spark, tmp_path):
    from tidemark import catalog

    sf = f"file://{tmp_path}/sf"
    events = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
    seen = []
    for n in (1, 3):
        spark.createDataFrame([(i, T, 7, "click", 1.0) for i in range(n)], events).coalesce(1).write.mode("overwrite").parquet(f"{sf}/events.parquet")
        for _ in range(2):
            seen.append(catalog.event_tiers(spark, sf, ["user-7"]).where("period = 'yearly' and name = 'click'").first().value)
    assert seen == [1, 1, 3, 3]
