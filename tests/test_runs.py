"""Record files from writer to store, messages that do not parse, and streams into several sinks."""

import os
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions.identifiers import is_value, parse_value
from tidemark.functions.periods import Period
from tidemark.operators import facts, tiers, verbs
from tidemark.plans.cover import aligned, cover
from tidemark.sources import messages, records
from tidemark.streaming.ingest import ingest

FACT = "entity_id string, ts timestamp_ntz, name string, record_type string, value bigint, arrival_seq bigint"
T = datetime(2020, 5, 3, 10, 16)
RECORD = b"\xff1577836800000\xfee\xfem\xfe%s\xfeaggregate\xfe"


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_numbers_that_no_bigint_holds(spark):
    df = spark.createDataFrame([("NaN",), ("Infinity",), ("1e30",), ("-1e30",), ("99999999999999999999",), ("1.9e3",), ("null",), ("x",), (None,)], "s string")
    got = [tuple(r) for r in df.select(parse_value(F.col("s")), is_value(F.col("s"))).collect()]
    assert got == [(None, False)] * 5 + [(1900, True), (None, True), (None, False), (None, False)]
    events = spark.createDataFrame([(1, T, 5, "click", v) for v in (float("nan"), float("inf"), 1e30, 2.9)], "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double")
    assert rows(facts.from_events(events).where("name = 'click-value'"), "value") == [(2,), (None,), (None,), (None,)]


@pytest.mark.parametrize("value", [b"NaN", b"1e30", b"x", b""])
def test_one_bad_value_spoils_its_file_alone(spark, value):
    content = [("good", RECORD % b"1" + RECORD % b"2.7"), ("bad", RECORD % b"1" + RECORD % value)]
    got = rows(records.decode(spark.createDataFrame(content, "path string, content binary")), "path", "error", "value", "pos")
    assert got == [("bad", records.BAD_FILE, None, None), ("good", None, 1, 1), ("good", None, 2, 2)]


def test_a_run_stores_good_files_and_sets_bad_ones_aside(spark, tmp_path):
    folder, store = tmp_path / "in", tiers.Store(spark, f"file://{tmp_path}/store")
    (folder / "sub").mkdir(parents=True)
    two = RECORD.replace(b"aggregate", b"absolute")
    for name, content in {
        "a.data.completed": RECORD % b"1" + two % b"7", "b.data.completed": RECORD % b"2" + two % b"8", "c.data": RECORD % b"100",
        "bad.data.completed": RECORD % b"oops", "sub/d.data.completed": b"", "sub/old.broken": b"junk", "sub/e.lock": RECORD % b"50",
    }.items():
        (folder / name).write_bytes(content.replace(b"\xfem\xfe7", b"\xfel\xfe7").replace(b"\xfem\xfe8", b"\xfel\xfe8"))
    done = {os.path.basename(r.path): (r.error, r.records) for r in records.run(spark, f"file://{folder}", store, f"file://{tmp_path}/work", 0).collect()}
    assert done == {"a.data.completed": (None, 2), "b.data.completed": (None, 2), "bad.data.completed": (records.BAD_FILE, 0)}  # Spark lists no empty files
    left = sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file() and not p.name.endswith(".crc"))
    assert left == ["bad.data.completed.broken", "c.data", "sub/d.data.completed", "sub/e.lock", "sub/old.broken"]
    assert rows(store.read().where("period = 'yearly'"), "name", "value") == [("l", 8), ("m", 3)]
    assert records.run(spark, f"file://{folder}", store, f"file://{tmp_path}/work", 1).count() == 0
    assert rows(store.read().where("period = 'yearly'"), "name", "value") == [("l", 8), ("m", 3)]


def test_written_files_are_whole_and_bounded(spark, tmp_path):
    f = spark.createDataFrame([("e", T, "m", "aggregate", i, i) for i in range(25)], FACT).coalesce(1)
    records.write(f, f"file://{tmp_path}/out", per_file=10)
    names = sorted(os.listdir(tmp_path / "out"))
    assert len(names) == 3 and all(n.endswith(".data.completed") for n in names)
    assert rows(records.decode(records.files(spark, f"file://{tmp_path}/out")), "value") == sorted(((i,) for i in range(25)), key=str)


def test_a_stream_of_record_files_and_two_sinks(spark, tmp_path):
    folder, second = tmp_path / "in", tmp_path / "second"
    folder.mkdir()
    (folder / "a.completed").write_bytes(RECORD % b"4" + RECORD % b"null")
    (folder / "b.completed").write_bytes(b"junk")
    (folder / "c.lock").write_bytes(RECORD % b"9")
    store = tiers.Store(spark, f"file://{tmp_path}/store")

    def start(**more):
        q = ingest(records.stream(spark, f"file://{folder}"), store, f"file://{tmp_path}/progress", records.to_facts, **more)
        return q

    sink = lambda batch, number: batch.write.mode("overwrite").parquet(f"file://{second}/batch={number}")
    start(sinks=[sink]).awaitTermination()
    assert rows(store.read().where("period = 'daily'"), "value") == [(4,)]
    assert rows(spark.read.parquet(f"file://{second}"), "value") == [(4,), (None,)]
    (folder / "d.completed").write_bytes(RECORD % b"5")
    q = start(available_now=False, every="200 milliseconds")
    q.processAllAvailable()
    q.stop()
    assert rows(store.read().where("period = 'daily'"), "value") == [(9,)]


def test_messages_that_are_not_whole_are_rejected(spark):
    good = '{"entityId":"e","timestamp":0,"metrics":{"m":{"value":1.7,"type":"ABSOLUTE"}}}'
    bad = ["{bad", "", '{"timestamp":0,"metrics":{}}', '{"entityId":"e","timestamp":0}', good.replace("ABSOLUTE", "SUM"), good[:-3]]
    df = spark.createDataFrame([(x,) for x in [good, *bad]], "value string")
    assert rows(messages.from_json(df), "name", "value", "record_type") == [("m", 1, "absolute")]
    assert rows(messages.rejected(df), "value") == sorted((x,) for x in bad)


def test_protobuf_decimals_batches_and_bags(spark):
    classes = messages._protobuf()
    m = classes["Message"](entity_id="e", version=0, timestamp=0)
    for name, unscaled, scale in (("a", -12345, 2), ("b", 7, -3), ("c", 2**80, 0)):
        p = m.metrics.add(name=name, type=0)
        p.value.type, p.value.big_decimal_value.scale = 4, scale
        p.value.big_decimal_value.value.value = unscaled.to_bytes(12, "big", signed=True)
    # By hand: an INT of 150 under the published field numbers.
    by_hand = b"\x0a\x01e\x10\x00\x18\x00\x22\x0c\x08\x01\x12\x01i\x1a\x05\x08\x01\x10\x96\x01"
    df = spark.createDataFrame([(bytearray(m.SerializeToString()),), (bytearray(by_hand),)], "content binary")
    got = rows(messages.from_protobuf(df), "name", "record_type", "value")
    assert got == [("a", "aggregate", -123), ("b", "aggregate", 7000), ("c", "aggregate", None), ("i", "absolute", 150)]
    bag = spark.createDataFrame([("x", "aggregate", Decimal(2**70)), ("y", "absolute", Decimal(-3))], "name string, record_type string, value decimal(38,0)")
    assert rows(messages.bag_from_protobuf(messages.bag_protobuf(bag)), "name", "value") == rows(bag, "name", "value")
    f = spark.createDataFrame([(f"e{i}", T, "m", "aggregate", i, i) for i in range(7)], FACT).coalesce(1)
    sent = messages.to_protobuf(f, batch=3)
    assert sent.count() >= 3
    assert rows(messages.from_protobuf(sent, batch=True), "entity_id", "value") == rows(f, "entity_id", "value")


def test_compaction_in_place(spark, tmp_path):
    store = tiers.Store(spark, f"file://{tmp_path}/t")
    assert store.read().count() == 0
    for batch in range(5):
        store.persist(spark.createDataFrame([("e", T, "m", "aggregate", 1, batch), ("e", T, "l", "absolute", batch, batch)], FACT), batch)
        if batch % 2:
            store.compact()
            store.compact()
    store.persist(spark.createDataFrame([("e", T, "m", "aggregate", 99, 1)], FACT), 1)  # a replay of what is merged already
    assert rows(store.read().where("period = 'daily'"), "name", "value") == [("l", 4), ("m", 5)]
    assert sorted(p for p in os.listdir(tmp_path / "t")) == ["batch=2", "batch=3", "batch=4", "batch=to-1", "batch=to-3"]


def test_series_comes_in_order(spark):
    f = spark.createDataFrame([(e, datetime(2020, 1, d), n, "aggregate", 1, 1) for e in "ba" for d in (5, 2, 9) for n in "yx"], FACT).repartition(4)
    got = [tuple(r) for r in verbs.series(tiers.build(f), ["b", "a"], Period.DAILY, datetime(2020, 1, 1), datetime(2020, 1, 10)).select("entity_id", "bucket_start", "name").collect()]
    assert got == sorted(got, key=lambda r: (r[0], r[1], r[2] or "")) and len(got) == 2 * (6 + 6)


def test_spans_of_whole_buckets():
    a, b = datetime(2010, 1, 30, 23, 45), datetime(2010, 4, 2)
    assert aligned(a, b, Period.MONTHLY) == (datetime(2010, 2, 1), datetime(2010, 4, 1)) and aligned(a, b, Period.YEARLY) == (a, a)
    assert cover(b, a) == []
    weekly = cover(a, b, (Period.DAILY, Period.WEEKLY, Period.MONTHLY))
    assert {p for p, _, _ in weekly} == {Period.DAILY, Period.MONTHLY}


def test_fsck_names_what_a_side_lacks(spark):
    built = tiers.build(spark.createDataFrame([("e", T, "m", "aggregate", 3, 1), ("e", T, "l", "absolute", 5, 2)], FACT))
    assert verbs.fsck(built).count() == 0
    lacks = built.where("not (period = 'daily' and name = 'm')")
    assert rows(verbs.fsck(lacks), "period", "name", "stored", "expected") == [("daily", "m", None, 3), ("monthly", "m", 3, None)]


def put(folder, name, *values, kind=b"absolute"):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(b"".join((RECORD % v).replace(b"aggregate", kind) for v in values))


def test_the_newer_run_has_the_last_word(spark, tmp_path):
    folder, store = tmp_path / "in", tiers.Store(spark, f"file://{tmp_path}/store")

    def run(batch):
        records.run(spark, f"file://{folder}", store, f"file://{tmp_path}/work", batch)
        return rows(store.read().where("period = 'yearly'"), "value")

    for name, v in (("a", b"100"), ("b", b"101"), ("c", b"102")):
        put(folder, f"{name}.completed", v)
    assert run(0) == [(102,)]
    put(folder, "a.completed", b"999", b"1000", b"999")
    assert run(1) == [(999,)]
    # Files of several folders come in order of their names, whatever their folders.
    put(folder / "y", "1.completed", b"1")
    put(folder / "x", "2.completed", b"2")
    assert run(2) == [(2,)]
    store.compact()
    put(folder, "0.completed", b"5")
    assert run(3) == [(5,)]


def test_places_run_on_over_ranges_of_files(spark, tmp_path):
    names = [f"f{i:03d}" for i in range(40)]
    read = spark.createDataFrame([(n, p) for n in names for p in range(1, 4)], "path string, pos int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = records.in_order(read, spark.createDataFrame([(n,) for n in names[::-1]], "path string"), f"file://{tmp_path}/w", 1000)
        got = [tuple(r) for r in placed.orderBy("arrival_seq").select("path", "pos", "arrival_seq").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r[:2] for r in got] == [(n, p) for n in names for p in range(1, 4)]
    assert got[0][2] == 1001 and got[-1][2] == 1000 + 39 * 4 + 3


def written(folder) -> int:
    return sum(p.stat().st_size for p in folder.rglob("*.parquet") if "_entities" not in str(p))


def test_levels_write_each_row_a_logarithmic_number_of_times(spark, tmp_path):
    store, made = tiers.Store(spark, f"file://{tmp_path}/t", (Period.DAILY, Period.YEARLY), fan=2), {}
    for batch in range(8):
        store.persist(spark.createDataFrame([(f"e{batch}-{i}", T, "m", "aggregate", 1, 9 * batch) for i in range(9)], FACT), batch)
        store.compact_levels()
        made |= {f.path: (f.level, spark.read.parquet(f.path).count()) for f in store.folders()}
    assert [(f.first, f.last, f.level) for f in store.live()] == [(0, 7, 3)]
    by_level = {level: sum(n for at, n in made.values() if at == level) for level in range(4)}
    assert by_level == dict.fromkeys(range(4), 8 * 9 * 2)  # each row once a level
    store.persist(spark.createDataFrame([("e0-0", T, "m", "aggregate", 50, 0)], FACT), 3)  # a replay of what is merged
    assert store.read().where("period = 'daily'").agg(F.sum("value")).first()[0] == 72
    assert store.next_seq(8) == 64 and store.next_seq(0) == 0


def test_a_compaction_that_is_cut_off_changes_nothing(spark, tmp_path):
    store = tiers.Store(spark, f"file://{tmp_path}/t", fan=2)
    for batch in range(2):
        store.persist(spark.createDataFrame([("e", T, "m", "aggregate", 1, batch)], FACT), batch)
    before = rows(store.read(), *tiers.COLUMNS)
    store.compact_levels()
    for name in ("_SUCCESS", "._SUCCESS.crc"):
        os.remove(tmp_path / "t" / "batch=l1-0-1" / name)
    assert [f.level for f in store.live()] == [0, 0] and rows(store.read(), *tiers.COLUMNS) == before
    store.compact_levels()
    assert [f.level for f in store.live()] == [1] and rows(store.read(), *tiers.COLUMNS) == before


def test_a_read_of_few_entities_opens_the_files_that_can_hold_them(spark, tmp_path):
    store = tiers.Store(spark, f"file://{tmp_path}/a b/t", (Period.DAILY, Period.YEARLY))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for batch in range(2):
            store.persist(spark.createDataFrame([(f"e{i:03d}", T, "m", "aggregate", i, i) for i in range(200)], FACT), batch)
        store.compact()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    one = store.read(["e123"])
    assert rows(one, "period", "value") == [("daily", 246), ("yearly", 246)]
    assert len(one.inputFiles()) < len(store.read().inputFiles())
    assert store.read(["zzz"]).count() == 0 and store.read([]).count() == 0
    store.persist(spark.createDataFrame([("zzz", T, "m", "aggregate", 7, 900)], FACT), 2)
    assert rows(store.read(["zzz"]), "period", "value") == [("daily", 7), ("yearly", 7)]
