from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import periods as per
from tidemark.functions.identifiers import parse_value
from tidemark.functions.periods import Period
from tidemark.operators import combine, facts, tiers, verbs
from tidemark.sources import messages, records
from tidemark.streaming.ingest import buffered

FACT = "entity_id string, ts timestamp_ntz, name string, record_type string, value bigint, arrival_seq bigint"
BAG = "name string, record_type string, value bigint"
T = datetime(2020, 5, 3, 10, 16)


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_merge_of_bags(spark):
    a = spark.createDataFrame([("fluffies", "aggregate", 1), ("bunnies", "aggregate", 2), ("monkeys", "absolute", 999)], BAG)
    b = spark.createDataFrame([("fluffies", "aggregate", 1), ("dinkies", "aggregate", 3), ("monkeys", "absolute", 888)], BAG)
    assert rows(combine.merge(a, b), "name", "value") == [("bunnies", 2), ("dinkies", 3), ("fluffies", 2), ("monkeys", 888)]
    assert len(rows(combine.difference(a, b), "name", "value")) == 4
    assert rows(combine.intersection(a, b), "name", "value") == [("fluffies", 1)]


def test_mixed_types_are_an_error(spark):
    a = spark.createDataFrame([("x", "aggregate", 1)], BAG)
    b = spark.createDataFrame([("x", "absolute", 1)], BAG)
    with pytest.raises(Exception, match="different record types"):
        combine.merge(a, b).collect()


def test_sums_widen_and_nulls_count_as_nothing(spark):
    big = 2**63 - 1
    df = spark.createDataFrame([("a", "aggregate", big, 1), ("a", "aggregate", 1, 2), ("b", "aggregate", None, 1), ("c", "absolute", 5, 1), ("c", "absolute", None, 2)], BAG + ", o int")
    assert rows(combine.summarize(df, [], F.col("o")), "name", "value") == [("a", big + 1), ("b", 0), ("c", 5)]


def test_combine_without_a_match_is_zero(spark):
    a = spark.createDataFrame([("abc", "aggregate", 1)], BAG)
    assert rows(combine.combine_matching(a, "b"), "name", "record_type", "value") == [("result", "aggregate", 0)]
    assert rows(combine.combine_matching(a, "a.*"), "value") == [(1,)]


def test_last_value_is_by_arrival_within_a_bucket(spark):
    f = spark.createDataFrame([("e", datetime(2020, 5, 3, 10, 20), "m", "absolute", 1, 1), ("e", datetime(2020, 5, 3, 10, 16), "m", "absolute", 2, 2)], FACT)
    built = tiers.build(f)
    assert {r.value for r in built.collect()} == {2} and built.count() == 5


def test_reserved_and_empty_names(spark):
    f = spark.createDataFrame([("__e__", T, "m", "aggregate", 1, 1), ("e", T, "", "aggregate", 1, 2), ("e", T, "m", "aggregate", None, 3)], FACT)
    assert facts.accepted(f, "drop").count() == 0
    with pytest.raises(Exception, match="reserved"):
        facts.accepted(f).collect()


def test_store_replays_and_late_data(spark, tmp_path):
    store = tiers.Store(spark, f"file://{tmp_path}/t")
    now = spark.createDataFrame([("e", T, "m", "aggregate", 3, 1)], FACT)
    late = spark.createDataFrame([("e", datetime(2019, 1, 1), "m", "aggregate", 4, 2)], FACT)
    for batch, df in ((0, now), (1, late), (1, late)):
        store.persist(df, batch)
    assert rows(store.read().where("period = 'yearly'"), "value") == [(3,), (4,)]
    assert rows(store.compact(f"file://{tmp_path}/u").read(), *tiers.COLUMNS) == rows(store.read(), *tiers.COLUMNS)


def test_series_is_dense_and_range_takes_its_last_bucket(spark):
    f = spark.createDataFrame([("e", datetime(1970, 1, 1), "m", "aggregate", 7, 1)], FACT)
    built = tiers.build(f)
    got = verbs.series(built, ["e"], Period.MONTHLY, datetime(1969, 12, 1), datetime(1970, 2, 2))
    assert rows(got, "bucket_start", "value") == [(datetime(1969, 12, 1), None), (datetime(1970, 1, 1), 7), (datetime(1970, 2, 1), None)]
    assert verbs.series(built, ["e"], Period.MONTHLY, datetime(1970, 1, 1), datetime(1970, 1, 1)).count() == 0
    assert rows(verbs.range_(built, "e", datetime(1969, 1, 1), datetime(1970, 1, 1)), "value") == [(7,)]


def test_requests_that_cannot_be_answered():
    with pytest.raises(verbs.BadRequest, match="Parameter period required."):
        verbs.required("period", None)
    with pytest.raises(verbs.BadRequest, match="Unable to parse date crud"):
        verbs.parse_instant("crud")
    with pytest.raises(verbs.BadRequest, match="Unable to parse period : No period named crud"):
        verbs.parse_period("crud")
    assert verbs.parse_instant("2010-01-01 08:00:00:007") == datetime(2010, 1, 1, 8, 0, 0, 7000)


RECORD = b"\xff1577836800000\xfee-\xc3\xa9\xfem\xfe12\xfeABSOLUTE\xfe"


@pytest.mark.parametrize("cut", range(1, len(RECORD)))
def test_a_cut_record_file_fails_as_a_whole(spark, cut):
    df = spark.createDataFrame([("f", RECORD + RECORD[:cut])], "path string, content binary")
    got = records.decode(df).collect()
    assert len(got) == 1 and got[0].error


def test_record_files(spark):
    bad_type = RECORD.replace(b"ABSOLUTE", b"OTHER")
    null = RECORD.replace(b"12", b"null").replace(b"ABSOLUTE", b"aggregate")
    df = spark.createDataFrame([("a", RECORD + null), ("b", RECORD + bad_type), ("c", b""), ("d", b"junk")], "path string, content binary")
    got = rows(records.decode(df), "path", "error", "entity_id", "value", "record_type")
    said = "Error decoding metric records"
    assert got == [
        ("a", None, "e-é", 12, "absolute"), ("a", None, "e-é", None, "aggregate"), ("b", said, None, None, None), ("d", said, None, None, None),
    ]


def test_value_texts(spark):
    df = spark.createDataFrame([("12",), ("-2.9",), ("null",), ("NULL",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(parse_value(F.col("s"))).collect()] == [12, -2, None, None, None, None]


def test_messages_round_trip(spark):
    f = spark.createDataFrame([("e", T, "m", "aggregate", 2**62, 1), ("e", T, "n", "absolute", -5, 1)], FACT)
    cols = ["entity_id", "ts", "name", "record_type", "value"]
    assert rows(messages.from_json(messages.to_json(f)), *cols) == rows(f, *cols)
    assert rows(messages.from_protobuf(messages.to_protobuf(f)), *cols) == rows(f, *cols)
    upper = spark.createDataFrame([('{"entityId":"e","timestamp":0,"metrics":{"m":{"value":1,"type":"AGGREGATE"}}}',), ("{",)], "value string")
    assert rows(messages.from_json(upper), *cols) == [("e", per.EPOCH, "m", "aggregate", 1)]


def test_dump_rows_of_another_width_are_an_error(spark, tmp_path):
    (tmp_path / "d.csv").write_text('"e","0","m","aggregate"\n')
    with pytest.raises(Exception):
        messages.read_dump(spark, f"file://{tmp_path}/d.csv").collect()
    assert messages.escape_character("\x01\x02b") == "\x03"


def test_slices_straddle_quarters(spark):
    f = spark.createDataFrame([("e", datetime(2020, 1, 1, 0, 15, 30), "m", "aggregate", 1, 1), ("e", datetime(2020, 1, 1, 0, 14, 5), "m", "aggregate", 1, 2)], FACT)
    assert rows(buffered(f), "ts", "value") == [(datetime(2020, 1, 1, 0, 14), 2)]


def test_protobuf_holds_few_messages_as_objects(spark, monkeypatch):
    bags = pd.DataFrame({"entity_id": "e", "ms": range(3000), "metrics": [f'[{{"name":"m","record_type":"aggregate","value":"{v}"}}]' for v in range(3000)]})
    made = []

    class OneBatch:
        """Stands for a DataFrame: runs what it is mapped with on one large batch."""

        def __init__(self, batch):
            self.batch = batch

        def mapInPandas(self, run, schema):
            made.append(list(run(iter([self.batch]))))
            return spark.createDataFrame([], schema)

    monkeypatch.setattr(messages, "_bags", lambda facts: OneBatch(bags))
    messages.to_protobuf(None)
    messages.from_protobuf(OneBatch(pd.concat(made[0], ignore_index=True)))
    assert all(max(map(len, out)) <= 1000 for out in made)
    assert [int(v) for b in made[1] for v in b["value"]] == list(range(3000))
