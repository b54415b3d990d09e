"""Messages: JSON and protobuf forms of one write, chunks of large ones, and dump files."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.periods import from_millis, millis

MOST_METRICS = 150
#: Messages, or metrics of messages, that a task holds as Python objects at once.
AT_ONCE = 1000
JSON_SCHEMA = "entityId string, timestamp bigint, metrics map<string, struct<value: decimal(38,6), type: string>>"
DUMP_SCHEMA = "entity_id string, timestamp bigint, name string, record_type string, value decimal(38,0)"


def to_json(facts: DataFrame) -> DataFrame:
    """value: one JSON message for each (entity, ts), with the metrics of one bag; names must be
    distinct within it. Bags are as large as one write is."""
    entry = F.struct("name", F.struct("value", F.col("record_type").alias("type")))
    bags = facts.groupBy("entity_id", "ts").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("metrics"))
    message = F.struct(F.col("entity_id").alias("entityId"), millis(F.col("ts")).alias("timestamp"), "metrics")
    return bags.select(F.to_json(message).alias("value"))


def _parsed(messages: DataFrame) -> DataFrame:
    """value, m, good: each message with what it parses to and whether it is whole."""
    m = F.from_json("value", f"{JSON_SCHEMA}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = messages.select("value", m.alias("m"))
    kinds = F.transform(F.map_values("m.metrics"), lambda v: F.coalesce(F.lower(v["type"]).isin("aggregate", "absolute"), F.lit(False)))
    good = F.col("m._bad").isNull() & F.col("m.entityId").isNotNull() & F.col("m.timestamp").isNotNull()
    good = good & F.col("m.metrics").isNotNull() & F.forall(kinds, lambda k: k)
    return rows.withColumn("good", F.coalesce(good, F.lit(False)))


def from_json(messages: DataFrame) -> DataFrame:
    """entity_id, ts, name, record_type, value of each metric of each whole message; types in any case,
    fractions cut (1.7 is 1). Messages that are not whole are those of `rejected`."""
    rows = _parsed(messages).where("good").select("m.entityId", "m.timestamp", F.explode("m.metrics").alias("name", "v"))
    return rows.select(
        F.col("entityId").alias("entity_id"), from_millis(F.col("timestamp")).alias("ts"), "name",
        F.lower("v.type").alias("record_type"), F.col("v.value").try_cast("bigint").alias("value"),
    )


def rejected(messages: DataFrame) -> DataFrame:
    """value, error of the messages that do not parse, lack an entity, a time or metrics, or have a metric
    of an unknown type: what a consumer asks for again or sets aside."""
    return _parsed(messages).where(~F.col("good")).select("value", F.lit("Error parsing a metrics message").alias("error"))


def bag_json(bag: DataFrame) -> DataFrame:
    """A bag as the JSON object that a client gets: name -> value and lower-case type."""
    entry = F.struct("name", F.struct("value", F.lower("record_type").alias("type")))
    return bag.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("body"))


def chunks(facts: DataFrame, most: int = MOST_METRICS) -> DataFrame:
    """facts with `chunk`, from 1: the part of its (entity, ts) message that a metric goes in."""
    n = F.row_number().over(Window.partitionBy("entity_id", "ts").orderBy("name", "record_type", "arrival_seq"))
    return facts.withColumn("chunk", F.ceil(n / most).cast("int"))


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Dump files: five columns without header. A row of another width is an error."""
    return spark.read.schema(DUMP_SCHEMA).csv(path, header=False, mode="FAILFAST", quote='"', escape='"')


def write_dump(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, quoteAll=True, quote='"', escape='"')


def escape_character(text: str) -> str:
    """The first character by code point that does not occur in text."""
    return next(chr(c) for c in range(1, 0x110000) if chr(c) not in text)


@lru_cache(maxsize=1)
def _protobuf() -> dict:
    """The message classes by name, from the published schema."""
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    # The fields of each message as (name, number, type, label, type name), and its enum.
    # Types: 1 double, 3 int64, 5 int32, 9 string, 11 message, 12 bytes, 14 enum.
    optional, needed, many = 1, 2, 3
    layout = {
        "BigInteger": [("value", 1, 12, needed, "")],
        "BigDecimal": [("scale", 1, 5, needed, ""), ("value", 2, 11, needed, "BigInteger")],
        "Number": [
            ("type", 1, 14, needed, "Number.Type"), ("int_value", 2, 5, optional, ""), ("double_value", 3, 1, optional, ""),
            ("long_value", 4, 3, optional, ""), ("big_decimal_value", 5, 11, optional, "BigDecimal"),
        ],
        "Metric": [("type", 1, 14, needed, "Metric.Type"), ("name", 2, 9, needed, ""), ("value", 3, 11, needed, "Number")],
        "Message": [
            ("entity_id", 1, 9, needed, ""), ("version", 2, 14, needed, "Message.Version"), ("timestamp", 3, 3, needed, ""),
            ("metrics", 4, 11, many, "Metric"),
        ],
        "Messages": [("messages", 1, 11, many, "Message")],
        "Bag": [("metrics", 1, 11, many, "Metric"), ("timestamp", 2, 3, optional, "")],
        "Series": [("series", 1, 11, many, "Bag")],
    }
    enums = {
        "Number": ("Type", {"INT": 1, "DOUBLE": 2, "LONG": 3, "BIG_DECIMAL": 4}), "Metric": ("Type", {"AGGREGATE": 0, "ABSOLUTE": 1}),
        "Message": ("Version", {"V1_0": 0}),
    }
    f = descriptor_pb2.FileDescriptorProto(name="metrics.proto", package="metrics", syntax="proto2")
    for name, fields in layout.items():
        m = f.message_type.add(name=name)
        if name in enums:
            kind, values = enums[name]
            e = m.enum_type.add(name=kind)
            for value, number in values.items():
                e.value.add(name=value, number=number)
        for field, number, kind, label, of in fields:
            m.field.add(name=field, number=number, type=kind, label=label, type_name=f".metrics.{of}" if of else None)
    pool = descriptor_pool.DescriptorPool()
    pool.Add(f)
    return {name: message_factory.GetMessageClass(pool.FindMessageTypeByName(f"metrics.{name}")) for name in layout}


def _add_metrics(message, metrics: list[dict]) -> None:
    """The metrics of a bag in a message: whole numbers of 64 bits as LONG, larger ones as BIG_DECIMAL."""
    for x in metrics:
        p, v = message.metrics.add(name=x["name"], type=x["record_type"].upper()), int(x["value"])
        if -(2**63) <= v < 2**63:
            p.value.type, p.value.long_value = 3, v
        else:
            p.value.type, p.value.big_decimal_value.scale = 4, 0
            p.value.big_decimal_value.value.value = v.to_bytes(v.bit_length() // 8 + 1, "big", signed=True)


def _number(v) -> int:
    """A number of any kind, cut toward zero."""
    if v.type == 4:
        unscaled, scale = int.from_bytes(v.big_decimal_value.value.value, "big", signed=True), v.big_decimal_value.scale
        whole = abs(unscaled) // 10**scale if scale >= 0 else abs(unscaled) * 10**-scale
        return whole if unscaled >= 0 else -whole
    return int({1: v.int_value, 2: v.double_value, 3: v.long_value}[v.type])


def _metrics(message) -> list[tuple[str, str, int]]:
    return [(x.name, ("aggregate", "absolute")[x.type], _number(x.value)) for x in message.metrics]


def _bags(facts: DataFrame) -> DataFrame:
    """entity_id, ms, metrics: the bag of each (entity, ts), as JSON in name order."""
    entry = F.struct("name", "record_type", F.col("value").cast("string").alias("value"))
    bags = facts.where("value is not null").groupBy("entity_id", "ts").agg(F.array_sort(F.collect_list(entry)).alias("metrics"))
    return bags.select("entity_id", millis(F.col("ts")).alias("ms"), F.to_json("metrics").alias("metrics"))


def _pieces(batches):
    """Few rows of a batch at a time: as messages they take many times the room that they have in it."""
    for b in batches:
        for i in range(0, len(b), AT_ONCE):
            yield b.iloc[i : i + AT_ONCE]


def to_protobuf(facts: DataFrame, batch: int | None = None) -> DataFrame:
    """content: one protobuf message for each (entity, ts), or with `batch` one batch message for up to
    that many of them. Null values are left out."""
    import pandas as pd

    def run(batches):
        made = []
        for b in _pieces(batches):
            for entity, ms, metrics in zip(b["entity_id"], b["ms"], b["metrics"], strict=True):
                made.append(_protobuf()["Message"](entity_id=entity, version=0, timestamp=int(ms)))
                _add_metrics(made[-1], json.loads(metrics))
            each = [m.SerializeToString() for m in made] if batch is None else []
            while batch and len(made) >= batch:
                each.append(_protobuf()["Messages"](messages=made[:batch]).SerializeToString())
                made = made[batch:]
            made = made if batch else []
            yield pd.DataFrame({"content": each})
        if made:
            yield pd.DataFrame({"content": [_protobuf()["Messages"](messages=made).SerializeToString()]})

    return _bags(facts).mapInPandas(run, "content binary")


def from_protobuf(messages: DataFrame, batch: bool = False) -> DataFrame:
    """entity_id, ts, name, record_type, value of each metric of each message (of each batch message with
    `batch`); numbers of any kind are cut to whole ones, and null beyond 64 bits."""
    import pandas as pd

    def run(batches):
        columns, waiting = ["entity_id", "ms", "name", "record_type", "value"], []
        for content in (c for b in batches for c in b["content"]):
            m = _protobuf()["Messages" if batch else "Message"]()
            m.ParseFromString(bytes(content))
            waiting += [(one.entity_id, one.timestamp, n, t, str(v)) for one in (m.messages if batch else [m]) for n, t, v in _metrics(one)]
            while len(waiting) >= AT_ONCE:
                yield pd.DataFrame(waiting[:AT_ONCE], columns=columns)
                del waiting[:AT_ONCE]
        if waiting:
            yield pd.DataFrame(waiting, columns=columns)

    rows = messages.mapInPandas(run, "entity_id string, ms bigint, name string, record_type string, value string")
    return rows.select("entity_id", from_millis(F.col("ms")).alias("ts"), "name", "record_type", F.col("value").try_cast("bigint").alias("value"))


def bag_protobuf(bag: DataFrame) -> DataFrame:
    """body: a bag as the protobuf message that a client gets. Null values are left out."""
    import pandas as pd

    entry = F.struct("name", "record_type", F.col("value").cast("string").alias("value"))
    one = bag.where("value is not null").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("metrics"))

    def run(batches):
        for b in batches:
            out = []
            for metrics in b["metrics"]:
                out.append(_protobuf()["Bag"]())
                _add_metrics(out[-1], json.loads(metrics))
            yield pd.DataFrame({"body": [m.SerializeToString() for m in out]})

    return one.mapInPandas(run, "body binary")


def bag_from_protobuf(bodies: DataFrame) -> DataFrame:
    """name, record_type, value of the metrics of each bag."""
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = []
            for body in b["body"]:
                m = _protobuf()["Bag"]()
                m.ParseFromString(bytes(body))
                rows += [(n, t, str(v)) for n, t, v in _metrics(m)]
            yield pd.DataFrame(rows, columns=["name", "record_type", "value"])

    rows = bodies.mapInPandas(run, "name string, record_type string, value string")
    return rows.select("name", "record_type", F.col("value").cast("decimal(38,0)").alias("value"))


@dataclass(frozen=True)
class Form:
    """A form of messages: what writes facts as messages, reads them back, and renders a bag."""

    write: Callable[[DataFrame], DataFrame]
    read: Callable[[DataFrame], DataFrame]
    bag: Callable[[DataFrame], DataFrame]


FORMS = {"json": Form(to_json, from_json, bag_json), "protobuf": Form(to_protobuf, from_protobuf, bag_protobuf)}


def form(name: str) -> Form:
    """The form of a name as a setting has it, in any case. One that there is not is an error."""
    try:
        return FORMS[name.strip().lower()]
    except KeyError:
        raise ValueError(f"no form of messages named {name}; there are {', '.join(sorted(FORMS))}") from None
