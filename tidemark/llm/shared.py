"""What the operators of this package share: staging tables and text expressions."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the word contract names it: space and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where a session of one machine names none (a local run, tests), a temporary folder is made once
    and set for the session. On a cluster that is an error, as executors would not see it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Tasks a core that write a narrow table.
WRITERS = 4


def stage(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: the lineage ends there,
    so a lost executor costs a re-read, and the columns stay prunable.

    narrow: rows of keys and numbers. Several partitions of the last shuffle, one after the other, go into one task and
    file, so that a table with little in each of many partitions is not as many small files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df = df.coalesce(WRITERS * spark.sparkContext.defaultParallelism) if narrow else df
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows and bytes that Spark sends to a Python worker at once, at most.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 500, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def small_batches(spark: SparkSession) -> None:
    """Bound what a worker and its executor hold of long texts: lowers the session's limits of an
    Arrow batch, where they are higher."""
    for key, most in BATCH_LIMITS.items():
        now = int(spark.conf.get(key).removesuffix("b"))
        if now > most or now <= 0:
            spark.conf.set(key, str(most))


#: Parts over which the rows of one key are dealt in a join; a part is a bit of a long.
PARTS = 32


def part_of(*columns: str) -> Column:
    """The part of a row, by the hash of what tells the rows of a key apart."""
    return F.pmod(F.xxhash64(*columns), F.lit(PARTS)).cast("tinyint")


def part_of_row() -> Column:
    """The part of a row by its place, for tables that are staged with it: repeated rows are dealt too."""
    return F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("tinyint")


def parts_met(part: str) -> Column:
    """An aggregate: the parts that hold a row of the key, as bits."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(part).cast("int")))


def each_part(keys: DataFrame, met: str, part: str) -> DataFrame:
    """A key's one row for each part that holds rows of it, so most keys stay one row."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.getbit(met, i) == 1)
    return keys.withColumn(part, F.explode(bits.cast("array<tinyint>"))).drop(met)


def join_back(rows: DataFrame, on: list[str], part: Column, *totals: Column, where: str = "true") -> DataFrame:
    """rows with the totals of their key, of the keys for which `where` holds; rows of a null key go.

    The totals are combined within tasks first. The rows meet them by key and part, so no task of the
    join gets more than its share of a key's rows, however many there are.
    """
    rows = rows.withColumn("_part", part)
    keys = rows.groupBy(*on).agg(*totals, parts_met("_part").alias("_met")).where(where)
    return rows.join(each_part(keys, "_met", "_part"), [*on, "_part"]).drop("_part")


#: Bits of a filter of keys: 4 MB in all, in pieces of 4 KB.
FILTER_BITS = 1 << 25


def likely_in(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key is one of keys (the same column's name there), and a few others, before a join shuffles what is long.

    A key is a bit of a fixed number of them, by hash; the bits are made by an aggregation and broadcast. With more keys
    than bits most rows pass, so this bounds memory and never loses a row.
    """
    at = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    piece, bit = F.bitmap_bucket_number(at), F.bitmap_bit_position(at)
    bits = keys.groupBy(piece.alias("_piece")).agg(F.bitmap_construct_agg(bit).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    kept = rows.withColumn("_piece", piece).join(F.broadcast(bits), "_piece").where(F.getbit(byte, (bit % 8).cast("int")) == 1)
    return kept.select(*rows.columns)


def by_shuffle(table: DataFrame) -> DataFrame:
    """table, to be joined by a shuffle of both sides whatever size Spark takes it for: a vocabulary's Parquet is a fraction of
    what its words take once the driver has gathered and hashed them for a broadcast."""
    return table.hint("merge")


def dealt(table: DataFrame, rows: DataFrame, key: str, part: str = "part") -> DataFrame:
    """table, which has one row a key, with its row for each part of rows that holds the key.

    rows (staged, as this reads it once more) then joins by key and part, so that no task of the join
    gets more than its share of a key's rows.
    """
    met = rows.groupBy(key).agg(parts_met(part).alias("_met"))
    return each_part(table.join(met, key), "_met", part)


_ARROW = {
    "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
    "array<struct<start:bigint,length:bigint,period:bigint>>": pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])),
}


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that a task holds few texts as Python objects."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def map_texts(df: DataFrame, text: str, start: Callable[[], Callable[[list], dict[str, list]]], fields: dict[str, str]) -> DataFrame:
    """The columns of df but `text`, and those that a function makes of a batch's texts.

    start() is called in each task and gives the function, so that it can keep state. The other
    columns pass through as Arrow arrays, nulls and large integers included.
    """
    small_batches(df.sparkSession)
    kept = [f for f in df.schema if f.name != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{c}` {t}" for c, t in fields.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for b in _slices(batches):
            made = make(b.column(b.schema.get_field_index(text)).to_pylist())
            columns = [b.column(b.schema.get_field_index(f.name)) for f in kept]
            columns += [pa.array(made[c], _ARROW[t]) for c, t in fields.items()]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in kept), *fields])

    return df.mapInArrow(run, schema)


def filter_texts(df: DataFrame, text: str, start: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows of df, all columns, for whose text the function that start() gives is true."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = start()
        for b in _slices(batches):
            yield b.filter(pa.array(keep(b.column(b.schema.get_field_index(text)).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())
