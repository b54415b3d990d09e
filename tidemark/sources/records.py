"""Metric record files: `0xff timestamp 0xfe entity 0xfe name 0xfe value 0xfe type 0xfe` per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.identifiers import is_value, parse_value
from ..functions.periods import SLICE_MS, from_millis, millis, slice_floor
from ..operators.tiers import Store
from .files import BROKEN, COMPLETED
from .files import ready as found_ready

PER_FILE = 20_000


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


#: What a file's records are once decoded.
RECORD = "error string, pos int, entity_id string, ts timestamp_ntz, name string, record_type string, value bigint"
BAD_FILE = "Error decoding metric records"


def decode(content: DataFrame) -> DataFrame:
    """path, error, and the facts of each file (in file order by `pos`).

    A file is good as a whole or not at all: each record must have its start byte, five ended fields,
    a whole-number timestamp, a finite 64-bit number or `null` as value and a known type, and nothing may follow
    the last. A bad file gives one row with an error and no fact. Null values are kept as null.

    Bytes are read as Latin-1, in which the two marker bytes are one character each, so the split
    is a regular expression in the engine; text fields are decoded as UTF-8 afterwards. A file is split
    and judged as one array before its records become rows, so no record carries its file along.
    """
    text = F.decode("content", "ISO-8859-1")
    whole = F.length(F.regexp_replace(text, "ÿ[0-9-]+þ[^þ]*þ[^þ]*þ[^þ]*þ[^þ]*þ", "")) == 0
    split = F.split(F.regexp_replace(text, "þ\\z", ""), "þ?ÿ", -1)
    fields = F.transform(F.slice(split, 2, F.greatest(F.size(split) - 1, F.lit(0))), lambda r: F.split(r, "þ", -1))

    def bad(f: Column) -> Column:
        return f[0].try_cast("bigint").isNull() | ~F.lower(f[4]).isin("aggregate", "absolute") | ~is_value(f[3])

    def utf8(c: Column) -> Column:
        return F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")

    def fact(f: Column, i: Column) -> Column:
        return F.struct(
            F.lit(None).cast("string").alias("error"), (i + 1).alias("pos"), utf8(f[1]).alias("entity_id"),
            from_millis(f[0].try_cast("bigint")).alias("ts"), utf8(f[2]).alias("name"), F.lower(f[4]).alias("record_type"),
            parse_value(f[3]).alias("value"),
        )

    none = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in RECORD.split(", ")[1:]]
    wrong = F.array(F.struct(F.lit(BAD_FILE).alias("error"), *none))
    rows = content.select("path", whole.alias("whole"), fields.alias("fields"))
    read = F.when(F.col("whole") & ~F.exists("fields", bad), F.transform("fields", fact)).otherwise(wrong)
    return rows.select("path", F.inline(read))


def encode(facts: DataFrame) -> DataFrame:
    """content: each fact as one record, bytes."""

    def raw(c: Column) -> Column:
        return F.encode(c, "UTF-8")

    ms, end = millis(F.col("ts")).cast("string"), F.unhex(F.lit("FE"))
    value = F.coalesce(F.col("value").cast("string"), F.lit("null"))
    fields = [raw(ms), raw(F.col("entity_id")), raw(F.col("name")), raw(value), raw(F.upper("record_type"))]
    return facts.select("*", F.concat(F.unhex(F.lit("FF")), *[x for f in fields for x in (f, end)]).alias("content"))


def in_files(facts: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """file, content: facts gathered in order of arrival into files of at most per_file records."""
    order = Window.partitionBy(F.spark_partition_id()).orderBy("arrival_seq")
    numbered = encode(facts).withColumn("part", F.spark_partition_id()).withColumn("n", F.row_number().over(order))
    number = F.floor((F.col("n") - 1) / per_file)
    each = numbered.groupBy("part", number.alias("file")).agg(F.array_sort(F.collect_list(F.struct("n", F.hex("content").alias("h")))).alias("r"))
    return each.select(F.concat_ws("-", F.lpad(F.col("part").cast("string"), 6, "0"), F.lpad(F.col("file").cast("string"), 6, "0")).alias("file"), F.unhex(F.array_join("r.h", "")).alias("content"))


def _store(path: str):
    """The file system of a path that executors reach, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def write(facts: DataFrame, folder: str, per_file: int = PER_FILE) -> None:
    """Write facts as record files of at most per_file records below a folder.

    A file grows as `.lock` and is renamed to `.data.completed` when it is whole, so that readers see whole
    files only. Names follow from partition and number: a task that runs again replaces its files.
    """

    def put(batches):
        store, at = _store(folder)
        store.create_dir(at, recursive=True)
        for b in batches:
            for name, content in zip(b["file"], b["content"], strict=True):
                with store.open_output_stream(f"{at}/{name}.lock") as out:
                    out.write(content)
                store.move(f"{at}/{name}.lock", f"{at}/{name}.data.completed")
            yield b[["file"]]

    in_files(facts, per_file).mapInPandas(put, "file string").write.format("noop").mode("overwrite").save()


def in_order(records: DataFrame, files: DataFrame, work: str, base: int) -> DataFrame:
    """records (path, pos, ...) with arrival_seq, from base on: by their file's place in files, then by theirs in it.

    files has path and whatever comes before it in the order of files, by all its columns from the left. Files are ranged by these and numbered
    within their range; a prefix sum over the ranges' counts, one row each, makes the numbers run on. Every file takes as
    many places as the longest, so that the numbers of records follow from those of files.
    """
    order = [c for c in files.columns if c != "path"] + ["path"]
    ranged = files.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    ranged.write.mode("overwrite").parquet(f"{work}/order")
    placed = files.sparkSession.read.parquet(f"{work}/order").select("path", F.shiftright("id", 33).alias("part"), (F.col("id").bitwiseAND(2**33 - 1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy("part").agg(F.count("*").alias("files")).select("part", F.coalesce(F.sum("files").over(before), F.lit(0)).alias("first"))
    span = (records.agg(F.max("pos")).first()[0] or 0) + 1
    number = placed.join(first, "part").select("path", (F.lit(base) + (F.col("first") + F.col("n")) * span).alias("start"))
    return records.join(number, "path").withColumn("arrival_seq", F.col("start") + F.col("pos")).drop("start")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def rotate(batch: DataFrame, number: int, folder: str, width: int = SLICE_MS, per_file: int = PER_FILE, parts: int = 8) -> None:
    """Write a micro-batch of facts as record files below a folder: a file holds records of one slice of time, per_file at most.

    A file is named by its slice, batch and number and stays `.data` while its slice may still grow. Once a batch brings a later slice,
    the files of all earlier ones are completed; what comes late for a slice is completed with the batch it came in. Which file a
    record goes to follows from the record, so that a replayed batch replaces its files, and those that were completed before stay.
    """
    part = F.pmod(F.xxhash64("arrival_seq", "entity_id", "name", "record_type"), F.lit(parts))
    slices = encode(batch).select(millis(slice_floor(F.col("ts"), width)).alias("slice"), part.alias("part"), "arrival_seq", "content")
    order = Window.partitionBy("slice", "part").orderBy("arrival_seq", "content")
    numbered = slices.withColumn("n", F.row_number().over(order)).withColumn("file", F.floor((F.col("n") - 1) / per_file))
    each = numbered.groupBy("slice", "part", "file").agg(F.array_sort(F.collect_list(F.struct("n", F.hex("content").alias("h")))).alias("r"))
    # Names sort by slice (from before 1970 too), so the last is of the latest.
    name = F.concat_ws("-", F.lpad((F.col("slice") + 2**52).cast("string"), 17, "0"), F.lpad(F.lit(str(number)), 9, "0"), F.col("part").cast("string"), F.col("file").cast("string"))
    made = each.select(name.alias("file"), F.unhex(F.array_join("r.h", "")).alias("content"))

    def put(batches):
        store, at = _store(folder)
        store.create_dir(at, recursive=True)
        for b in batches:
            for file, content in zip(b["file"], b["content"], strict=True):
                if not store.get_file_info(f"{at}/{file}.data{COMPLETED}").is_file:
                    with store.open_output_stream(f"{at}/{file}.lock") as out:
                        out.write(content)
                    store.move(f"{at}/{file}.lock", f"{at}/{file}.data")
            yield b[["file"]]

    made.mapInPandas(put, "file string").write.format("noop").mode("overwrite").save()
    complete(folder)


def complete(folder: str, all_: bool = False) -> None:
    """Rename the `.data` files of every slice but the latest that the folder has to completed ones; with all_ of that too, as at a stream's end."""
    from pyarrow import fs

    store, at = _store(folder)
    names = sorted(i.base_name for i in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if i.is_file and ".data" in i.base_name)
    latest = names[-1].split("-")[0] if names else ""
    for name in names:
        if name.endswith(".data") and (all_ or name.split("-")[0] < latest):
            store.move(f"{at}/{name}", f"{at}/{name}{COMPLETED}")


def run(spark: SparkSession, folder: str, store: Store, work: str, batch: int) -> DataFrame:
    """One run over a folder: path, error, records of every file that was ready (files.ready).

    The facts of good files are stored as one batch; good files are then removed
    and bad ones renamed to `.broken`, whatever becomes of the others. Records arrive in order of their files' names, those of
    all folders together (ties by path), and after everything that the store's earlier batches hold, so that the
    last value is the newer run's. What was read is staged below
    `work` first, and files go only once the batch is stored: a run that was cut off is run again with
    the same batch number and replaces what it wrote. Spark's reader lists no empty files; they stay.
    """
    found = files(spark, folder)
    ready = found_ready(found.select("path")).select("path")
    read = decode(found.join(ready, "path", "left_semi"))
    at = f"{work.rstrip('/')}/run-{batch}"
    read.write.mode("overwrite").parquet(f"{at}/read")
    ready.write.mode("overwrite").parquet(f"{at}/ready")
    read, ready = spark.read.parquet(f"{at}/read"), spark.read.parquet(f"{at}/ready")
    named = ready.select(file_name(F.col("path")).alias("name"), "path")
    store.persist(in_order(read.where("error is null"), named, at, store.next_seq(batch)), batch)
    done = read.groupBy("path").agg(F.max("error").alias("error"), F.count("entity_id").alias("records"))
    done = ready.join(done, "path", "left").select("path", "error", F.coalesce("records", F.lit(0)).alias("records"))

    def settle(batches):
        for b in batches:
            for path, error in zip(b["path"], b["error"], strict=True):
                files_, name = _store(_uri(path))
                if files_.get_file_info(name).is_file:
                    files_.delete_file(name) if error is None else files_.move(name, name + BROKEN)
            yield b

    done.mapInPandas(settle, done.schema).write.mode("overwrite").parquet(f"{at}/done")
    return spark.read.parquet(f"{at}/done")


def _uri(path: str) -> str:
    """A path as Spark's reader names it (file:/a) as a URI."""
    head, _, rest = path.partition(":/")
    return f"{head}:///{rest.lstrip('/')}" if head == "file" else path


def stream(spark: SparkSession, folder: str, archive: str | None = None, **options: str | int) -> DataFrame:
    """The record files of a folder as a stream of path, modificationTime and content: completed files that come later are later batches.
    With archive, files that a finished batch has read are moved there. `options` are those of Spark's file source."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    read = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").options(**options)
    if archive:
        read = read.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return read.option("pathGlobFilter", f"*{COMPLETED}").load(folder).select("path", "modificationTime", "content")


def to_facts(content: DataFrame) -> DataFrame:
    """The facts of a micro-batch of record files, bad files left out. Records arrive in order of their
    file's modification and then of their place; of two files of one millisecond either may be the later.
    `poll` orders all files and keeps the errors."""
    when = content.select("path", F.unix_millis("modificationTime").alias("ms"))
    seq = F.shiftleft(F.col("ms"), 20) + F.col("pos")
    return decode(content).where("error is null").join(when, "path").withColumn("arrival_seq", seq).drop("ms")


def poll(content: DataFrame, store: Store, rejects: str, work: str, checkpoint: str, every: str | None = "10 seconds", by_name: bool = False) -> StreamingQuery:
    """Start reading a stream of record files (`stream`) into a store, and its bad files into a table of rejects.

    A micro-batch is decoded once and staged below `work`; the facts of its good files become a batch of the store and the bad files'
    path and error rows of `rejects` under the same number, so a batch that is replayed after a failure replaces both. Records arrive after all earlier
    batches', in order of their files' modification, name and path; with by_name in order of name and path alone, for writers that write files side
    by side and number them in their order (`write`), of which any may be done first. Good and bad files alike are archived where the
    stream says so. Without `every` the stream reads what is there and ends.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, at = batch.sparkSession, f"{work.rstrip('/')}/{number}"
        batch.select("path", "modificationTime").write.mode("overwrite").parquet(f"{at}/files")
        decode(batch).write.mode("overwrite").parquet(f"{at}/read")
        read = spark.read.parquet(f"{at}/read")
        files_ = spark.read.parquet(f"{at}/files").select(*([] if by_name else ["modificationTime"]), file_name(F.col("path")).alias("name"), "path")
        store.persist(in_order(read.where("error is null"), files_, at, store.next_seq(number)), number)
        read.where("error is not null").select("path", "error").write.mode("overwrite").parquet(f"{rejects.rstrip('/')}/batch={number}")

    out = content.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()
