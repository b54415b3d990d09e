"""Tiers: facts pre-aggregated by period, and the store that keeps them as Parquet.

A tier row is period, record_type, entity_id, bucket_start, name, value, last_seq.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import DEFAULT_TIERS, Period, bucket_start, least_granular, lit_ts, most_granular
from .combine import last, total
from .facts import AGGREGATE, accepted

COLUMNS = ["period", "record_type", "entity_id", "bucket_start", "name", "value", "last_seq"]
#: What tells the series of a metric from others: its buckets are folded by task where rows are dealt by ranges of this.
SERIES = ["record_type", "entity_id", "name"]
SCHEMA = "entity_id string, bucket_start timestamp_ntz, name string, value bigint, last_seq bigint, period string, record_type string"


def _fold(rows: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Sums and last values by key. Sums add up over levels; last values carry their place. The columns come in an
    order that all uses keep, so that Spark sees that the tiers of one build share an exchange."""
    out = rows.groupBy(*keys).agg(total().alias("_sum"), last(F.col(seq)).alias("_last"), F.max(seq).alias("last_seq"))
    value = F.when(F.col("record_type") == AGGREGATE, F.col("_sum")).otherwise(F.col("_last"))
    return out.select(*keys, value.alias("value"), "last_seq")


def build(facts: DataFrame, tiers: Sequence[Period] = DEFAULT_TIERS, ranged: bool = False) -> DataFrame:
    """All tiers of facts. The finest is aggregated from the facts and the others from it, so the
    facts are shuffled once, after partial aggregation; what the second shuffle moves has been reduced.

    ranged: the second shuffle moves the finest tier by ranges of SERIES, before the others are made of it. So a task has all buckets of
    its metrics, as many as its time has at most, and the tiers come in ranges of entities without a shuffle of them all."""
    finest = most_granular(tiers)
    key = ["record_type", "entity_id", "bucket_start", "name"]
    base = accepted(facts).select(
        "record_type", "entity_id", bucket_start(F.col("ts"), finest).alias("bucket_start"), "name", "value", "arrival_seq"
    )
    base = _fold(base, key, "arrival_seq")
    base = base.repartitionByRange(*SERIES) if ranged else base
    rest = [t for t in tiers if t is not finest and t is not Period.REALTIME]
    fine = base.withColumn("period", F.lit(str(finest)))
    if not rest:
        return fine.select(*COLUMNS)
    if ranged:
        # A tier is its own tasks, which read the one exchange, so that none of them holds the keys of several.
        up = [_fold(base.withColumn("bucket_start", bucket_start(F.col("bucket_start"), t)), key, "last_seq").withColumn("period", F.lit(str(t))) for t in rest]
        return reduce(DataFrame.unionByName, [t.select(*COLUMNS) for t in (fine, *up)])
    each = F.explode(F.array(*[F.struct(F.lit(str(t)).alias("period"), bucket_start(F.col("bucket_start"), t).alias("b")) for t in rest]))
    up = base.select("*", each.alias("t")).select(
        F.col("t.period").alias("period"), "record_type", "entity_id", F.col("t.b").alias("bucket_start"), "name", "value", "last_seq"
    )
    return fine.select(*COLUMNS).unionByName(_fold(up, ["period", *key], "last_seq").select(*COLUMNS))


@dataclass(frozen=True)
class Folder:
    """A whole folder of a store: the batches that it holds, and how often its rows were merged."""

    first: int
    last: int
    level: int
    path: str

    def holds(self, other: Folder) -> bool:
        return self.level > other.level and self.first <= other.first and other.last <= self.last


#: The names of folders: one batch, the batches A to B at a level, all up to a number.
_NAME = re.compile(r"batch=(?:(?P<one>\d+)|l(?P<level>\d+)-(?P<first>\d+)-(?P<last>\d+)|to-(?P<upto>\d+))")
#: The level of a folder of all batches: above any other's, so that the latest of them counts.
WHOLE = 1000
#: How many folders of a level are merged into one of the next.
FAN = 4
INDEX = "_entities"


class Store:
    """Tier rows under a path, partitioned by period and record type. Writes are batches: a batch
    that is written again replaces itself, and reads merge batches, so replays change nothing.

    Folders' names are the manifest. `batch=N` is one batch, `batch=lL-A-B` the batches A to B at level L, and `batch=to-N`
    all up to N. A merged folder is written beside what it holds and counts only once it is whole (Spark's _SUCCESS
    file), from when on what it holds is left out; so a compaction that is cut off changes nothing. Batches are
    numbered in ascending order by one writer, and one process compacts at a time.

    Merged folders carry an index of the entities that each file spans, by which a read of few entities opens those files only.
    """

    def __init__(self, spark: SparkSession, path: str, tiers: Sequence[Period] = DEFAULT_TIERS, fan: int = FAN):
        self.spark, self.path, self.tiers, self.fan = spark, path.rstrip("/"), tuple(tiers), fan
        self._indexes: dict[tuple[str, int], list] = {}

    def _write(self, rows: DataFrame, name: str) -> None:
        """Write rows that are dealt by ranges of entities, so that a file holds few entities of one tier and a filter on one skips
        most of the rest."""
        rows = rows.sortWithinPartitions("period", "record_type", "entity_id", "bucket_start")
        rows.write.mode("overwrite").partitionBy("period", "record_type").parquet(f"{self.path}/{name}")

    def persist(self, facts: DataFrame, batch: int = 0, index: bool = False) -> None:
        """Write the tiers of facts as a batch, with an index if asked for. One that a compaction holds already is left
        as it is: it was whole before."""
        if not any(f.level and f.first <= batch <= f.last for f in self.folders()):
            self._write(build(facts, self.tiers, ranged=True), f"batch={batch}")
            if index:
                self._index(f"{self.path}/batch={batch}")

    def _fs(self):
        jvm = self.spark._jvm.org.apache.hadoop.fs
        root = jvm.Path(self.path)
        return jvm, root, root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def folders(self) -> list[Folder]:
        """The whole folders, those included that others hold."""
        jvm, root, fs = self._fs()
        found = []
        for status in fs.listStatus(root) if fs.exists(root) else []:
            m, path = _NAME.fullmatch(status.getPath().getName()), f"{self.path}/{status.getPath().getName()}"
            if not m or not fs.exists(jvm.Path(f"{path}/_SUCCESS")):
                continue
            n = {k: int(v) for k, v in m.groupdict().items() if v is not None}
            if "one" in n:
                found.append(Folder(n["one"], n["one"], 0, path))
            elif "upto" in n:
                found.append(Folder(-1, n["upto"], WHOLE + n["upto"], path))
            else:
                found.append(Folder(n["first"], n["last"], n["level"], path))
        return found

    def live(self) -> list[Folder]:
        """The folders that reads merge, in order of their batches: those that no other holds."""
        found = self.folders()
        return sorted((f for f in found if not any(g.holds(f) for g in found)), key=lambda f: f.first)

    def _rows(self, folders: Sequence[Folder], entities: Sequence[str] | None = None, ranged: bool = False) -> DataFrame:
        """The merged rows of folders. ranged: dealt by ranges of the tiers' entities, by the one shuffle that the merge takes."""
        paths = [p for f in folders for p in self._paths(f, entities)]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA).select(*COLUMNS)
        rows = self.spark.read.schema(SCHEMA).option("basePath", self.path).parquet(*paths).select(*COLUMNS)
        rows = rows if entities is None else rows.where(F.col("entity_id").isin(*entities))
        key = ["period", "record_type", "entity_id", "bucket_start", "name"]
        if ranged:
            rows = rows.repartitionByRange("period", *SERIES)
        elif len(folders) > 1:
            # A folder has a key once, so merging within the tasks of the scan would keep all their rows in memory and reduce few.
            rows = rows.repartition(*key)
        return rows if len(folders) == 1 else _fold(rows, key, "last_seq").select(*COLUMNS)

    def read(self, entities: Sequence[str] | None = None) -> DataFrame:
        """The merged tiers. A filter on period, record_type, entity or bucket reaches the scan; a store of
        one folder is read without merging. With entities, only their rows, from files that may hold them."""
        return self._rows(self.live(), entities)

    def next_seq(self, before: int) -> int:
        """A place in the order of arrival above all that the batches before a number hold. Read from the coarsest
        tier, as every tier carries the places of what it sums up."""
        earlier = [f for f in self.live() if f.last < before]
        coarsest = F.col("period") == str(least_granular(self.tiers))
        last_seq = self._rows(earlier).where(coarsest).agg(F.max("last_seq")).first()[0] if earlier else None
        return 0 if last_seq is None else last_seq + 1

    def compact(self, path: str | None = None) -> Store:
        """Merge the batches so far into one folder, and remove those that an earlier compaction holds.
        With a path, leave them and write a copy of the store there, with one batch."""
        if path:
            copy = Store(self.spark, path, self.tiers, self.fan)
            copy._write(self._rows(self.live(), ranged=True), "batch=0")
            return copy
        live, held = self.live(), self._held()
        if live and live[-1].level < WHOLE:
            self._merge(live, f"batch=to-{live[-1].last}")
            self._drop(held)
        return self

    def compact_levels(self) -> Store:
        """Merge whatever level has `fan` folders into one of the next level, and so on upwards.

        A row is written once for each level, of which there are log(batches) to the base `fan`, and no more than
        fan - 1 folders of each are left: neither grows with the store's size as rewriting all of it would.
        """
        held = self._held()
        while True:
            runs = [(level, list(run)) for level, run in groupby(self.live(), lambda f: f.level)]
            full = [run for level, run in runs if level < WHOLE and len(run) >= self.fan]
            if not full:
                self._drop(held)
                return self
            run = full[-1][: self.fan]
            self._merge(run, f"batch=l{run[0].level + 1}-{run[0].first}-{run[-1].last}")

    def _held(self) -> list[Folder]:
        """The folders that others hold by now. Those that a compaction comes to hold stay until the next one, for
        readers that have started on them."""
        found = self.folders()
        return [f for f in found if any(g.holds(f) for g in found)]

    def _drop(self, folders: Sequence[Folder]) -> None:
        jvm, _, fs = self._fs()
        for f in folders:
            fs.delete(jvm.Path(f.path), True)

    def _merge(self, folders: Sequence[Folder], name: str) -> None:
        self._write(self._rows(folders, ranged=True), name)
        self._index(f"{self.path}/{name}")

    def _spans(self, path: str) -> DataFrame:
        """file, least, most, rows: the entities that each file of a folder spans, files by their place in it. Rows are counted by a file's
        entities first, by hash: the least and the most of texts take a sort, and only one row an entity of a file is left for it."""
        rows = self.spark.read.option("basePath", self.path).parquet(path)
        each = rows.groupBy(F.col("_metadata.file_path").alias("at"), "entity_id").agg(F.count("*").alias("n"))
        spans = each.groupBy("at").agg(F.min("entity_id").alias("least"), F.max("entity_id").alias("most"), F.sum("n").alias("rows"))
        return spans.select(F.array_join(F.slice(F.split("at", "/"), -3, 3), "/").alias("file"), "least", "most", "rows")

    def _index(self, path: str) -> None:
        """Write the spans of a folder's files."""
        self._spans(path).coalesce(1).write.mode("overwrite").parquet(f"{path}/{INDEX}")

    def _paths(self, folder: Folder, entities: Sequence[str] | None) -> list[str]:
        """The files of a folder that may hold some of the entities; the folder itself where all are asked for or it has no index
        (most batches, and merges that were cut off before it). The driver keeps a row of the index for each file."""
        jvm, _, fs = self._fs()
        at = f"{folder.path}/{INDEX}"
        if entities is None or not fs.exists(jvm.Path(f"{at}/_SUCCESS")):
            return [folder.path]
        written = fs.getFileStatus(jvm.Path(f"{at}/_SUCCESS")).getModificationTime()
        if (folder.path, written) not in self._indexes:
            self._indexes[folder.path, written] = self.spark.read.schema("file string, least string, most string").parquet(at).collect()
        # Spark and Python both compare texts by code point.
        spans = [r for r in self._indexes[folder.path, written] if r.least is not None]
        return [f"{folder.path}/{r.file}" for r in spans if any(r.least <= e <= r.most for e in entities)]


def fetch(tiers: DataFrame, entity: str, period: Period, bucket: datetime) -> DataFrame:
    """The rows of one bucket: absolute and aggregate."""
    return tiers.where((F.col("period") == str(period)) & (F.col("entity_id") == entity) & (F.col("bucket_start") == lit_ts(bucket)))


def family(tiers: DataFrame, record_type: str, entity: str, period: Period, bucket: datetime) -> DataFrame:
    return fetch(tiers, entity, period, bucket).where(F.col("record_type") == record_type)


def within(intervals: Sequence[tuple[Period, datetime, datetime]]) -> Column:
    """Buckets of each period that start in [start, end]; one filter for a whole plan."""
    out = F.lit(False)
    for p, start, end in intervals:
        out = out | ((F.col("period") == str(p)) & (F.col("bucket_start") >= lit_ts(start)) & (F.col("bucket_start") <= lit_ts(end)))
    return out


def entity_keys(tiers: DataFrame, period: Period) -> DataFrame:
    """The distinct entities of a period's tables of both record types."""
    return tiers.where(F.col("period") == str(period)).select("entity_id").distinct()
