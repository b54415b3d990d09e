"""What keeps the cost of a step in proportion to its input."""

import os
from datetime import datetime

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.operators import tiers
from tidemark.sources import records

SF = "/root/testdata/sf0.001"


@pytest.fixture
def store(spark):
    s = tiers.Store(spark, catalog.scratch(spark, "tiers"))
    s.persist(catalog.event_facts(spark, SF), index=True)
    return s


def test_index_sorts_entities_and_not_rows(spark, store):
    path = f"{store.path}/batch=0"
    spans = store._spans(path)
    plan = spans._jdf.queryExecution().sparkPlan().toString().split("\n")
    scan = next(i for i, line in enumerate(plan) if "FileScan" in line)
    lowest = next(line for line in reversed(plan[:scan]) if "Aggregate" in line)
    assert "HashAggregate" in lowest and "SortAggregate" not in lowest
    rows = spark.read.option("basePath", store.path).schema(tiers.SCHEMA).parquet(path)
    file = F.regexp_extract("_metadata.file_path", "[^/]+/[^/]+/[^/]+$", 0).alias("file")
    there = rows.groupBy(file).agg(F.min("entity_id"), F.max("entity_id"), F.count("*"))
    assert sorted(map(tuple, spans.collect())) == sorted(map(tuple, there.collect()))
    assert store.read(["user-7"]).count() == store.read().where("entity_id = 'user-7'").count() > 0


@pytest.mark.parametrize("by_name", [True, False])
def test_polled_files_by_name_whatever_was_done_first(spark, tmp_path, by_name):
    folder, at = tmp_path / "in", datetime(2024, 1, 1)
    schema = "entity_id string, ts timestamp_ntz, name string, record_type string, value bigint, arrival_seq bigint"
    made = [("e", at, "m", "absolute", v, v) for v in (1, 2)]
    for number in (1, 0):
        made_here = spark.createDataFrame([made[number]], schema).coalesce(1)
        records.write(made_here, f"{folder}/w{number}")
        (written,) = (folder / f"w{number}").glob("*.completed")
        written.rename(written.with_name(f"{number}.data.completed"))
        os.utime(folder / f"w{number}" / f"{number}.data.completed", (1_700_000_000 - number, 1_700_000_000 - number))
    s = tiers.Store(spark, str(tmp_path / "tiers"))
    records.poll(records.stream(spark, str(folder)), s, f"{tmp_path}/rejects", f"{tmp_path}/work", f"{tmp_path}/progress", every=None, by_name=by_name).awaitTermination()
    assert {r.value for r in s.read().collect()} == {2 if by_name else 1}


def test_a_part_is_a_batch_of_many_files(spark):
    e = catalog.events(spark, SF)
    parts = [e.where("event_id < 600"), e.where("event_id = 600"), e.where("event_id > 600")]
    stream, seen = catalog.incoming(spark, parts, file_rows=200), []

    def see(batch, number):
        ids = [r.event_id for r in batch.select("event_id").collect()]
        seen.append((min(ids), max(ids), len(ids), batch.rdd.getNumPartitions()))

    stream.writeStream.foreachBatch(see).option("checkpointLocation", catalog.scratch(spark, "seen")).trigger(availableNow=True).start().awaitTermination()
    assert seen == [(0, 599, 600, 3), (600, 600, 1, 3), (601, 999, 399, 3)]


def test_folders_are_merged_after_the_shuffle(spark):
    s, f = tiers.Store(spark, catalog.scratch(spark, "tiers")), catalog.event_facts(spark, SF)
    s.persist(f.where("arrival_seq % 2 = 0"), 0)
    s.persist(f.where("arrival_seq % 2 = 1"), 1)
    df = s.read().where("entity_id = 'user-7' and period = 'daily'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.rindex("HashAggregate") < plan.index("Exchange")
    assert "PushedFilters: [IsNotNull(entity_id), EqualTo(entity_id,user-7)]" in plan and "(period" in plan.split("PartitionFilters")[1]
    there = tiers.build(f).where("entity_id = 'user-7' and period = 'daily'").select(*tiers.COLUMNS)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, there.collect()))


def test_a_write_shuffles_no_tier_but_the_finest(spark, monkeypatch):
    plans, f = [], catalog.event_facts(spark, SF)
    parquet = DataFrameWriter.parquet

    def seen(self, path, *args, **kw):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return parquet(self, path, *args, **kw)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    s = tiers.Store(spark, catalog.scratch(spark, "tiers"))
    s.persist(f.where("arrival_seq % 2 = 0"), 0)
    s.persist(f.where("arrival_seq % 2 = 1"), 1)
    assert all(0 < p.index("Union") < p.index("Exchange") for p in plans)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        s.compact()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert plans[2].count("Exchange") == 1
    spans = s._spans(s.live()[0].path).collect()
    assert len(s.live()) == 1 and len(spans) > 10
    for tier in {r.file.rsplit("/", 1)[0] for r in spans}:
        ends = sorted((r.least, r.most) for r in spans if r.file.startswith(tier + "/"))
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    there = tiers.build(f).select(*tiers.COLUMNS)
    assert sorted(map(tuple, s.read().collect())) == sorted(map(tuple, there.collect()))
