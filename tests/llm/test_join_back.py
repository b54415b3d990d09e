"""Totals of a key that holds most rows, met in parts."""

from pyspark.sql import functions as F

from tidemark.llm.graph import components
from tidemark.llm.shared import PARTS, dealt, each_part, join_back, part_of, part_of_row, parts_met


def test_totals_of_a_hot_key(spark):
    rows = spark.range(20_000, numPartitions=5).select("id", F.when(F.col("id") < 15_000, 0).when(F.col("id") < 19_990, F.col("id")).alias("key"))
    total = F.count("*").alias("n"), F.max("id").alias("last")
    got = {r.id: (r.key, r.n, r.last) for r in join_back(rows, ["key"], part_of("id"), *total).collect()}
    want = {i: (0, 15_000, 14_999) if i < 15_000 else (i, 1, i) for i in range(19_990)}
    assert got == want
    assert {r.id for r in join_back(rows, ["key"], part_of("id"), *total, where="n > 1").collect()} == set(range(15_000))
    assert join_back(rows.where("id < 0"), ["key"], part_of("id"), *total).count() == 0


def test_a_hot_key_is_dealt_evenly_and_a_rare_one_stays_one_row(spark):
    rows = spark.range(6400, numPartitions=4).select(F.least("id", F.lit(6300)).alias("rank"), F.lit("same").alias("text"))
    for part in (part_of("rank"), part_of_row()):
        counts = {r.part: r.n for r in rows.where("rank < 6300").groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
        assert set(counts) == set(range(PARTS)) and max(counts.values()) < 2 * 6300 / PARTS
    lone = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "key string, id bigint").withColumn("part", part_of("id"))
    keys = each_part(lone.groupBy("key").agg(parts_met("part").alias("met")), "met", "part")
    assert {(r.key, r.part) for r in keys.collect()} == {(r.key, r.part) for r in lone.collect()}


def test_a_table_is_dealt_to_the_parts_that_hold_its_keys(spark):
    rows = spark.range(9000).select("id", F.when(F.col("id") < 8000, 0).otherwise(F.col("id")).alias("key"), part_of("id").alias("part"))
    table = spark.range(8500).select(F.col("id").alias("key"), (F.col("id") * 2).alias("value"))
    out = dealt(table, rows, "key")
    assert {r.key: r.n for r in out.groupBy("key").agg(F.count("*").alias("n")).collect()} == {0: PARTS} | dict.fromkeys(range(8000, 8500), 1)
    got = {r.id: r.value for r in rows.join(out, ["key", "part"]).collect()}
    assert got == {i: 0 if i < 8000 else 2 * i for i in range(8500)}


def test_components_of_many_stars(spark):
    hubs = [(7, 100), (100, 9), (9, 5000)]
    edges = [(i % 3 * 1000 + 10, 20_000 + i) for i in range(3000)] + hubs + hubs
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {n: 7 for n in (7, 9, 100, 5000)} | {20_000 + i: i % 3 * 1000 + 10 for i in range(3000)} | {n: n for n in (10, 1010, 2010)}
    assert got == want
    assert components(spark.createDataFrame([(1, 1)], "a bigint, b bigint")).count() == 0


def test_components_run_few_tasks_where_partitions_are_many(spark):
    """Each of many partitions holds little: neither tables nor aggregations are made more often than a round needs them."""
    many = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in many}
    edges = spark.createDataFrame([(i % 7, 100 + i) for i in range(2000)], "a bigint, b bigint").localCheckpoint()
    for k, v in many.items():
        spark.conf.set(k, v)
    try:
        spark.sparkContext.setJobGroup("components", "components")
        assert components(edges).select("component").distinct().count() == 7
        track = spark.sparkContext.statusTracker()
        stages = {s for j in track.getJobIdsForGroup("components") for s in track.getJobInfo(j).stageIds}
        done = sum(i.numCompletedTasks for s in stages if (i := track.getStageInfo(s)))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert done < 1100
