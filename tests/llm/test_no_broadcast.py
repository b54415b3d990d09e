"""A vocabulary's joins shuffle both sides, however small Spark takes them for."""

from tidemark.llm import anagram


def test_variants_are_joined_by_shuffle(spark):
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").removesuffix("b")) > 0
    counts = spark.createDataFrame([("hello", 9), ("hellp", 4), ("hell", 1), ("world", 3)], "word string, n bigint")
    words = counts.withColumn("key", anagram.key_of(counts.word))
    got = anagram.group_variants(counts)
    for df in (anagram.near_pairs(words), got):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {(r.word, r.form, r.root, r.n_near) for r in got.collect()} == {
        ("hello", None, "hello", 2), ("hellp", "hello", "hello", 2), ("hell", "hello", "hello", 2), ("world", None, "world", 0)
    }
