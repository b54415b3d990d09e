"""Nearest neighbours by blocks of queries."""

import numpy as np

from tidemark.llm import ann


def test_blocks_bound_the_queries_of_a_group(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(400, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    index, asked = ann.build(df), df.where("vec_id % 10 = 0")
    whole = sorted(map(tuple, ann.search(index, asked, k=5).collect()))
    seen, block_of = [], ann.block_of

    def spy(query, blocks):
        seen.append(blocks)
        return block_of(query, blocks)

    monkeypatch.setattr(ann, "block_of", spy)
    assert sorted(map(tuple, ann.search(index, asked, k=5, block=10).collect())) == whole
    assert len(whole) == 200 and seen == [4]
    sizes = asked.groupBy(block_of("vec_id", 4)).count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 20
