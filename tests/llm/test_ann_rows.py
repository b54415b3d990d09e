"""Neighbours are found whatever the rows' spread: against brute force."""

import numpy as np
import pytest

from tidemark.llm import ann


@pytest.mark.parametrize("kind", ["heavy", "offset"])
def test_recall_on_rows_of_any_spread(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 32))
    x = x * np.exp(2.5 * rng.normal(size=(6000, 1))) if kind == "heavy" else x * 1e-3 + 1e5
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>").repartition(4)
    found = {}
    for r in ann.search(ann.build(df), df.where("vec_id % 100 = 0")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for i, got in found.items():
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        assert len(got) == 10
        hits += len(got & set(np.argsort(d)[:10].tolist()))
    assert len(found) == 60 and hits >= 0.95 * 600, hits
