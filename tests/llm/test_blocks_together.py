"""Near-dedup's pairs of blocks, many of them in one frame, and the filter of keys before a join."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.llm import near_dedup
from tidemark.llm.shared import likely_in

COLUMNS = ["bucket", "node", "n", "sig", "one", "two", "right", "component", "left"]


def blocks(groups: int, seed: int = 1) -> pd.DataFrame:
    """Pairs of blocks of 2 to 6 members, whose signatures share the bucket's band and some of the rest."""
    r, rows = np.random.default_rng(seed), []
    for g in range(groups):
        base = r.integers(0, 2**32, near_dedup.HASHES, dtype=np.uint32)
        for _ in range(int(r.integers(2, 7))):
            sig = np.where(r.random(near_dedup.HASHES) < r.choice((0.0, 0.2, 0.6)), r.integers(0, 2**32, near_dedup.HASHES, dtype=np.uint32), base)
            band = g % 32 * near_dedup.ROWS
            sig[band : band + near_dedup.ROWS] = base[band : band + near_dedup.ROWS]
            left = int(r.integers(-1, 2))
            rows.append((g // 2, r.bytes(16), int(r.integers(80, 130)), sig.astype(np.uint32).tobytes(), g % 2, g % 2, g % 2, bytes([int(r.integers(3))]), left))
    return pd.DataFrame(rows, columns=COLUMNS)


def test_blocks_compared_together_give_what_each_gives_alone():
    limits, rows = near_dedup.least_matches(0.75), blocks(400)
    work = near_dedup._doubtful((75, 100), limits)
    alone = pd.concat([work(b) for _, b in rows.groupby(["bucket", "one", "two"])])
    calls = []
    batches = [rows.iloc[i : i + 97] for i in range(0, len(rows), 97)]
    together = pd.concat(near_dedup._by_blocks(lambda b: calls.append(len(b)) or work(b))(iter(batches)))
    assert sum(calls) == len(rows) and 0 < len(alone) < len(rows)
    assert together.values.tolist() == alone.values.tolist()
    # Not a call a block: that costs more than its comparisons.
    assert len(calls) < 10


def test_a_filter_of_keys_loses_no_row_and_passes_few_others(spark):
    rows = spark.range(50_000).select(F.struct("id", F.lit("x").alias("x")).alias("key"), F.lit("long").alias("text"))
    keys = rows.where("key.id % 50 = 7").select("key")
    got = [r.key.id for r in likely_in(rows, "key", keys).collect()]
    assert {i for i in range(50_000) if i % 50 == 7} <= set(got) and len(got) == len(set(got)) < 1200
    assert likely_in(rows, "key", keys.where("false")).count() == 0
