"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, fsum

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grams import Counts, fit_logistic, word_grams, words
from .shared import filter_texts, map_texts, stage

#: Labelled rows that are fitted on at most; the rows of least id hash are taken.
MAX_ROWS = 12_000
LEAST, MOST, BUCKETS = 3, 6, 1 << 19
#: n-grams kept for the linear model, by their log-likelihood ratio, and rows they must occur in.
FEATURES, MIN_ROWS = 4096, 3
#: Words whose sums of weights a task remembers before it forgets all.
KNOWN_WORDS = 100_000
THRESHOLD = 0.3


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def _counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams, and how often its distinct words have each."""
    found = list(set(words(text)))
    return np.unique(word_grams(found, LEAST, MOST, BUCKETS)[1], return_counts=True)


def _present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = {0: np.zeros(BUCKETS, np.int64), 1: np.zeros(BUCKETS, np.int64)}
    for b in batches:
        for text, y in zip(b["text"], b["label"], strict=True):
            rows[int(y)][_counts(text)[0]] += 1
    some = np.flatnonzero(rows[0] + rows[1])
    yield pd.DataFrame({"bucket": some, "clean": rows[0][some], "toxic": rows[1][some]})


def _features(buckets: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = np.full(BUCKETS, -1, np.int32)
        place[buckets] = np.arange(len(buckets))
        for b in batches:
            cols, vals = [], []
            for text in b["text"]:
                got, n = _counts(text)
                known = place[got] >= 0
                cols.append(place[got[known]].astype(np.uint16).tobytes())
                vals.append(n[known].astype(np.uint16).tobytes())
            yield pd.DataFrame({"label": b["label"], "cols": cols, "vals": vals})

    return run


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", max_rows: int = MAX_ROWS) -> tuple[dict[int, float], float]:
    """Bucket -> weight, and the bias, learnt from labels (id, label 0/1) over docs (id, text).

    At most max_rows labelled rows are used, those whose ids hash least. Rows with a null label or
    id teach nothing. Without labels, or with one class only, every score is the share of ones.
    """
    chosen = labels.where("id is not null and label in (0, 1)").select("id", F.col("label").cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "label").limit(max_rows)
    # max_rows bounds what is broadcast.
    sample = stage(docs.join(F.broadcast(chosen), "id").select("label", F.col(text_col).alias("text")), "labelled")
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    zero, one = sizes.get(0, 0), sizes.get(1, 0)
    if not zero or not one:
        return {}, 30.0 if one else -30.0
    seen = (
        sample.mapInPandas(_present, "bucket bigint, clean bigint, toxic bigint")
        .groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where(F.col("clean") + F.col("toxic") >= MIN_ROWS).toPandas()
    )
    p, q = seen["toxic"].to_numpy(float), seen["clean"].to_numpy(float)
    ratio = np.log((p + 0.5) / (one + 1)) - np.log((q + 0.5) / (zero + 1))

    def term(k, n, t):
        return k * np.log(np.maximum(k, 1e-9) / np.maximum(n * t, 1e-9))

    t = (p + q) / (one + zero)
    gain = term(p, one, t) + term(q, zero, t) + term(one - p, one, 1 - t) + term(zero - q, zero, 1 - t)
    best = np.lexsort((seen["bucket"].to_numpy(), -gain))[:FEATURES]
    buckets, ratio = seen["bucket"].to_numpy()[best], ratio[best].astype(np.float32)
    rows = sample.mapInPandas(_features(buckets), "label int, cols binary, vals binary").toArrow()
    # The driver keeps what it fits on, in three arrays, and not also what it came in.
    x, y = Counts(rows["cols"], rows["vals"], len(buckets)), rows["label"].to_numpy().copy()
    del rows, seen
    pa.default_memory_pool().release_unused()
    w, b = fit_logistic(x, y, l2=1e-4, rounds=40, rate=0.01, scale=ratio)
    return {int(g): float(k) for g, k in zip(buckets, w[:, 0] * ratio, strict=True) if k}, float(b[0])


def _score(weights: dict[int, float], bias: float):
    def start():
        table, known = np.zeros(BUCKETS), {}
        table[list(weights)] = list(weights.values())

        def make(texts: list) -> list[float]:
            found = [set(words(t)) for t in texts]
            new = list(set().union(*found).difference(known))
            if new:
                if len(known) > KNOWN_WORDS:
                    known.clear()
                    new = list(set().union(*found))
                who, where = word_grams(new, LEAST, MOST, BUCKETS)
                known.update(zip(new, np.bincount(who, table[where], len(new)).tolist(), strict=True))
            z = [bias + fsum(map(known.__getitem__, w)) for w in found]
            return [1 / (1 + exp(-min(max(x, -30.0), 30.0))) for x in z]

        return make

    return start


def toxicity(docs: DataFrame, model: tuple[dict[int, float], float], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: id, score in [0, 1], predicted (score >= threshold).

    The whole text is scored: the weights of the character n-grams of its distinct words are
    summed. A null or empty text, or one without letters, gets the score of the bias alone.
    Repeated rows are scored alike; other columns of docs are not read.
    """
    def start():
        score = _score(*model)()
        return lambda texts: {"score": score(texts)}

    out = map_texts(docs.select(id_col, F.col(text_col).alias("_tox_text")), "_tox_text", start, {"score": "double"})
    return out.select(id_col, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: tuple[dict[int, float], float], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below threshold, with all their columns and in one pass."""

    def start():
        score = _score(*model)()
        return lambda texts: [s < threshold for s in score(texts)]

    return filter_texts(docs, text_col, start)


def train_folds(docs: DataFrame, labels: DataFrame) -> tuple[dict[int, float], float]:
    """The model of the documents table: labels.toxic of the rows whose fold of 4 is not 2."""
    known = labels.where(fold("doc_id", 4) != 2).select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    return fit(docs.select(F.col("doc_id").alias("id"), "text"), known)
