"""Language identification by error-correcting output codes over character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grams import fit_logistic, text_grams
from .shared import map_texts, stage

#: Rows that are fitted on, about, in all and for each language at most; those of least hash are taken.
MAX_ROWS, MAX_PER_LANGUAGE = 4000, 600
BUCKETS = 1 << 13
#: Different languages at most; texts whose n-grams are counted together; the fixed point of weights.
MOST_LANGUAGES, TEXTS, FIXED = 1000, 64, float(1 << 20)
UNKNOWN = "und"
#: Two languages nearer than this in mean loss per bit make a prediction ambiguous.
AMBIGUOUS = 0.05


def codewords(classes: int, seed: int = 11) -> np.ndarray:
    """(classes, bits) of -1 and 1: all two-way splits for up to five classes, else the best of
    many drawn codes by least distance between rows. No bit is constant."""
    if classes <= 5:
        splits = range(1, 2 ** (classes - 1)) if classes > 1 else [1]
        return np.array([[1 if (s >> c) & 1 else -1 for s in splits] for c in range(classes)], np.int8)
    bits, rng, best, far = ceil(10 * log2(classes)), np.random.default_rng(seed), None, (-1, -1.0)
    for _ in range(200):
        code = rng.integers(0, 2, (classes, bits), dtype=np.int8) * 2 - 1
        code[0] = np.where(np.abs(code.sum(0)) == classes, -code[0], code[0])
        apart = (bits - code.astype(np.int32) @ code.T.astype(np.int32)) // 2 + bits * np.eye(classes, dtype=np.int32)
        if (apart.min(), apart.mean()) > far:
            best, far = code, (apart.min(), apart.mean())
    return best


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        idx, val = [], []
        for i in range(0, len(b), TEXTS):
            for x in text_grams(b["text"].iloc[i : i + TEXTS].tolist(), BUCKETS):
                some = np.flatnonzero(x)
                idx.append(some.astype(np.uint16).tobytes())
                val.append((x[some] / max(x.sum(), 1)).astype(np.float32).tobytes())
        yield pd.DataFrame({"lang": b["lang"], "idx": idx, "val": val})


class Model:
    def __init__(self, languages: list[str], code: np.ndarray, w: np.ndarray, b: np.ndarray):
        self.languages, self.code, self.w, self.b = languages, code, w, b


def fit(docs: DataFrame, max_rows: int = MAX_ROWS, max_per_language: int = MAX_PER_LANGUAGE) -> Model:
    """The model learnt from docs (id, text, lang). Rows with a null lang or text teach nothing.

    Each language gives about max_per_language rows, or max_rows / languages if that is fewer: those
    whose id and text hash lowest, by a limit set from the language's count, so that no language's rows meet in
    a task. Twice as many rows as that are taken in all at most, however often rows repeat. More than
    MOST_LANGUAGES different values are an error.
    """
    known = docs.where("lang is not null and text is not null")
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = [r["lang"] for r in counts]
    if not languages:
        return Model([], np.zeros((0, 1), np.int8), np.zeros((BUCKETS, 1), np.float32), np.zeros(1, np.float32))
    each = max(1, min(max_per_language, max_rows // len(languages)))
    # MOST_LANGUAGES rows at most are broadcast.
    limits = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["n"])) for r in counts], "lang string, share double")
    spread = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = known.join(F.broadcast(limits), "lang").where(spread < F.col("share")).select("lang", "text")
    sample = stage(chosen.limit(2 * each * len(languages)), "languages")
    rows = sample.mapInPandas(_features, "lang string, idx binary, val binary").toPandas()
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (k, v) in enumerate(zip(rows["idx"], rows["val"], strict=True)):
        x[i, np.frombuffer(k, np.uint16)] = np.frombuffer(v, np.float32)
    code = codewords(len(languages))
    at = {lang: i for i, lang in enumerate(languages)}
    y = (code[[at[lang] for lang in rows["lang"]]] + 1) / 2
    # Rare grams count as much as common ones after scaling by their mean share.
    scale = (1 / np.sqrt(x.mean(0) + 1e-5)).astype(np.float32)
    w, b = fit_logistic(x, y, l2=1e-5, rounds=60, rate=0.05, scale=scale)
    return Model(languages, code, (w * scale[:, None]).astype(np.float32), b)


def _predict(model: Model):
    def start():
        names, code = [*model.languages, UNKNOWN], model.code.astype(float)
        # Whole numbers, so that a text's sums are exact wherever it stands among others.
        w = np.round(model.w.astype(float) * FIXED)

        def some(texts: list) -> tuple[list, list, list]:
            x = text_grams(texts, BUCKETS)
            n = x.sum(1)
            if not model.languages:
                return [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
            margin = (x.astype(float) @ w) / FIXED / np.maximum(n, 1)[:, None] + model.b
            # Loss-weighted decoding: the logistic loss of every bit against each codeword.
            loss = np.logaddexp(0, -code[None] * margin[:, None]).sum(2)
            best, least = loss.argmin(1), loss.min(1)
            score = 1 / np.exp(least[:, None] - loss).sum(1)
            rest = loss.copy()
            rest[np.arange(len(loss)), best] = np.inf
            doubt = (rest.min(1) - least) / code.shape[1] < AMBIGUOUS
            best[n == 0], score[n == 0], doubt[n == 0] = len(names) - 1, 0.0, True
            return [names[i] for i in best], score.tolist(), doubt.tolist()

        def make(texts: list) -> dict[str, list]:
            out: tuple[list, list, list] = ([], [], [])
            for i in range(0, len(texts), TEXTS):
                for all_, part in zip(out, some(texts[i : i + TEXTS]), strict=True):
                    all_.extend(part)
            return dict(zip(("lang_pred", "score", "ambiguous"), out, strict=True))

        return make

    return start


def language(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, lang_pred, score in [0, 1], ambiguous.

    Binary classifiers over a text's character n-grams predict the bits of the languages' codewords;
    the language of least total loss is chosen. `und` with score 0 for a text that is null or has no
    letter, and for all texts if no language was learnt. Whole texts are read; ties go to the first
    language by name; repeated rows are predicted alike; other columns are not read.
    """
    fields = {"lang_pred": "string", "score": "double", "ambiguous": "boolean"}
    return map_texts(docs.select(id_col, F.col(text_col).alias("_lid_text")), "_lid_text", _predict(model), fields)
