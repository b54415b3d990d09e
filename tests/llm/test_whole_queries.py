"""The queries without SQL against brute force over every row, and their accuracy on held-out rows."""

import hashlib
from math import exp
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import grams, language, toxicity
from tidemark.llm.queries import QUERIES, tokenizer

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def texts(sf: str = SF) -> dict[int, str]:
    return {i: t or "" for i, t in duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()}


def library(name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(tokenizer(name))


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_every_text_is_encoded_and_decoded_as_the_library_does(spark):
    tok, want = library("word_bpe_49k.json"), set()
    for i, t in texts().items():
        ids = tok.encode(t, add_special_tokens=False).ids
        want.add((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tok.decode(ids, skip_special_tokens=False).encode())))
    rows = QUERIES["op3_bpe"](spark, SF).collect()
    assert len(rows) == len(want) and {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == want


def test_every_id_comes_back_from_the_token_file(spark):
    tok, want, start = library("byte_bpe_50k.json"), set(), 0
    for i, t in sorted(texts().items()):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        want.add((i, start, len(ids), crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    rows = QUERIES["op9_token_file"](spark, SF).collect()
    assert len(rows) == len(want) and {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows} == want


def bucket(gram: str, buckets: int) -> int:
    h = 0
    for c in gram:
        h = (h * 2654435761 + ord(c)) % 2**32
    h = ((h ^ (h >> 15)) * 2246822519) % 2**32
    return h >> (33 - buckets.bit_length())


def test_every_toxicity_score_is_the_sum_over_its_distinct_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    weights, bias = toxicity.train_folds(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scored = {r.doc_id: r.score for r in toxicity.toxicity(docs, (weights, bias)).collect()}
    assert weights
    for i, t in texts().items():
        z = bias
        for w in set(grams.words(t)):
            w = f"<{w}>"
            z += sum(weights.get(bucket(w[a : a + n], toxicity.BUCKETS), 0) for n in range(3, 7) for a in range(len(w) - n + 1))
        assert scored[i] == pytest.approx(1 / (1 + exp(-min(max(z, -30), 30))), abs=1e-9)


def test_every_language_is_that_of_the_least_loss(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs.where(toxicity.fold("doc_id", 5) != 0).select(F.col("doc_id").alias("id"), "text", "lang"))
    found = {r.doc_id: r.lang_pred for r in language.language(docs, model).collect()}
    for i, t in texts().items():
        x = np.zeros(language.BUCKETS)
        low = "".join(c if c.isalpha() else " " for c in t.lower()).split()
        for w in low:
            w = f"\x01{w}\x01"
            for n in (1, 2, 3):
                for a in range(len(w) - n + 1):
                    if w[a : a + n].strip("\x01"):
                        x[bucket(w[a : a + n], language.BUCKETS)] += 1
        margin = x @ model.w / max(x.sum(), 1) + model.b
        loss = np.logaddexp(0, -model.code * margin).sum(1)
        assert found[i] == (model.languages[int(loss.argmin())] if low else "und")


def test_held_out_rows_alone(spark):
    rows = duckdb.sql(f"select doc_id, lang, toxic from '{LARGER}/documents.parquet' left join '{LARGER}/labels.parquet' using (doc_id)").fetchall()
    lang, toxic = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}
    got = [r for r in QUERIES["op6_language"](spark, LARGER).collect() if crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if lang[r.doc_id]]) > 0.98
    got = [r for r in QUERIES["op5_toxicity"](spark, LARGER).collect() if crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(r.held_out for r in got)
    clean, bad = ([r.predicted for r in got if toxic[r.doc_id] == y] for y in (0, 1))
    assert np.mean(clean) < 0.05 and np.mean(bad) >= 0.4 and np.mean(bad) > 8 * np.mean(clean)


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    docs = spark.createDataFrame([(i, "some text", f"l{i}") for i in range(3)], "id bigint, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        language.fit(docs)


def test_a_count_above_255_is_learnt_as_it_is_scored():
    got, n = toxicity._counts(" ".join("abc" + "".join(chr(97 + int(c)) for c in str(i)) for i in range(400)))
    assert n[got.tolist().index(bucket("<ab", toxicity.BUCKETS))] == 400


def test_every_document_finds_its_near_copies(spark):
    import re

    sets = {}
    for i, t in texts(LARGER).items():
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    holds: dict[tuple, list[int]] = {}
    for i, s in sets.items():
        for shingle in s:
            holds.setdefault(shingle, []).append(i)
    common: dict[tuple[int, int], int] = {}
    for ids in holds.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                common[a, b] = common.get((a, b), 0) + 1
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    want = {(i, len(s), find(i), find(i) == i) for i, s in sets.items()}
    rows = QUERIES["op1_near_dedup"](spark, LARGER).collect()
    assert len(rows) == len(want) and {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows} == want
    assert sum(not r.kept for r in rows) > 20
