"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, exact_dedup, html_text, language, line_dedup, mixing, near_dedup, token_file, toxicity
from tidemark.llm.queries import tokenizer

LONG = "word and other words, " * 9000
#: Column names that operators use inside, as extra columns of the input.
DOCS = "doc_id bigint, text string, lang string, source string, n bigint, id bigint, name string, score double, ids string, set_key string, part int"
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta.\nshared line", "en", "a"),
    (1, "Alpha beta gamma delta epsilon zeta.\nshared line", "en", "a"),
    (2, "", "en", "b"), (3, None, None, None), (2**60, "ALPHA beta gamma delta epsilon zeta.\nshared line", None, "c"),
    (5, LONG, "de", "d"), (6, "12 34 !?", "fr", ""), (None, "no id here\nshared line", "en", "e"), (7, "shared line", "en", "f"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, 2, "n", 0.5, "i", "s", 3) for r in ROWS], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_exact(docs, none):
    out = got(exact_dedup.exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept")
    assert len(out) == len(ROWS)
    assert (1, 2**60, 3, False) in out and (2**60, 2**60, 3, True) in out and (2, 3, 2, False) in out and (3, 3, 2, True) in out
    assert (None, None, 1, True) in out
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_with_clashing_chunk_names(docs):
    cols = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got(exact_dedup.exact_dedup(docs, bits=4), *cols) == got(exact_dedup.exact_dedup(docs), *cols)


def test_near(docs, none):
    out = got(near_dedup.near_dedup(docs), "doc_id", "n_shingles", "component_id", "kept")
    assert len(out) == len(ROWS)
    assert out.count((1, 4, 1, True)) == 2 and (2**60, 4, 1, False) in out
    assert (2, 0, 2, True) in out and (3, 0, 3, True) in out and (None, 1, None, True) in out
    assert near_dedup.near_dedup(none).count() == 0


def test_lines(docs, none):
    cleaned = line_dedup.line_dedup(docs)
    assert cleaned.columns == [*docs.columns, "n_lines", "n_removed"]
    out = {(r.doc_id, r.text): (r.n_lines, r.n_removed) for r in cleaned.collect()}
    assert out[1, "Alpha beta gamma delta epsilon zeta.\nshared line"] == (2, 0)
    assert out[2**60, "ALPHA beta gamma delta epsilon zeta."] == (2, 1) and out[7, ""] == (1, 1) and out[None, "no id here"] == (2, 1)
    assert out[3, None] == (0, 0) and out[2, ""] == (1, 0) and out[5, LONG] == (1, 0)
    assert line_dedup.line_dedup(none).count() == 0


def test_mix(docs, none):
    out = mixing.mix(docs)
    rows = out.collect()
    assert len(rows) == len(ROWS)
    total = sum(r.size for r in rows)
    targets = {r.source: (r.source_size, r.target) for r in rows}
    assert abs(sum(t for _, t in targets.values()) - total) < 1e-6 and all(t <= 3 * s + 1e-9 for s, t in targets.values())
    assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 3 for r in rows)
    assert got(mixing.mix(docs), "doc_id", "taken") == got(out, "doc_id", "taken")
    assert mixing.emit(out).count() == sum(r.copies for r in rows)
    assert mixing.mix(none).count() == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 0), (None, 1), (6, None)], "id bigint, label int")
    known = docs.select(F.col("doc_id").alias("id"), "text")
    out = toxicity.toxicity(docs, toxicity.fit(known, labels))
    assert out.count() == len(ROWS) and all(0 <= r.score <= 1 for r in out.collect())
    assert toxicity.toxicity(none, toxicity.fit(known, labels)).count() == 0
    no_labels = toxicity.toxicity(docs, toxicity.fit(known, labels.where("false")))
    assert {r.predicted for r in no_labels.collect()} == {0}
    assert toxicity.keep_clean(docs, toxicity.fit(known, labels.where("false"))).count() == len(ROWS)


def test_language(docs, none):
    known = docs.select(F.col("doc_id").alias("id"), "text", "lang")
    model = language.fit(known)
    out = {r.doc_id: r for r in language.language(docs, model).collect()}
    assert out[3].lang_pred == out[2].lang_pred == out[6].lang_pred == "und" and out[5].lang_pred == "de"
    assert language.language(none, model).count() == 0
    assert {r.lang_pred for r in language.language(docs, language.fit(known.where("false"))).collect()} == {"und"}


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p>a  b<p>c &amp; d</p>"), (3, "u", "<p>a  b<p>c &amp; d</p>")], "page_id bigint, url string, html string")
    assert got(html_text.extract(pages), "page_id", "text", "n_chars") == [(1, "", 0), (2, "", 0), (3, "a b\nc & d", 9), (3, "a b\nc & d", 9)]
    assert html_text.extract(pages.where("false")).count() == 0


def test_bpe(docs, none):
    spec = tokenizer("word_bpe_49k.json")
    out = bpe.encode_decode(docs, spec, keep=("n", "ids"), digests=True)
    rows = {r.doc_id: r for r in out.collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert len(out.collect()) == len(ROWS) and rows[3].n_tokens == rows[2].n_tokens == 0 and rows[3].ids_sha256 == rows[2].decoded_sha256 == empty
    assert bpe.encode_decode(none, spec).count() == 0


def test_token_file(spark, docs, none, tmp_path):
    spec = tokenizer("byte_bpe_50k.json")
    rows = token_file.round_trip(docs, spec).orderBy("start").collect()
    assert len(rows) == len(ROWS) and [r.doc_id for r in rows] == [None, 1, 1, 2, 3, 5, 6, 7, 2**60]
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert token_file.round_trip(none, spec).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, None), (7, [1.0, None]), (8, []), (9, [0.0, 1.0]), (9, [0.0, 2.0]), (None, [1.0, 1.0]), (10, [1.0])]
    df = spark.createDataFrame(v, "vec_id bigint, embedding array<float>")
    out = ann.search(ann.build(df), df.where("vec_id in (0, 3, 6, 10)"), k=10)
    assert got(out, "query_id", "rank", "vec_id", "score") == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 9, 2**0.5)]
    assert ann.search(ann.build(df.where("false")), df).count() == 0
