"""Near-dedup in the pipeline keeps one row of each group; every stage takes odd rows and empty tables."""

from collections import Counter

import pytest

import corpus_pipeline

LONG = " ".join(f"word{i}" for i in range(200))
OTHER = " ".join(f"other{i}" for i in range(200))


def test_rows_without_or_with_repeated_ids(spark):
    texts = [
        (1, LONG), (1, LONG), (None, LONG), (None, LONG + " end"),  # near copies: one row of id 1 stays
        (None, OTHER), (None, OTHER), (None, OTHER + " end"),  # without an id: one row
        (2, None), (2, None), (None, None), (None, " "), (3, "short"), (3, "text"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted((g for g in got if g[1] is not None and g[1].strip() and g[1][:5] != "other"), key=str) == [(1, LONG), (3, "short"), (3, "text")]
    assert len([g for g in got if g[1] and g[1][:5] == "other"]) == 1
    assert sorted((g for g in got if not (g[1] or "").strip()), key=str) == [(2, None), (None, " "), (None, None)]


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [
    (1, LONG, "en", "s", 9), (1, LONG, "en", "s", 9), (None, None, None, None, None), (None, "", "en", None, 0), (2, None, None, "s", None),
    (2, "", "en", "t", 0), (3, "a line\nand another", "en", "t", 18), (3, "a line\nand a third", "de", "u", 18),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Tables whose rows have nulls, empty texts, repeats and ids of several texts, and empty ones."""
    out = {}
    for name, rows in (("odd", ODD), ("empty", [])):
        out[name] = f"file://{tmp_path_factory.mktemp(name)}"
        spark.createDataFrame(rows, DOCS).write.parquet(f"{out[name]}/documents.parquet")
        labels = [(1, 0, 0), (2, 1, 1), (None, None, None), (3, 0, 0)] if rows else []
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{out[name]}/labels.parquet")
    return out


def held(df):
    return Counter(tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect())


def test_stages_of_odd_rows(spark, tables):
    docs, d = spark.createDataFrame(ODD, DOCS), tables["odd"]
    every = Counter(ODD)
    clean = held(corpus_pipeline.drop_toxic(spark, docs, d))
    assert clean <= every and clean[1, LONG, "en", "s", 9] in (0, 2)
    assert held(corpus_pipeline.drop_boilerplate(spark, docs, d)) == every
    near = held(corpus_pipeline.drop_near_copies(spark, docs, d))
    assert near <= every and near[1, LONG, "en", "s", 9] == 1
    mixed = held(corpus_pipeline.mix_sources(spark, docs, d))
    assert set(mixed) <= set(every) and all(n <= 3 * every[r] for r, n in mixed.items())
    assert mixed == held(corpus_pipeline.mix_sources(spark, docs, d))
    tokens = corpus_pipeline.tokenise(spark, docs, d).collect()
    assert len(tokens) == len(ODD) and {r.n_tokens for r in tokens if r.doc_id == 2} == {0}


def test_stages_of_an_empty_table(spark, tables):
    docs = spark.createDataFrame([], DOCS)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, docs, tables["empty"]).count() == 0, name


def test_the_whole_run(spark, tables):
    rows = corpus_pipeline.run(spark, tables["odd"]).collect()
    assert rows and all(len(r.ids_sha256) == 64 for r in rows)
