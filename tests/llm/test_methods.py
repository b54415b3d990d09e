"""The operators against brute force, round trips and held-out accuracy."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from tidemark.llm import bpe, graph, html_text, language, near_dedup, range_coder
from tidemark.llm.queries import ORACLE_SQL, QUERIES, tokenizer
from tools.compare import TABLES, plain

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.execute(ORACLE_SQL[name])
    there = [d[0] for d in rel.description]
    mine = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert mine == Counter(tuple(plain(dict(zip(there, r, strict=True))[c]) for c in cols) for r in rel.fetchall())


def components_by_brute_force(texts: dict[int, str]) -> dict[int, int]:
    sets = {}
    for i, t in texts.items():
        w = [re.sub("[A-Z]+", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t)]
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            n = len(sets[i] & sets[j])
            if i < j and n and 100 * n >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_near_copies_of_one_text(spark):
    """A group whose members are often just too far from each other."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    texts = {}
    for i in range(220):
        words = list(base)
        for _ in range(r.randrange(5)):
            words[r.randrange(150)] = f"x{r.randrange(10_000)}"
        texts[i] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    assert {x.doc_id: x.component_id for x in near_dedup.near_dedup(df).collect()} == components_by_brute_force(texts)


def test_links_between_blocks_of_a_bucket(spark, monkeypatch):
    """Blocks of four rows, after one star round: a large group of near copies, and texts that share
    passages with it without a link, or with a link to its rarest members only."""
    monkeypatch.setattr(near_dedup, "STARS", 1)
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 4)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 4 * 8192)
    r = random.Random(5)
    base, texts = [f"w{i}" for i in range(200)], {}
    for i in range(90):
        words = list(base)
        for _ in range(r.randrange(6)):
            words[r.randrange(200)] = f"x{r.randrange(10_000)}"
        cut = r.choice((0, 0, 20, 40, 60, 80))
        texts[i] = " ".join(words[: 200 - cut] + [f"y{r.randrange(3)}z{j}" for j in range(cut)])
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    want = components_by_brute_force(texts)
    assert len(set(want.values())) > 2
    assert {x.doc_id: x.component_id for x in near_dedup.near_dedup(df).collect()} == want


@pytest.mark.parametrize("largest", [3000, 0])
def test_pairs_of_blocks_meet_each_plausible_pair_once(largest):
    """Members outside the largest component (left >= 0) meet all others; members of it never meet."""
    signs = np.random.default_rng(2).integers(0, 2**32, near_dedup.HASHES, dtype=np.uint32).tobytes()
    n = largest + 40
    rows = pd.DataFrame({
        "bucket": 1, "node": [i.to_bytes(16, "big") for i in range(n)], "n": 100, "sig": [signs] * n, "one": 0, "two": 0, "right": 0,
        "component": [b"big"] * largest + [bytes([i]) for i in range(40)], "left": [-1] * largest + [0] * 40,
    })
    limits = near_dedup.least_matches(0.75)
    met = [(i, j) for i, others in near_dedup._partners(rows, (75, 100), limits, pd.factorize(rows["component"])[0]) for j in others]
    assert len(met) == len({frozenset(p) for p in met}) == 40 * largest + 40 * 39 // 2
    assert len(near_dedup._doubtful((75, 100), limits)(rows)) == n
    # Without a stray that signatures leave plausible, no set of the largest component is fetched.
    other = np.random.default_rng(3).integers(0, 2**32, near_dedup.HASHES, dtype=np.uint32).tobytes()
    stray = rows.iloc[:largest].assign(left=-1)
    stray = pd.concat([stray, rows.iloc[-1:].assign(sig=[other], left=0)])
    assert len(near_dedup._doubtful((75, 100), limits)(stray)) == 0


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(path, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(50)}}


def test_miss_probability_bounds_are_monotone():
    strict, loose = near_dedup.least_matches(0.75, 1e-2), near_dedup.least_matches(0.75, 1e-9)
    assert all(a > b for a, b in zip(strict, loose, strict=True)) and sorted(strict) == strict


ALPHABET = st.sampled_from(list("ab cd  e\n\t\r\x0b\x0cé\xa0　'sıß.,!0129ÀΣς一二̀三\x1c\x85🙂 ") + ["<|endoftext|>", "'ll", "   "])


@settings(max_examples=60, deadline=None)
@given(st.lists(ALPHABET, max_size=80).map("".join), st.integers(1, 30))
def test_bpe_equals_the_library(text, times):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encoder = bpe.encoder_of(tokenizer(name))
        t = text * times
        assert bpe.ChunkEncoder(encoder, {}).encode(t) == encoder.direct(t.encode())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.integers(1, 65536), st.integers(0, 2**31)), max_size=8))
def test_range_coder_round_trip(blocks):
    data = [np.random.default_rng(seed).integers(0, top, n).astype(np.uint16) for n, top, seed in blocks]
    back = range_coder.decode(range_coder.encode(data), [len(d) for d in data])
    assert all(np.array_equal(a, b) for a, b in zip(data, back, strict=True))


def test_range_coder_compresses_what_repeats():
    d = np.tile(np.arange(50, dtype=np.uint16), 160)
    assert len(range_coder.encode([d])[0]) < len(d) / 4


def test_codewords_keep_their_distance():
    for n in (1, 2, 4, 9, 40):
        code = language.codewords(n).astype(int)
        if n > 1:
            assert ((code[:, None] != code[None]).sum(2) + 99 * np.eye(n)).min() >= (1 if n == 2 else 2)
            assert (np.abs(code.sum(0)) < n).all()


PAGE = """<html><head><title>T</title><style>x{}</style></head><body><header class="site-header"><p>Site</p></header>
<nav><ul><li><a href=/>Home</a></li></ul></nav><aside><p>Side</p></aside><div class="cookie-notice">We use cookies</div>
<main><article><header><h1>Title &amp; more</h1></header><p>One   two<br>three</p><div class="ad">Buy</div><form><p>Mail</p></form>
<p>Last &lt;b&gt; words</p><section class="comments"><p>First!</p></section></article></main><script>var a = "<p>no</p>"</script>
<footer>Legal</footer></body></html>"""


def test_page_parts():
    assert html_text.main_text(PAGE) == "Title & more\nOne two\nthree\nLast <b> words"
    plain_page = PAGE.replace("main>", "div>").replace("article>", "div>").replace("<header>", "<div>").replace("</header><p>One", "</div><p>One")
    assert html_text.main_text(plain_page) == html_text.main_text(PAGE)


def test_recall_of_nearest_neighbours(spark):
    rows = QUERIES["op2_ann"](spark, SF).collect()
    data = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet' order by vec_id").fetchall()
    ids, x = np.array([r[0] for r in data]), np.array([r[1] for r in data], float)
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = set(ids[np.lexsort((ids, d))[:10]].tolist())
        hit, total = hit + len(best & {r.vec_id for r in rows if r.query_id == q}), total + 10
    assert hit / total >= 0.9


def test_held_out_accuracy(spark):
    truth = {r[0]: r[1:] for r in duckdb.sql("select doc_id, lang, toxic from '/root/testdata/sf0.01/documents.parquet' left join '/root/testdata/sf0.01/labels.parquet' using (doc_id)").fetchall()}
    found = [r for r in QUERIES["op6_language"](spark, "/root/testdata/sf0.01").collect() if r.held_out and truth[r.doc_id][0]]
    assert np.mean([r.lang_pred == truth[r.doc_id][0] for r in found]) > 0.98
    scored = [(r.predicted, truth[r.doc_id][1]) for r in QUERIES["op5_toxicity"](spark, "/root/testdata/sf0.01").collect() if truth[r.doc_id][1] is not None]
    assert np.mean([p == y for p, y in scored]) > 0.95


def test_pipeline(spark):
    """The stages by themselves: each works on what its predecessor kept."""
    import corpus_pipeline
    from tidemark.llm.shared import stage

    docs, counts = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        out = stage(f(spark, docs, SF), "t")
        if name == "near-dedup":
            texts = {r.doc_id: r.text or "" for r in docs.collect()}
            kept = {i for i, c in components_by_brute_force(texts).items() if i == c}
            assert {r.doc_id for r in out.collect()} == kept
        if name != "tokenising":
            assert out.columns == corpus_pipeline.COLUMNS
        docs = out
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] and counts[3] == counts[4] > 0
    assert entry.queries()["pipeline"] is corpus_pipeline.run
