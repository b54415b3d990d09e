"""Documents of very many lines take time in proportion to them."""

import time

from tidemark.llm import line_dedup


def test_line_dedup_is_linear_in_the_lines_of_a_document(spark):
    def took(n):
        texts = [(d, "\n".join(f"common line {i}" if i % 2 else f"own {d} {i}" for i in range(n)), f"s{d}") for d in range(5)]
        docs = spark.createDataFrame(texts, "doc_id int, text string, source string")
        began = time.perf_counter()
        got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.line_dedup(docs).collect()}
        assert got[0] == (n, 0, texts[0][1]) and got[3] == (n, n // 2, "\n".join(f"own 3 {i}" for i in range(0, n, 2)))
        return time.perf_counter() - began

    took(1_000)
    assert took(100_000) < 10 * took(10_000) + 5
