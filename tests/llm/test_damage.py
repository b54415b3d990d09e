"""Broken input: damaged token files, pages of a megabyte without an end, joins that disagree, sessions with large batches."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, html_text, range_coder, shared, token_file
from tidemark.llm.queries import tokenizer


def segment(codes: bytes, ids: np.ndarray, crc: int):
    import pandas as pd

    names = [f.split()[0] for f in token_file.FILE_SCHEMA.split(", ")]
    return iter([pd.DataFrame([(0, 0, ["1"], [len(ids)], len(ids), [len(ids)], [len(codes)], [crc], codes)], columns=names)])


def test_damaged_and_cut_codes_are_checksum_errors():
    from zlib import crc32

    ids = (np.random.default_rng(1).zipf(1.4, 60) % 5000).astype(np.uint16)
    code, crc = range_coder.encode([ids])[0], crc32(ids.tobytes())
    assert np.array_equal(next(token_file._decoded(segment(code, ids, crc)))[1], ids)
    for bit in range(0, 8 * len(code), 13):
        bad = bytearray(code)
        bad[bit // 8] ^= 1 << bit % 8
        if not np.array_equal(range_coder.decode([bytes(bad)], [len(ids)])[0], ids):  # the last bits may say nothing
            with pytest.raises(ValueError, match="checksum"):
                next(token_file._decoded(segment(bytes(bad), ids, crc)))
    for cut in (0, 1, 5, len(code) // 2):
        with pytest.raises(ValueError, match="checksum"):
            next(token_file._decoded(segment(code[:cut], ids, crc)))


def test_the_mixture_follows_its_predictions():
    """Repeats cost far less than their order-0 entropy, and noise little more than 16 bits an id."""
    r = np.random.default_rng(4)
    cycle, noise = np.tile(r.integers(0, 60000, 100), 80).astype(np.uint16), r.integers(0, 65536, 8000).astype(np.uint16)
    near, far = (len(range_coder.encode([x])[0]) * 8 / len(x) for x in (cycle, noise))
    assert near < 1 < 6.6 and far < 17.5


N = 60_000
BROKEN = {
    "open tags": "<a " * N, "open quotes": '<a "' * N, "two quotes": "<a \"'>" * N, "declarations": "<!x " * N, "heads": "<p><head>" * N,
    "end tags": "<b>" * N + "</i>" * N, "scripts": "<script>" * N, "divs": "<div>x" * N, "lone quote": '<p title="x>' + "<p>a</p>" * N,
}


@pytest.mark.parametrize("name", BROKEN)
def test_long_broken_pages_take_linear_time(name):
    began = time.process_time()
    html_text.main_text(BROKEN[name] * 2)
    assert time.process_time() - began < 20


def test_what_nothing_ends_is_text():
    assert html_text.main_text("<p>one <b>two</b> 3 < 4 <a href=") == "one two 3 < 4 <a href="
    assert html_text.main_text('<p>one</p><p title="a>two</p><p>three</p>') == "one\ntwo\nthree"
    assert html_text.main_text("<p>one<!-- two") == "one"


def test_a_long_page_and_clashing_columns(spark):
    page = "<div>" + "".join(f"<p>Paragraph {i} has some words of its own.</p>" for i in range(20_000)) + "</div>"
    df = spark.createDataFrame([(1, "u", page, "kept", 7)], "page_id bigint, url string, html string, text string, n_chars int")
    r = html_text.extract(df).first()
    assert r.text.count("\n") == 19_999 and r.n_chars == len(r.text)


def test_joins_widen_until_they_agree(monkeypatch):
    encoder = bpe.encoder_of(tokenizer("word_bpe_49k.json"))
    text = " ".join(f"word{i} and{i}, other" for i in range(3000))
    agrees = bpe.ChunkEncoder.agrees
    for often in (1, 2, 3, 10**9):
        said = []

        def doubt(self, *a, often=often, said=said):
            said.append(a)
            return len(said) > often and agrees(self, *a)

        monkeypatch.setattr(bpe.ChunkEncoder, "agrees", doubt)
        assert bpe.ChunkEncoder(encoder, {}).encode(text) == encoder.direct(text.encode())
        assert len(said) > min(often, 1)


def test_words_are_remembered_in_two_generations(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 50)
    encoder = bpe.Encoder(tokenizer("word_bpe_49k.json"))
    for i in range(40):
        data = " ".join(f"w{j} x{i}{j}" for j in range(20)).encode()
        assert encoder.encode(data) == encoder.direct(data)
        assert len(encoder.known) <= 50


def test_batches_are_bounded_but_never_raised(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for now, then in (("10000", "500"), ("0", "500"), ("7", "7")):
        spark.conf.set(key, now)
        shared.small_batches(spark)
        assert spark.conf.get(key) == then
    spark.conf.unset(key)
    shared.small_batches(spark)
    assert spark.range(3).select(F.col("id")).count() == 3
