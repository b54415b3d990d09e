"""Joins of chunks are encoded by words that are known, and checked against the library's own ids once."""

import pytest

pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from tidemark.llm import bpe


def test_a_join_that_was_met_takes_no_library_call(monkeypatch):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        encoder = bpe.Encoder(f.read())
    chunks, calls, direct = bpe.ChunkEncoder(encoder, {}), [], encoder.direct
    text = " ".join(f"word{i * 7919 % 4001} and Some, more-text." for i in range(3000))
    assert len(bpe.cuts(text.encode())) > 10
    whole = direct(text.encode())
    assert chunks.encode(text) == whole
    monkeypatch.setattr(encoder, "direct", lambda data: calls.append(data) or direct(data))
    assert chunks.encode(text) == whole and not calls
