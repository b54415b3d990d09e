"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut by a rolling hash over their bytes, so documents that share a passage share its
chunks. A chunk's inside is encoded once and looked up afterwards; the text around each cut is
encoded again until it agrees with what a wider window gives.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_texts, small_batches

#: Chunk sizes in bytes: the least, the mean distance of cuts and the most.
SMALLEST, MEAN_BITS, LARGEST = 256, 10, 8192
#: Chunks whose ids are encoded once for all tasks and broadcast: the most frequent ones. 20,000
#: chunks of at most 8 KiB bound that; a chunk beyond it is encoded once by each task that meets it
#: while it remembers it.
SHARED = 20_000
#: Words that a worker remembers, and as many before them, and chunks that a task does.
KNOWN_WORDS, KNOWN_CHUNKS = 200_000, 10_000

_GEAR = np.random.default_rng(97).integers(0, 2**32, 256, dtype=np.uint32)
#: A place where no pre-token crosses: before one space between printable ASCII characters.
SAFE = re.compile(rb"(?<=[\x21-\x7e])(?= [\x21-\x7e])")
# The characters of the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
UNIT = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def cuts(data: bytes) -> list[int]:
    """The ends of the chunks of data but the last one's: after a byte where the rolling hash of
    the 16 bytes up to it has MEAN_BITS leading zeros, moved on to the next character."""
    if len(data) <= SMALLEST:
        return []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8):
        wider = h.copy()
        wider[k:] += h[:-k] << np.uint32(k)
        h = wider
    out, start = [], 0
    for p in [*(np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1).tolist(), len(data)]:
        while p - start > LARGEST:
            out.append(_whole(data, start + LARGEST))
            start = out[-1]
        p = _whole(data, p)
        if SMALLEST <= p - start and p < len(data):
            out.append(p)
            start = p
    return out


def _whole(data: bytes, p: int) -> int:
    """The first start of a character at p or after."""
    while p < len(data) and data[p] & 0xC0 == 0x80:
        p += 1
    return p


class Encoder:
    """A tokenizers file as ids of whole texts, word by word; equal to the library's encode().

    Words (runs between white space, with one leading space where the tokenizer keeps spaces) are
    units that no pre-token crosses; the library encodes each unit that is not remembered. Texts
    with the string of an added token go to the library whole.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.added = [t["content"].encode() for t in json.loads(spec)["added_tokens"]]
        self.drops_space = not self.tok.encode(" ", add_special_tokens=False).ids
        self.dtype = "<u2" if self.tok.get_vocab_size() <= 65536 else "<u4"
        # Few ids at a time are packed in a fraction of numpy's time by an array of the machine's integers.
        self.code = np.dtype(self.dtype).newbyteorder("=").char
        #: The words met lately, and those before them.
        self.known: dict = {}
        self.old: dict = {}
        self.names = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size())]

    def direct(self, data: bytes) -> bytes:
        ids = self.tok.encode(data.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, self.dtype).tobytes()

    def special(self, data: bytes) -> bool:
        return any(a in data for a in self.added)

    def encode(self, data: bytes) -> bytes:
        """The ids of data, which holds no added token, as packed integers."""
        units = data.split() if self.drops_space else UNIT.findall(data.decode("utf-8", "replace"))
        known, missing = self.known, set(units).difference(self.known)
        if len(known) + len(missing) > KNOWN_WORDS:
            self.old, known, missing = known, {}, set(units)
            self.known = known
        if missing:
            new = [u for u in missing if known.setdefault(u, self.old.get(u)) is None]
            texts = [u.decode("utf-8", "replace") for u in new] if self.drops_space else new
            for u, e in zip(new, self.tok.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                known[u] = array(self.code, e.ids).tobytes()
        return b"".join(map(known.__getitem__, units))

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode(ids, skip_special_tokens=False): without a decoder, the tokens
        joined by spaces."""
        if self.tok.decoder is None:
            return " ".join(map(self.names.__getitem__, ids.tolist()))
        return self.tok.decode(ids.tolist(), skip_special_tokens=False)


@lru_cache(maxsize=1)
def encoder_of(spec: str) -> Encoder:
    """A worker keeps its encoder, and the words that it remembers, from task to task."""
    return Encoder(spec)


def inside(chunk: bytes) -> tuple[int, int]:
    """The first and last safe places of a chunk; (0, 0) without two of them."""
    first = SAFE.search(chunk)
    if not first:
        return 0, 0
    tail = max(first.start(), len(chunk) - 64)
    last = max((m.start() for m in SAFE.finditer(chunk, tail)), default=0) or max(m.start() for m in SAFE.finditer(chunk))
    return (first.start(), last) if last > first.start() else (0, 0)


def digest(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


class ChunkEncoder:
    """Whole texts to ids by chunks: shared ones from a dictionary, others remembered."""

    def __init__(self, encoder: Encoder, shared: dict[bytes, tuple[int, int, bytes]]):
        self.encoder, self.shared, self.known = encoder, shared, {}
        self.joins: dict[bytes, bytes] = {}

    def body(self, chunk: bytes) -> tuple[int, int, bytes]:
        key = digest(chunk)
        got = self.shared.get(key) or self.known.get(key)
        if got is None:
            a, b = inside(chunk)
            got = (a, b, self.encoder.encode(chunk[a:b]) if b else b"")
            if len(self.known) >= KNOWN_CHUNKS:
                self.known.clear()
            self.known[key] = got
        return got

    def agrees(self, data: bytes, left: int, right: int, ids: bytes) -> bool:
        """Whether data[left:right] has these ids within a window that is a word wider on each side."""
        before = [m.start() for m in SAFE.finditer(data, max(0, left - 32), left)][-1:]
        after = SAFE.search(data, right + 1, right + 32)
        a, b = before[0] if before else left, after.start() if after else right
        key = data[a:b]
        if key not in self.joins:
            if len(self.joins) >= KNOWN_CHUNKS:
                self.joins.clear()
            self.joins[key] = self.encoder.direct(key)
        return self.encoder.encode(data[a:left]) + ids + self.encoder.encode(data[right:b]) == self.joins[key]

    def encode(self, text: str | None) -> bytes:
        data = (text or "").encode("utf-8", "replace")
        if not data:
            return b""
        if self.encoder.special(data):
            return self.encoder.direct(data)
        ends = cuts(data)
        if not ends:
            return self.encoder.encode(data)
        done: list[tuple[int, bytes]] = []  # where a stretch ends, and its ids
        upto = at = 0
        for end in [*ends, len(data)]:
            a, b, ids = self.body(data[at:end])
            if b:
                # From what is done to this chunk's inside lies the join (or the text's head).
                left, right = upto, at + a
                # By words that are mostly known; `agrees` has the library encode the wider window.
                joined = self.encoder.encode(data[left:right])
                if not at or self.agrees(data, left, right, joined):
                    done += [(right, joined), (at + b, ids)]
                elif not self.repaired(data, done, at + b):
                    return self.encoder.direct(data)
                upto = at + b
            at = end
        done.append((len(data), self.encoder.encode(data[upto:])))
        return b"".join(ids for _, ids in done)

    def repaired(self, data: bytes, done: list[tuple[int, bytes]], right: int) -> bool:
        """Encode again up to `right`, from one stretch further back each time, until that agrees with a
        wider window; False if it does not even from the text's start, which leaves the whole text."""
        while done:
            done.pop()
            left = done[-1][0] if done else 0
            ids = self.encoder.direct(data[left:right])
            if self.agrees(data, left, right, ids):
                done.append((right, ids))
                return True
        return False


def _chunks(text: str | None) -> Iterator[bytes]:
    data, at = (text or "").encode("utf-8", "replace"), 0
    for end in [*cuts(data), len(data)]:
        yield data[at:end]
        at = end


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        got = [digest(c) for t in b["text"] for c in _chunks(t) if len(c) >= SMALLEST]
        yield pd.DataFrame({"key": got, "n": 1}).groupby("key", as_index=False).sum() if got else pd.DataFrame({"key": [], "n": []})


def _encode_chosen(spec: str, chosen: frozenset[bytes]):
    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = {k: c for t in b["text"] for c in _chunks(t) if (k := digest(c)) in chosen}
            yield pd.DataFrame({"key": list(got), "chunk": list(got.values())})

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(spec)
        for b in batches:
            at = [inside(c) for c in b["chunk"]]
            ids = [encoder.encode(c[x:y]) if y and not encoder.special(c) else b"" for c, (x, y) in zip(b["chunk"], at, strict=True)]
            yield pd.DataFrame({"key": b["key"], "first": [x for x, _ in at], "last": [y for _, y in at], "ids": ids})

    return pick, encode


def shared_chunks(docs: DataFrame, spec: str, most: int = SHARED) -> dict[bytes, tuple[int, int, bytes]]:
    """key -> (first, last, ids) of the `most` chunks that occur most often, twice at least.

    Chunks are counted over all texts by their digests; only the chosen ones' texts are gathered,
    one copy each, and encoded once. `most` bounds what reaches the driver.
    """
    counts = docs.mapInPandas(_digests, "key binary, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    chosen = frozenset(bytes(r["key"]) for r in counts.orderBy(F.desc("n"), "key").limit(most).collect())
    if not chosen:
        return {}
    pick, encode = _encode_chosen(spec, chosen)
    texts = docs.mapInPandas(pick, "key binary, chunk binary").dropDuplicates(["key"])
    rows = texts.mapInPandas(encode, "key binary, first int, last int, ids binary").collect()
    return {bytes(r["key"]): (r["first"], r["last"], bytes(r["ids"])) for r in rows}


def _encode(spec: str, shared, digests: bool):
    def start():
        encoder = ChunkEncoder(encoder_of(spec), shared.value)

        def make(texts: list) -> dict[str, list]:
            n, ids, decoded = [], [], []
            for t in texts:
                x = np.frombuffer(encoder.encode(t), encoder.encoder.dtype)
                n.append(len(x))
                ids.append(x.astype("<u4").tobytes())
                decoded.append(encoder.encoder.decode(x))
                if digests:
                    ids[-1] = hashlib.sha256(ids[-1]).hexdigest()
                    decoded[-1] = hashlib.sha256(decoded[-1].encode()).hexdigest()
            return {"n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded, "ids": ids, "decoded": decoded}

        return make

    return start


def encode_decode(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), digests: bool = False, most_shared: int = SHARED) -> DataFrame:
    """Per row of docs: id, `keep`, ids (unsigned 32-bit little-endian), decoded; with `digests`
    instead n_tokens, ids_sha256 and decoded_sha256, made in the same tasks.

    spec is the text of a tokenizers file, so that tasks need no file of their own. A null text is
    an empty one: no ids, an empty decoded text. Whole texts of any length are encoded as the library
    does without special tokens, and decoded with them; repeated rows give equal results.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(shared_chunks(d, spec, most_shared))
    d = docs.select(id_col, *keep, F.col(text_col).alias("_bpe_text"))
    if digests:
        fields = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    else:
        fields = {"ids": "binary", "decoded": "string"}
    return map_texts(d, "_bpe_text", _encode(spec, shared, digests), fields)
