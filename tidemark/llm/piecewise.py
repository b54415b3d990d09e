"""Document fingerprints by context-triggered piecewise hashing."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import map_texts, small_batches, stage

#: Bytes of the rolling window; most characters of a signature, how many are aimed at, at most, and how few make chunks smaller.
WINDOW, MOST, AIM, FEW = 7, 64, 48, 16
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_LETTERS = np.frombuffer(ALPHABET.encode(), np.uint8)
#: Multipliers of the rolling hash and of a chunk's hash, both odd, and the inverse of the second modulo 2^32.
ROLL, STEP = np.uint32(0x01000193), np.uint32(0x9E3779B1)
UNSTEP = np.uint32(pow(int(STEP), -1, 1 << 32))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def _powers(base: np.uint32, n: int) -> np.ndarray:
    """base^0 to base^n, modulo 2^32."""
    out = np.full(n + 1, base, np.uint32)
    out[0] = 1
    return np.multiply.accumulate(out)


def fingerprint_of(text: str | None) -> str:
    """`size:signature:signature`, the signatures at chunks of about `size` and 2 * size bytes of UTF-8.

    A chunk ends where the hash of the WINDOW bytes up to there has log2(size) low bits of zero, so boundaries
    depend on what stands around them only, and those of a size hold those of all larger ones. A
    chunk gives one character, from the hash of its bytes. `size` is the smallest power of two by which the text's length gives
    at most AIM chunks, or a smaller one where that gives fewer than FEW, as in texts that repeat themselves. What follows the first
    MOST - 1 chunks is one chunk. The empty text (and null) is `1::`.
    """
    x = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32) + np.uint32(1)
    n = len(x)
    if not n:
        return "1::"
    roll = x.copy()
    for k in range(1, min(WINDOW, n)):
        roll[k:] += x[:-k] * np.uint32(pow(int(ROLL), k, 1 << 32))
    roll = _mixed(roll)
    low = roll & (~roll + np.uint32(1))  # the lowest set bit; 0 where there is none
    # level: how many low bits are zero, as the exponent of a float
    level = np.where(low == 0, 32, np.frexp(low.astype(np.float32))[1] - 1)
    level[-1] = 33  # the end of the text ends a chunk
    chunks = np.cumsum(np.bincount(level, minlength=34)[::-1])[::-1]
    size = (-(-n // AIM) - 1).bit_length()
    while size and chunks[size] < FEW:
        size -= 1
    total = np.zeros(n + 1, np.uint32)
    np.cumsum(x * _powers(STEP, n - 1), dtype=np.uint32, out=total[1:])
    signatures = []
    for s in (size, size + 1):
        ends = np.flatnonzero(level >= s) + 1
        if len(ends) > MOST:
            ends = np.append(ends[: MOST - 1], n)
        begins = np.concatenate(([0], ends[:-1]))
        back = np.array([pow(int(UNSTEP), int(b), 1 << 32) for b in begins], np.uint32)
        h = _mixed((total[ends] - total[begins]) * back)
        signatures.append(_LETTERS[h >> np.uint32(26)].tobytes().decode())
    return f"{1 << size}:{signatures[0]}:{signatures[1]}"


def fingerprint(docs: DataFrame, text_col: str = "text", into: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each text in its place.

    Equal texts have equal fingerprints; null counts as empty; each row stands for itself, whatever its id, so repeats, ties and
    empty tables need no rule. Other columns are passed on, one named like `into` is replaced.
    """
    return map_texts(
        docs.drop(*[c for c in (into,) if c != text_col]), text_col, lambda: lambda texts: {into: [fingerprint_of(t) for t in texts]}, {into: "string"}
    )


def _alike(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length of two signatures; 0 where they share no run of 7 characters (or of half the
    shorter one, if that is less), which signatures of unrelated texts hardly do."""
    shorter = F.least(F.length(a), F.length(b))
    run = F.least(F.lit(WINDOW), F.ceil(shorter / 2).cast("int"))

    def grams(c: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(c) - run + 1), lambda i: c.substr(i, run))

    share = (shorter > 0) & F.arrays_overlap(grams(a), grams(b))
    return F.when(share, 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))).otherwise(0.0)


def likeness(a: Column, b: Column) -> Column:
    """How alike two fingerprints are, 0 to 1: the larger likeness of the signatures at a chunk size that both have.
    Equal ones are 1; those without a common size 0; null where one is null."""
    p, q = F.split(a, ":"), F.split(b, ":")
    size_p, size_q = p[0].cast("bigint"), q[0].cast("bigint")
    same = F.greatest(_alike(p[1], q[1]), _alike(p[2], q[2]))
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
        .when(a == b, 1.0)
        .when(size_p == size_q, same)
        .when(size_p == 2 * size_q, _alike(p[1], q[2]))
        .when(2 * size_p == size_q, _alike(p[2], q[1]))
        .otherwise(0.0)
    )


def _edited(text: str, following: str) -> str:
    """text with its last third (rounded down) replaced by the start of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


#: What is told of a row once the next one is known.
PAIR = ("edited_sha256", "edited_fingerprint")


def _pair(text: str, following: str) -> tuple[str, str]:
    edited = _edited(text, following)
    return hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint_of(edited)


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_chars, fingerprint, next_fingerprint, edited_sha256, edited_fingerprint of every row, beside the next one in descending order of id.

    The last row's next is the first. The edited text is the text with its last floor(n_chars / 3) code points
    replaced by as many of the next text's first ones (all, where it has fewer). A null text counts as empty; rows
    without an id come last; rows of one id are ordered by their text's digest, and rows alike in both
    are each other's next, in whatever order. A single row is its own next, an empty table gives an empty result.

    Rows are ranged by id, which moves every text once, and each task goes through its range in order, holding one text
    beside the batch at hand. What its last row needs of the next range's first one is left for a second step over those
    edges, two texts a range. Ranges split rows that are alike too, so no id or text fills one alone.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    digest = F.unhex(F.md5(F.col("text")))
    order = [F.col("id").desc_nulls_last(), digest]
    ranged = rows.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    ids = docs.schema[id_col].dataType.simpleString()

    def through(batches):
        part, last, head = TaskContext.get().partitionId(), None, None
        schema = None
        for b in batches:
            schema = pa.schema([
                b.schema.field("id"), ("n_chars", pa.int64()), ("fingerprint", pa.string()), ("next_fingerprint", pa.string()),
                *((c, pa.string()) for c in PAIR), ("part", pa.int32()), ("head", pa.string()), ("tail", pa.string()),
            ])
            out = []
            for i, t in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                mark = fingerprint_of(t)
                if last is None:
                    head = (t, mark)
                else:
                    out.append((last[0].as_py(), len(last[1]), last[2], mark, *_pair(last[1], t), part, None, None))
                last = (i, t, mark)
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
        if last is not None:
            end = (last[0].as_py(), len(last[1]), last[2], None, None, None, part, None, last[1])
            first = (None, None, head[1], None, None, None, part, head[0], None)
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in (end, first)], schema)

    fields = f"id {ids}, n_chars bigint, fingerprint string, next_fingerprint string, edited_sha256 string, edited_fingerprint string"
    found = stage(ranged.mapInArrow(through, f"{fields}, part int, head string, tail string"), "beside")
    # One row a range is all that meets in this window.
    heads = found.where("head is not null")
    after = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy()))
    turns = heads.select("part").withColumn("after", after)
    heads = heads.select(F.col("part").alias("after"), F.col("fingerprint").alias("next_fingerprint"), "head")
    tails = found.where("tail is not null").select("id", "n_chars", "fingerprint", "part", "tail").join(turns, "part").join(heads, "after")

    def join_ends(batches):
        for b in batches:
            pairs = [_pair(t, h) for t, h in zip(b.column("tail").to_pylist(), b.column("head").to_pylist(), strict=True)]
            kept = [b.column(c) for c in ("id", "n_chars", "fingerprint", "next_fingerprint")]
            made = [pa.array([p[k] for p in pairs], pa.string()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=["id", "n_chars", "fingerprint", "next_fingerprint", *PAIR])

    ends = tails.select("id", "n_chars", "fingerprint", "next_fingerprint", "tail", "head").mapInArrow(join_ends, fields)
    inner = found.where("head is null and tail is null").select(*ends.columns)
    return inner.unionByName(ends).withColumnRenamed("id", id_col)
