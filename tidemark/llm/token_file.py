"""Token-id files: documents in id order as range-coded blocks, and reading them back.

A file table is Parquet with a row per segment. A segment holds whole documents: their ids (as text)
and lengths, and their token ids in blocks that are coded, reset and checksummed on their own. Parquet through
Spark's writer gives atomic commits on any store; the codes are ours (range_coder).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import range_coder
from .bpe import encoder_of
from .shared import shared_dir

#: The id after each document; ids in a segment at least; ids that a task codes side by side.
END, SEGMENT, TOGETHER = 2, 1 << 16, 1 << 22

FILE_SCHEMA = (
    "part int, segment int, docs array<string>, doc_tokens array<bigint>, tokens bigint, "
    "block_tokens array<int>, block_bytes array<int>, block_crc32 array<bigint>, codes binary"
)


def _segments(batches: Iterator[pd.DataFrame], spec: str) -> Iterator[tuple[list, list, np.ndarray]]:
    """Documents of a task in order, gathered until they hold SEGMENT ids."""
    encoder = encoder_of(spec)
    if np.dtype(encoder.dtype).itemsize != 2:
        raise ValueError("the vocabulary must have at most 65536 ids")
    docs, lengths, ids, held = [], [], [], 0
    end = np.array([END], encoder.dtype)
    for b in batches:
        for i, text in zip(b["id"], b["text"], strict=True):
            data = (text or "").encode("utf-8", "replace")
            x = encoder.direct(data) if encoder.special(data) else encoder.encode(data)
            ids += [np.frombuffer(x, encoder.dtype), end]
            docs.append(i)
            lengths.append(len(ids[-2]) + 1)
            held += lengths[-1]
            if held >= SEGMENT:
                yield docs, lengths, np.concatenate(ids)
                docs, lengths, ids, held = [], [], [], 0
    if docs:
        yield docs, lengths, np.concatenate(ids)


def _write(spec: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, waiting, held = TaskContext.get().partitionId(), 0, [], 0

        def coded() -> pd.DataFrame:
            nonlocal number
            cut = [[ids[i : i + range_coder.BLOCK] for i in range(0, len(ids), range_coder.BLOCK)] for _, _, ids in waiting]
            codes = iter(range_coder.encode([b for blocks in cut for b in blocks]))
            rows = []
            for (docs, lengths, ids), blocks in zip(waiting, cut, strict=True):
                own = [next(codes) for _ in blocks]
                crcs = [crc32(b.astype("<u2").tobytes()) for b in blocks]
                rows.append((part, number, docs, lengths, len(ids), [len(b) for b in blocks], [len(c) for c in own], crcs, b"".join(own)))
                number += 1
            waiting.clear()
            return pd.DataFrame(rows, columns=[f.split()[0] for f in FILE_SCHEMA.split(", ")])

        for segment in _segments(batches, spec):
            waiting.append(segment)
            held += len(segment[2])
            if held >= TOGETHER:
                yield coded()
                held = 0
        if waiting:
            yield coded()

    return run


def write(docs: DataFrame, spec: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every text, each with the id END after it, in ascending id order.

    Null texts are empty ones (END alone); null ids come first. Rows of one id are ordered by
    their text's digest. Tasks take ranges of ids; rows that repeat an id without end are spread
    over several by their place in the input.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    d = d.withColumns({"digest": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    order = [F.col("id").asc_nulls_first(), "digest", "place"]
    d = d.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("id").cast("string"), "text")
    d.mapInPandas(_write(spec), FILE_SCHEMA).write.parquet(path)


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.Series, np.ndarray]]:
    """Each segment with its ids, decoded about TOGETHER ids at a time; a wrong checksum is an error."""
    for b in batches:
        for _, group in b.groupby(b["tokens"].cumsum() // TOGETHER, sort=False):
            codes, lengths, crcs = [], [], []
            for r in group.itertuples():
                ends = np.cumsum(r.block_bytes)
                if sum(r.block_bytes) != len(r.codes) or not r.tokens == sum(r.block_tokens) == sum(r.doc_tokens):
                    raise ValueError("a block's checksum does not match: its segment is cut")
                codes += [r.codes[e - n : e] for e, n in zip(ends, r.block_bytes, strict=True)]
                lengths += list(r.block_tokens)
                crcs += list(r.block_crc32)
            blocks = range_coder.decode(codes, lengths)
            if any(crc32(x.astype("<u2").tobytes()) != c for x, c in zip(blocks, crcs, strict=True)):
                raise ValueError("a block's checksum does not match")
            rest = iter(blocks)
            for _, r in group.iterrows():
                yield r, np.concatenate([next(rest) for _ in r["block_tokens"]])


def _read(digest: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r, ids in _decoded(batches):
            ends = np.cumsum(r["doc_tokens"])
            own = [ids[e - n : e].astype("<u4").tobytes() for e, n in zip(ends, r["doc_tokens"], strict=True)]
            yield pd.DataFrame({
                "part": r["part"], "segment": r["segment"], "id": r["docs"], "before": ends - r["doc_tokens"],
                "n_tokens": r["doc_tokens"], **({"ids_crc32": [crc32(x) for x in own]} if digest else {"ids": own}),
            })

    return run


def read(spark: SparkSession, path: str, id_col: str = "doc_id", id_type: str = "bigint", digest: bool = False) -> DataFrame:
    """Per document of a file table: id, start (ids of all documents before it), n_tokens (with END)
    and its ids as unsigned 32-bit little-endian integers, or with `digest` their ids_crc32.

    Starts are prefix sums: over the tasks' totals, one row each, then over a task's segments.
    """
    table = spark.read.parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = table.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    parts = parts.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    segments = table.select("part", "segment", F.coalesce(F.sum("tokens").over(within), F.lit(0)).alias("segment_start"))
    starts = segments.join(parts, "part").select("part", "segment", (F.col("part_start") + F.col("segment_start")).alias("first"))
    last = "ids_crc32 bigint" if digest else "ids binary"
    docs = table.mapInPandas(_read(digest), f"part int, segment int, id string, before bigint, n_tokens bigint, {last}")
    return docs.join(starts, ["part", "segment"]).select(
        F.col("id").cast(id_type).alias(id_col), (F.col("first") + F.col("before")).alias("start"), "n_tokens", last.split()[0]
    )


def round_trip(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs to a new file table in the shared folder and read its digests back."""
    path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, spec, path, id_col, text_col)
    return read(docs.sparkSession, path, id_col, docs.schema[id_col].dataType.simpleString(), digest=True)
