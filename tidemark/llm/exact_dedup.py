"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

A text is cut where its own characters say so, each chunk is named by a 128-bit digest, and
two texts are equal when their ordered lists of chunk names are. Chunk texts cross the
network once, to prove that no name stands for two different chunks; whole documents never do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, join_back, part_of_row, stage

#: A chunk ends after such a triple of characters, once it is long enough.
CUT = r"[ae][nrst][ ,.\n]"


def pieces(text: Column, smallest: int = 1024, largest: int = 8192) -> Column:
    """The content-defined chunks of text in order; empty for an empty text."""
    pattern = rf"(?s).{{{smallest},{largest}}}?{CUT}|.{{{largest}}}|.+"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def chunk_name(piece: Column, bits: int = 128) -> Column:
    """The name of a chunk. Fewer bits than 128 are for tests of the clash path."""
    return F.unhex(F.substring(F.md5(piece), 1, bits // 4))


def clashes(docs: DataFrame, text: Column, bits: int = 128) -> DataFrame:
    """Chunk names that stand for more than one chunk text. Equal chunks meet in the
    map-side aggregation, so each task sends a chunk's text at most once."""
    chunks = docs.select(F.explode(pieces(text)).alias("piece")).select(
        chunk_name(F.col("piece"), bits).alias("name"), "piece"
    )
    return chunks.distinct().groupBy("name").agg(F.count("*").alias("n")).where("n > 1")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 128) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. A null text counts as empty; empty
    texts form one group. Of a group the row with the largest id stays. Rows that repeat an id
    within a group are the same document and share `kept`. A null id is never kept unless all
    ids of its group are null; then keep_id is null and the rows stay. Other columns of docs
    are not read, so their names cannot clash. The rows of a group, empty texts too, learn its
    totals in parts, so a group of any size is never one task's.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = ascii_lower(F.col("text"))
    named = F.transform(pieces(F.col("norm")), lambda p: chunk_name(p, bits))
    # With a clash, the names prove nothing: those corpora are compared by text as well.
    doubt = clashes(docs, text, bits).limit(1).count() > 0
    recipes = docs.select("id", text.alias("norm")).select(
        "id",
        named.alias("recipe"),
        (F.col("norm") if doubt else F.lit("")).alias("proof"),
        F.sha2("norm", 256).alias("text_sha256"),
        part_of_row().alias("part"),
    )
    recipes = stage(recipes, "recipes")
    totals = F.max("id").alias("keep_id"), F.count("*").alias("group_size")
    return join_back(recipes, ["recipe", "proof"], F.col("part"), *totals).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
