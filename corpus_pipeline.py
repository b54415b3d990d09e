"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing and tokenising, in this order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, line_dedup, mixing, near_dedup, toxicity
from tidemark.llm.queries import tokenizer
from tidemark.llm.shared import SPACE, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold. The model learns from the labels of the
    documents at hand. A document is scored by its own row, repeated ones and those without an id too; an empty table
    gives an empty result."""
    model = toxicity.train_folds(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sources share. A document of which no line is left goes;
    one that had no text to begin with stays. n_chars follows the text."""
    out = line_dedup.line_dedup(docs).where(~((F.col("n_removed") > 0) & (F.btrim("text", F.lit(" \t\r\n")) == "")))
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", chars).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest id; rows without an id come last.

    Rows are told apart by id and text, so those without an id are compared too, and of rows that
    repeat both one stays (the first by lang, source and n_chars), found by an aggregation that begins within tasks. Rows with neither an
    id nor words are copies of nothing and stay. An empty table gives an empty result.
    """
    copies = F.col("doc_id").isNotNull() | F.coalesce("text", F.lit("")).rlike(f"[^{SPACE}]")
    row = F.struct(
        F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"),
        F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest"),
    )
    rows = docs.where(copies).withColumn("row", row)
    kept = near_dedup.near_dedup(rows, id_col="row").where("kept").select("row")
    # Each row's one stands for its repeats before it meets what stays, so no key has more than a row a task.
    first = rows.groupBy("row").agg(F.min(F.struct("doc_id", "lang", "source", "n_chars", "text")).alias("first"))
    out = first.join(kept, "row", "left_semi").select("first.*").select(*COLUMNS)
    return out.unionByName(docs.where(~copies).select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target asks. Repeated rows are taken each for itself; an
    empty table gives an empty mix."""
    mixed = mixing.mix(docs, keep=("text", "lang", "n_chars"))
    return mixing.emit(mixed).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text, and digests of ids and decoded text: a row for each row, repeats included."""
    out = bpe.encode_decode(docs, tokenizer("word_bpe_49k.json"), keep=("source",), digests=True)
    return out.select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("tokenising", tokenise),
]

#: SQL cannot express the classifier, the near-dedup or the tokeniser.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
