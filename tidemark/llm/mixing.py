"""Mixing sources to target weights by systematic sampling (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE, stage

WEIGHTS = (5, 2, 1)
MOST = 3


def word_count(text: str) -> F.Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size -> also target: the whole of all sizes, shared by weight.

    Sources by code point, null last, take the weights in turn. A target stops at `most` times
    its source's size and the excess goes to the others by weight, until none is above: that is
    one common level L with target = least(cap, L * weight), found by a prefix sum over the
    sources in the order in which they fill up. One row per source is all that meets here.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * most)
    fill = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, every = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.select(
        "*",
        F.sum("source_size").over(every).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
    )
    level = (F.col("total") - F.col("cap_before")) / F.col("weight_left")
    s = s.withColumn("level", level).withColumn("free", F.col("cap") > F.col("level") * F.col("weight"))
    # The level is that of the first source in this order which does not fill up.
    at = F.min(F.when(F.col("free"), F.struct("cap_before", "level"))).over(every)
    s = s.withColumn("at", at["level"])
    target = F.when(F.col("at").isNull(), F.col("cap").cast("double")).otherwise(
        F.least(F.col("cap").cast("double"), F.col("at") * F.col("weight"))
    )
    return s.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
    seed: int = 7,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Per row of docs: id, source, size (words), source_size, target, copies, taken.

    Within a source every document expects target / source_size copies. The documents stand in
    a fixed order, the expected copies are summed along it from one offset drawn from (seed,
    source), and a document is emitted once per integer boundary that its share crosses. The
    order is by size, so that the words taken keep near the target as well as the copies. No
    source needs one task: the order runs over blocks (size class, digest of the id), and a
    prefix sum over the blocks' row counts gives each block its first position.

    A null or empty text has size 0 and is taken like any other. Null sources are one source.
    A source of size 0 has target 0. Rows that repeat an id are ordered by their text's digest.
    An empty table gives an empty result. `keep` names further columns of docs to carry.
    """
    d = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"),
        F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"),
        F.struct(*[F.col(c) for c in keep]).alias("kept") if keep else F.lit(None).alias("kept"),
    )
    bits = F.length(F.bin("size"))
    spread = F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))), 1, 2)
    top = F.expr("shiftright(size, greatest(length(bin(size)) - 4, 0))")
    d = d.select("*", F.struct(bits.alias("bits"), top.alias("top"), spread.alias("spread")).alias("block"))
    if not keep:
        d = stage(d.drop("kept"), "mix-rows")  # so that words are counted once; with `keep` that would write the texts
    by_block = stage(d.groupBy("source", "block").agg(F.count("*").alias("rows"), F.sum("size").alias("words")), "mix-blocks")
    sizes = by_block.groupBy("source").agg(F.sum("words").alias("source_size"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = by_block.select(
        "source", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first")
    )
    goal = targets(sizes, weights, most)
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit(""))))
    offset = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    share = F.when(
        F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))
    ).otherwise(F.lit(0.0))
    goal = goal.select("source_size", "target", offset.alias("u"), share.alias("share"), F.col("source").alias("p_source"))
    p = first.join(goal, F.col("source").eqNullSafe(F.col("p_source"))).select(
        "p_source", F.col("block").alias("p_block"), "first", "source_size", "target", "u", "share"
    )
    within = Window.partitionBy("source", "block").orderBy("size", F.col("id").asc_nulls_last(), "digest")
    d = d.withColumn("n", F.row_number().over(within))
    d = d.join(p, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("block") == F.col("p_block")))
    at = F.col("first") + F.col("n")
    copies = F.floor(at * F.col("share") + F.col("u")) - F.floor((at - 1) * F.col("share") + F.col("u"))
    return d.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
        copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"),
        *[F.col(f"kept.{c}").alias(c) for c in keep],
    )


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as `copies` says."""
    copies = F.sequence(F.lit(1), F.col("copies").cast("int"))
    return mixed.where("copies > 0").withColumn("copy", F.explode(copies))
