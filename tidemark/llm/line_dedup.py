"""Line dedup by distinct-site spread (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import each_part, part_of, parts_met, stage

MIN_SITES = 4
#: Sketch precision (2^k registers, about 1.04 / sqrt(2^k) relative error) and the share of the
#: threshold on either side within which an estimate does not decide.
LG_K, BAND = 10, 0.25


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_name(line: Column) -> Column:
    """A line's 128-bit name; outer blanks do not count. Null for a blank line."""
    bare = F.btrim(line, F.lit(" \t\r"))
    return F.when(bare != "", F.unhex(F.md5(bare)))


def spread_lines(lines: DataFrame, min_sites: int, lg_k: int = LG_K, band: float = BAND) -> DataFrame:
    """name, first, part: the lines seen on at least min_sites distinct sites and where each comes first,
    a row for each part that holds rows of the line.

    lines has name, site, place, part. One sketch of sites per line is merged by aggregation, so a line
    of any frequency is a row per task in the shuffle. Lines whose estimate lies within `band`
    of the threshold are counted exactly, over their distinct (line, site) pairs.
    """
    sketches = stage(
        lines.groupBy("name").agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"), F.min("place").alias("first"),
            parts_met("part").alias("met"),
        ).where(F.col("sites") >= min_sites * (1 - band)),
        "line-spread",
    )
    near = F.col("sites") < min_sites * (1 + band)
    exact = (
        lines.join(each_part(sketches.where(near).select("name", "met"), "met", "part"), ["name", "part"], "left_semi")
        .select("name", "site").distinct()
        .groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites)
    )
    spread = sketches.where(~near).unionByName(sketches.join(exact, "name", "left_semi"))
    return each_part(spread.select("name", "first", "met"), "met", "part")


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = MIN_SITES,
) -> DataFrame:
    """docs with the boilerplate lines taken out of text, and n_lines, n_removed.

    A line (outer blanks aside) that occurs on min_sites distinct sites or more is boilerplate;
    it stays where it comes first (smallest id, then smallest line number) and goes everywhere
    else, so no text is lost from the corpus. Blank lines are never boilerplate. A null site is
    one site of its own. A null text stays null and has no lines; a text of which every line
    goes becomes empty. Rows with one id and one text share their fate; rows without an id come
    after all others. Columns other than text are passed on; helper names start with `_ld_`.
    """
    key = {"_ld_id": F.col(id_col), "_ld_digest": F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))}
    place = F.struct(F.col("_ld_id").isNull().alias("none"), F.col("_ld_id").alias("id"), "no", F.col("_ld_digest").alias("digest"))
    # The digest is a column before the text is split: beside the explosion it would be taken of the text for each line.
    lines = (
        docs.select(*[c.alias(n) for n, c in key.items()], F.coalesce(F.concat(F.lit("s"), F.col(site_col)), F.lit("n")).alias("site"),
                    split_lines(F.col(text_col)).alias("lines"))
        .select("_ld_id", "_ld_digest", "site", F.posexplode("lines").alias("no", "line"))
        .select("_ld_id", "_ld_digest", "site", "no", line_name(F.col("line")).alias("name"))
        .where("name is not null")
    )
    # Three passes follow; this one alone reads and names the texts' lines.
    lines = stage(lines, "lines").withColumns({"place": place, "part": part_of("_ld_id", "_ld_digest", "no")})
    spread = spread_lines(lines, min_sites)
    goes = (
        lines.select("_ld_id", "_ld_digest", "no", "name", "place", "part")
        .join(spread, ["name", "part"])
        .where(F.col("place") != F.col("first"))
        .groupBy("_ld_id", "_ld_digest")
        .agg(F.collect_set("no").alias("_ld_goes"))
        .select(F.col("_ld_id").alias("_ld_rid"), F.col("_ld_digest").alias("_ld_rdigest"), "_ld_goes")
    )
    out = docs.select("*", *[c.alias(n) for n, c in key.items()]).join(
        goes,
        F.col("_ld_id").eqNullSafe(F.col("_ld_rid")) & (F.col("_ld_digest") == F.col("_ld_rdigest")),
        "left",
    )
    all_lines = split_lines(F.col(text_col))
    # The numbers that stay, by one pass over both arrays, then their lines: time in proportion to the lines. The lines are bound
    # to a name, as an expression would be split anew for each number.
    numbers = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("_ld_goes"))
    stays = F.transform(F.array(all_lines), lambda lines: F.array_join(F.transform(numbers, lambda i: lines[i]), "\n"))[0]
    gone = F.coalesce(F.size("_ld_goes"), F.lit(0))
    new = F.when(F.col("_ld_goes").isNull(), F.col(text_col)).otherwise(stays)
    return out.select(
        *[new.alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.coalesce(F.size(all_lines), F.lit(0)).cast("long").alias("n_lines"),
        F.greatest(gone, F.lit(0)).cast("long").alias("n_removed"),
    )
