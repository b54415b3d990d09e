"""Which files of a data folder may be read, as predicates over paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROKEN, LOCK, COMPLETED = ".broken", ".lock", ".completed"


def _ends(path: Column, suffix: str) -> Column:
    return F.lower(path).endswith(suffix)


def is_data(path: Column) -> Column:
    """Neither broken nor a lock; suffixes in any case."""
    return ~_ends(path, BROKEN) & ~_ends(path, LOCK)


def is_completed(path: Column) -> Column:
    return _ends(path, COMPLETED)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def ready(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """The data files that no writer holds: of each folder all but the alphabetically last one, and
    every completed one. In name order within a folder by `turn`."""
    files = paths.where(is_data(F.col(path_col))).withColumn("folder", folder(F.col(path_col)))
    open_ = files.where(~is_completed(F.col(path_col)))
    newest = open_.groupBy("folder").agg(F.max(path_col).alias("newest"))
    out = files.join(newest, "folder", "left")
    out = out.where(is_completed(F.col(path_col)) | (F.col(path_col) != F.col("newest")))
    turn = F.row_number().over(Window.partitionBy("folder").orderBy(path_col))
    return out.select(path_col, "folder", turn.alias("turn"))
