"""Proof of the order in which text files were written, without sorting or gathering them.

A line's place is its number in its file. Places are compared within files, and files by their first and last lines: one row a file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def placed(lines: DataFrame) -> DataFrame:
    """Rows of a text source (``spark.read.csv``, ``text``) with ``file`` and ``place`` (its number in the file, from 1)."""
    marked = lines.select(
        "*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row")
    )
    in_file = Window.partitionBy("file").orderBy("_block", "_row")
    return marked.withColumn("place", F.row_number().over(in_file).cast("bigint")).drop("_block", "_row")


def _key(keys: Sequence[str]) -> Column:
    """Comparable key with NULL last."""
    return F.struct(*[c for k in keys for c in (F.col(k).isNull().alias(f"_n_{k}"), F.col(k))])


def file_order(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a file of ``placed`` rows: ``n_rows``, ``before`` (rows of earlier files), ``in_order`` (no line is before its predecessor) and
    ``after_previous`` (the first line is not before the last one of the file before)."""
    key, in_file = _key(keys), Window.partitionBy("file").orderBy("place")
    compared = rows.select("file", "place", key.alias("_key")).withColumn("_previous", F.lag("_key").over(in_file))
    files = compared.groupBy("file").agg(
        F.count("*").alias("n_rows"), F.min(F.coalesce(F.col("_previous") <= F.col("_key"), F.lit(True))).alias("in_order"),
        F.min_by("_key", "place").alias("_first"), F.max_by("_key", "place").alias("_last"),
    )
    by_name = Window.orderBy("file")  # one row a file
    return files.select(
        "file", "n_rows", F.coalesce(F.sum("n_rows").over(by_name.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), "in_order",
        F.coalesce(F.lag("_last").over(by_name) <= F.col("_first"), F.lit(True)).alias("after_previous"),
    )


def ranked(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with their ``rank`` over all files in the order of names, and whether their file is ``in_order`` and ``after_previous``."""
    rows = placed(lines)
    files = file_order(rows, keys).select("file", "before", "in_order", "after_previous")
    return rows.join(files, "file").withColumn("rank", F.col("before") + F.col("place")).drop("file", "place", "before")
