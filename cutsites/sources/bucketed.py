"""Counts stored in the layout of the analysis, so that reading them again needs no shuffle.

Buckets are hashed on (species, method, contig, strand, tile) and sorted by position. Site calls and the ratio join cluster on these columns, so
Spark takes a bucket as a partition. The number of buckets is fixed when writing: choose it so that a bucket is a few hundred MB.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cutsites.operators.sites import LAYOUT, positioned_counts


def write_counts(counts: DataFrame, path: str, buckets: int, control_type: str | None = None) -> DataFrame:
    """Write counts below ``path`` and return them as ``tile_counts`` would, read from there."""
    name = f"counts_{uuid.uuid4().hex}"
    # Rows of a bucket meet in one task, which writes one file for it.
    laid = positioned_counts(counts, control_type).repartition(buckets, *LAYOUT)
    laid.write.format("parquet").bucketBy(buckets, *LAYOUT).sortBy("end5").option("path", path).saveAsTable(name)
    return _opened(counts.sparkSession, name)


def read_counts(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """Counts that ``write_counts`` wrote below ``path`` with as many buckets, in any session."""
    name = f"counts_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"create table {name} ({columns}) using parquet clustered by ({', '.join(LAYOUT)}) sorted by (end5) into {buckets} buckets location '{place}'")
    return _opened(spark, name)


def _opened(spark: SparkSession, name: str) -> DataFrame:
    """The table's rows; its name is given up, its files stay."""
    rows = spark.table(name)
    spark.sql(f"drop table {name}")
    return rows
