"""Writers: partitioned datasets, BED and TSV text, one folder per key. None replaces what already lies at its path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutsites.schemas import SITE_KEYS
from cutsites.sources.fasta import genome_lines


def write_counts(counts: DataFrame, path: str) -> None:
    """Counts as Parquet partitioned by species, method, contig and strand.

    Rows are first laid out by key and position range, so that a folder is written
    by few tasks while a contig that holds most rows still spreads over many.
    """
    spread = F.shiftright("end5", 20)
    (
        counts.repartition(*SITE_KEYS, spread)
        .write
        .partitionBy(*SITE_KEYS)
        .parquet(path)
    )


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def sorted_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Global order with NULL last; only sinks sort."""
    return df.orderBy(*[F.asc_nulls_last(c) for c in keys])


def write_tsv(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """Tab-separated text with a header."""
    out = sorted_by(df, order) if order else df
    out.write.option("header", True).option("sep", "\t").csv(path)


def write_bed(df: DataFrame, path: str, order: Sequence[str] = ("chrom", "start")) -> None:
    """Headerless tab-separated intervals, sorted by contig and start."""
    out = sorted_by(df, order) if order else df
    out.write.option("header", False).option("sep", "\t").csv(path)


def write_split(df: DataFrame, path: str, key: str, order: Sequence[str]) -> None:
    """One folder per value of ``key``, rows in order within each file.

    Range partitioning on key and order keeps files ordered and splits large keys.
    """
    (
        df.repartitionByRange(*[F.asc_nulls_last(c) for c in (key, *order)])
        .sortWithinPartitions(*[F.asc_nulls_last(c) for c in (key, *order)])
        .write
        .partitionBy(key)
        .option("sep", "\t")
        .csv(path)
    )


def write_genome(chunks: DataFrame, path: str, chunk_len: int, part_chunks: int | None = None) -> None:
    """Chunks as wrapped FASTA text, range-partitioned by contig (and part of it, see ``fasta.genome_lines``)."""
    genome_lines(chunks, chunk_len, part_chunks).select("value").write.text(path)


def write_report(df: DataFrame, path: str) -> None:
    """Report table as CSV with a header."""
    df.write.option("header", True).csv(path)
