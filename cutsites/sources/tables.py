"""Readers of the input tables, always with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutsites import schemas
from cutsites.functions import keys as k


def read_fragments(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Headerless fragment tables; one scan over all files."""
    return spark.read.schema(schemas.FRAGMENTS).option("sep", "\t").csv(paths)


def read_sample_sheet(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Sample sheet with a header; columns are taken by name, absent ones are NULL."""
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    if "method" in raw.columns and "library_method" not in raw.columns:
        raw = raw.withColumnRenamed("method", "library_method")
    return raw.select(
        *[
            (F.col(f.name) if f.name in raw.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schemas.SAMPLE_SHEET.fields
        ]
    )


def with_paths(sheet: DataFrame, root: str, kind: str) -> DataFrame:
    """Path of each sample's fragment table; ``kind`` is ``genome`` or ``spikeins``."""
    folder = k.without_comment(F.col("dataset"))
    name = F.concat(F.col("sample"), F.lit(f"_{kind}.bed"))
    return sheet.withColumn("path", k.joined(F.lit(root), folder, F.lit("results/04.bed"), name, sep="/"))


def read_sheet_fragments(spark: SparkSession, sheet: DataFrame, root: str, kind: str) -> DataFrame:
    """Fragments of all samples of the sheet (only the list of paths reaches the driver).

    A line without a path (no dataset or sample name) is an error: leaving it out would
    change the number of replicates.
    """
    rows = with_paths(sheet, root, kind).select("sample", "path").distinct().collect()
    if missing := sorted(str(r.sample) for r in rows if r.path is None):
        raise ValueError(f"no path for the samples {', '.join(missing)}: dataset or sample is empty")
    return read_fragments(spark, sorted({r.path for r in rows}))


def read_genome_lengths(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.GENOME_LENGTHS).option("sep", "\t").csv(path)


def read_alias_four(spark: SparkSession, path: str) -> DataFrame:
    """Four-column alias table; a missing accession is filled from the other archive."""
    raw = spark.read.schema(schemas.ALIAS_FOUR).option("sep", "\t").option("comment", "#").csv(path)
    return raw.withColumn("genbank", F.coalesce("genbank", "ENA"))


def read_alias_two(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ALIAS_TWO).option("sep", "\t").option("comment", "#").csv(path)


def read_contig_names(spark: SparkSession, path: str) -> DataFrame:
    """First column only (contig name) of a length or index table."""
    return spark.read.schema(schemas.ALIAS_ONE).option("sep", "\t").option("comment", "#").csv(path)


def without_alternates(alias: DataFrame) -> DataFrame:
    """Drop alternate loci."""
    return alias.where(~F.col("UCSC").rlike("alt$"))


def main_chromosomes(alias: DataFrame) -> DataFrame:
    """Numbered chromosomes, X and Y."""
    return alias.where(F.col("UCSC").rlike(r"chr\d+$") | F.col("UCSC").rlike("chr[XY]$"))


def alias_table(*aliases: DataFrame) -> DataFrame:
    """Accession to display name, over several alias tables."""
    table = aliases[0].select("UCSC", "genbank")
    for other in aliases[1:]:
        table = table.unionByName(other.select("UCSC", "genbank"))
    return table.select(F.col("genbank").alias("chr"), F.col("UCSC").alias("alias"))


def resolved_aliases(*aliases: DataFrame) -> DataFrame:
    """One display name (``alias``) for each accession (``chr``) out of several archives.

    The same pair may be listed more than once. Two names for an accession, or one name for two accessions, is an error: rows of the final
    table would be doubled, or contigs confused. Lines without an accession or a name say nothing.
    """
    pairs = alias_table(*aliases).where("chr is not null and alias is not null").distinct()

    def single(df: DataFrame, key: str, value: str) -> DataFrame:
        clash = F.raise_error(F.concat(F.lit(f"{key} "), F.col(key), F.lit(f" has two values of {value}: "), F.col("_a"), F.lit(", "), F.col("_b")))
        least = df.groupBy(key).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
        return least.select(key, F.when(F.col("_a") != F.col("_b"), clash).otherwise(F.col("_a")).alias(value))

    return single(single(pairs, "chr", "alias"), "alias", "chr").select("chr", "alias")


def files_of_sheet(spark: SparkSession, sheet: DataFrame, root: str, kind: str) -> DataFrame:
    """What was read for each sample of the sheet: ``path``, number of files and rows, total count; zeros where a planned path gave nothing."""
    planned = with_paths(sheet, root, kind).select("sample", "path").distinct()
    tail = r"([^/]+/results/04\.bed/[^/]+)(?:/[^/]*)?$"
    rows = read_sheet_fragments(spark, sheet, root, kind).select(F.col("_metadata.file_path").alias("file"), "count_frag")
    read = rows.groupBy(F.regexp_extract("file", tail, 1).alias("_tail")).agg(
        F.countDistinct("file").alias("n_files"), F.count("*").alias("n_rows"), F.sum("count_frag").alias("count_frag")
    )
    found = planned.withColumn("_tail", F.regexp_extract("path", tail, 1)).join(read, "_tail", "left").drop("_tail")
    return found.na.fill(0, ["n_files", "n_rows", "count_frag"])


def read_merged_bed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MERGED_BED).option("sep", "\t").csv(path)


def read_site_bed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SITE_BED).option("sep", "\t").csv(path)


def read_oligos(spark: SparkSession, fasta_path: str) -> DataFrame:
    """Oligos from (small) FASTA files, records named ``<a>_<method>_<length>``; wrapped lines are joined in order."""
    files = spark.read.text(fasta_path, wholetext=True)
    records = files.select(F.explode(F.split(F.concat(F.lit("\n"), "value"), r"[\r\n]+>")).alias("record"))
    records = records.where(F.trim("record") != "").select(
        F.regexp_extract("record", r"^(\S*)", 1).alias("name"),
        F.regexp_replace(F.regexp_replace("record", r"^[^\r\n]*", ""), r"\s+", "").alias("seq"),
    )
    return records.select(
        k.token(F.col("name"), 2, "_").alias("library_method"),
        k.token(F.col("name"), 3, "_").try_cast("bigint").alias("oligo_len"),
        "seq",
    )


def read_counts_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Counts written by ``write_counts``; equality filters on the key columns prune folders.

    The schema is explicit, so a contig named ``1`` stays text in any session.
    """
    return spark.read.schema(schemas.COUNTS).parquet(path)
