"""Genome FASTA to fixed-length chunks, as a distributed job.

Text splits are numbered in their file; inside a split lines keep their order. A
running base count per split plus carries over the (few) splits of a file give each
line its record and offset, whatever the size of the file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Longer lines are cut into pieces of this size before they are placed.
PIECE = 1024


def genome_lines(chunks: DataFrame, chunk_len: int, part_chunks: int | None = None) -> DataFrame:
    """Chunks as FASTA lines ``value``, in the order of ``chr``, ``part``, ``line``.

    A contig is one record, or with ``part_chunks`` a record ``>chr:offset`` for every so many chunks. Parts can then go to files of their
    own: nothing of a contig is gathered to write it.
    """
    part = F.expr(f"chunk div {part_chunks}") if part_chunks else F.lit(0).cast("bigint")
    rows = chunks.select("chr", part.alias("part"), F.col("chunk").alias("line"), F.col("seq").alias("value"))
    name = F.concat(F.lit(">"), "chr")
    if part_chunks:
        name = F.concat(name, F.lit(":"), (F.col("part") * part_chunks * chunk_len).cast("string"))
    headers = rows.select("chr", "part").distinct().select("chr", "part", F.lit(-1).cast("bigint").alias("line"), name.alias("value"))
    ordered = rows.unionByName(headers).repartitionByRange("chr", "part")  # a part is never cut
    return ordered.sortWithinPartitions("chr", "part", "line")


def read_genome_chunks(spark: SparkSession, path: str, chunk_len: int, offsets: bool = False) -> DataFrame:
    """Chunks ``chr, chunk, seq``: chunk ``i`` holds bases ``[i*chunk_len, (i+1)*chunk_len)``.

    With ``offsets`` a record ``>chr:n`` holds the bases of ``chr`` from the n-th on (0-based).
    """
    lines = _placed_lines(spark, path)
    if offsets:
        start = F.regexp_extract("chr", r":(\d+)$", 1).cast("bigint")
        lines = lines.select(F.regexp_replace("chr", r":\d+$", "").alias("chr"), (F.col("pos") + start).alias("pos"), "bases")
    first = F.floor(F.col("pos") / chunk_len).cast("bigint")
    last = F.floor((F.col("pos") + F.length("bases") - 1) / chunk_len).cast("bigint")
    lo = F.greatest(F.col("pos"), F.col("chunk") * chunk_len)
    hi = F.least(F.col("pos") + F.length("bases"), (F.col("chunk") + 1) * chunk_len)
    pieces = lines.withColumn("chunk", F.explode(F.sequence(first, last))).select(
        "chr",
        "chunk",
        lo.alias("lo"),
        F.substring("bases", (lo - F.col("pos") + 1).cast("int"), (hi - lo).cast("int")).alias("part"),
    )
    # A chunk has at most chunk_len pieces.
    parts = F.sort_array(F.collect_list(F.struct("lo", "part")))
    return pieces.groupBy("chr", "chunk").agg(F.array_join(F.transform(parts, lambda p: p["part"]), "").alias("seq"))


def _placed_lines(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path).select(
        F.trim("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
    )
    header = F.col("line").startswith(">")
    marked = (
        raw.where(F.length("line") > 0)
        .withColumn("name", F.when(header, F.regexp_extract("line", r"^>(\S+)", 1)))
        .withColumn("n", F.when(header, 0).otherwise(F.length("line")).cast("bigint"))
    )
    in_split = Window.partitionBy("file", "split").orderBy("row")
    before = F.coalesce(F.sum("n").over(in_split.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = (
        marked.withColumn("offset", before)
        .withColumn("opened", F.when(F.col("name").isNotNull(), F.struct("offset", "name")))
        .withColumn("record", F.last("opened", ignorenulls=True).over(in_split.rowsBetween(Window.unboundedPreceding, 0)))
    )
    by_split = Window.partitionBy("file").orderBy("split")
    earlier = by_split.rowsBetween(Window.unboundedPreceding, -1)
    carries = (
        local.groupBy("file", "split")
        .agg(F.sum("n").alias("total"), F.max_by("record", "row").alias("open"))
        .withColumn("base", F.coalesce(F.sum("total").over(earlier), F.lit(0)))
        .withColumn(
            "open",
            F.when(
                F.col("open").isNotNull(),
                F.struct((F.col("open.offset") + F.col("base")).alias("offset"), F.col("open.name").alias("name")),
            ),
        )
        .withColumn("carried", F.last("open", ignorenulls=True).over(earlier))
        .select("file", "split", "base", "carried")
    )
    started = F.coalesce(F.col("record.offset") + F.col("base"), F.col("carried.offset"))
    return (
        local.where(F.col("name").isNull())
        .join(carries, ["file", "split"])
        .select(
            F.coalesce("record.name", "carried.name").alias("chr"),
            (F.col("offset") + F.col("base") - started).alias("at"),
            F.posexplode(F.regexp_extract_all("line", F.lit("(.{1,%d})" % PIECE), F.lit(1))).alias("i", "bases"),
        )
        .select("chr", (F.col("at") + F.col("i") * PIECE).alias("pos"), "bases")
    )
