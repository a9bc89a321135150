"""Quality control: hotspots, position distributions, known sites, contingency tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutsites.functions import coordinates as co
from cutsites.functions.measures import cpm
from cutsites.operators.regions import TILE, TILE_BITS
from cutsites.profile import HotspotRule
from cutsites.schemas import HOTSPOT_RULES
from cutsites.session import local_table


def hotspot_rules(spark: SparkSession, rules: Sequence[HotspotRule]) -> DataFrame:
    rows = [(r.species, r.chr, r.lo, r.hi, r.lo_incl, r.hi_incl) for r in rules]
    return local_table(spark, rows, HOTSPOT_RULES)


def peak_positions(peaks: DataFrame, lengths: DataFrame) -> DataFrame:
    """Peaks (with the 0-based ``start`` of their region) as fractions of their contig."""
    return peaks.join(lengths, "chr", "left").withColumn("coor_per", co.fraction(F.col("start") + 1, F.col("length")))


def _within(value: Column, lo: Column, hi: Column, lo_incl: Column, hi_incl: Column) -> Column:
    above = lo.isNull() | (value > lo) | (lo_incl & (value == lo))
    below = hi.isNull() | (value < hi) | (hi_incl & (value == hi))
    return above & below


def _in_hotspot(rules: DataFrame) -> tuple[DataFrame, Column]:
    """Rules with prefixed columns, and whether a position lies in one; a rule without species holds for all."""
    r = rules.select(*[F.col(c).alias(f"_{c}") for c in rules.columns])
    inside = (
        (F.col("chr") == F.col("_chr"))
        & (F.col("_species").isNull() | (F.col("species") == F.col("_species")))
        & _within(F.col("coor_per"), F.col("_lo"), F.col("_hi"), F.col("_lo_incl"), F.col("_hi_incl"))
    )
    return r, inside


def hotspot_peaks(positions: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ids of peaks inside a hotspot."""
    r, inside = _in_hotspot(rules)
    return positions.join(r, inside, "left_semi").select("peak_id").distinct()


def hotspot_filter(ratios: DataFrame, excluded: DataFrame) -> DataFrame:
    """Rows whose peak is not excluded; rows without a peak id are kept."""
    return ratios.join(excluded.select("peak_id"), "peak_id", "left_anti")


def outside_hotspots(peaks: DataFrame, lengths: DataFrame, rules: DataFrame) -> DataFrame:
    """Peaks outside all hotspots, before anything is joined to them.

    Being in a hotspot depends on the region alone, so filtering the regions first
    gives the same final table as filtering their ratios and saves their range join.
    """
    positions = peak_positions(peaks, lengths)
    r, inside = _in_hotspot(rules)
    return positions.join(r, inside, "left_anti").drop("length", "coor_per")


def position_ecdf(positions: DataFrame, keys: Sequence[str], tile_bits: int = TILE_BITS) -> DataFrame:
    """Empirical distribution of relative positions per key.

    Distinct positions are counted first; running totals are then taken inside
    tiles and over the tile totals, so no task sorts a whole contig. One layout by
    tile serves both, so the input is evaluated once.
    """
    counted = (
        positions.where(F.col("coor_per").isNotNull())
        .select(*keys, "start", "coor_per", co.tile_of(F.col("start"), tile_bits).alias(TILE))
        .repartition(*keys, TILE)
        .groupBy(*keys, TILE, "start")
        .agg(F.count("*").alias("_n"), F.max("coor_per").alias("coor_per"))
    )
    by_tile = Window.partitionBy(*keys).orderBy(TILE)
    totals = (
        counted.groupBy(*keys, TILE)
        # Reading the same columns as the other user of the layout lets Spark shuffle it once.
        .agg(F.sum("_n").alias("_in_tile"), F.max("coor_per").alias("_top"))
        .where("_top > -1")
        .withColumn("_before", F.sum("_in_tile").over(by_tile.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_total", F.sum("_in_tile").over(Window.partitionBy(*keys)))
        .select(*keys, TILE, F.coalesce("_before", F.lit(0)).alias("_before"), "_total")
    )
    inside = Window.partitionBy(*keys, TILE).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    return (
        counted.withColumn("_running", F.sum("_n").over(inside))
        .join(totals, [*keys, TILE])
        .select(*keys, "coor_per", ((F.col("_before") + F.col("_running")) / F.col("_total")).alias("ecdf"))
    )


def with_ids(peaks: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Peaks of a short list of ids; filter with this before anything is joined to the peaks."""
    return peaks.where(F.col("peak_id").isin(*ids))


def known_site_report(ratios: DataFrame, design: DataFrame, ids: Sequence[str] | DataFrame) -> DataFrame:
    """Signal of known sites per sample, with its CPM, ordered for reading."""
    if isinstance(ids, DataFrame):
        chosen = ratios.join(ids.select("peak_id"), "peak_id", "left_semi")
    else:
        chosen = ratios.where(F.col("peak_id").isin(*ids))
    return (
        chosen.join(design.select("sample", "count_frag_sample", "sample_rep", "sample_type"), "sample", "left")
        .withColumn("cpm", cpm(F.col("cs"), F.col("count_frag_sample")))
        .select("tier", "peak_id", "sample", "library_method", "sample_rep", "sample_type", "cs", "cpm")
        .distinct()
        .orderBy(F.asc_nulls_last("peak_id"), F.asc_nulls_last("sample"))
    )


def contingency(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Two-way table of counts in long form (``rows``, ``columns``, ``n``): no value can be missed."""
    return df.groupBy(rows, columns).agg(F.count("*").alias("n"))


def position_contingency(positions: DataFrame, key: str, parts: int = 40) -> DataFrame:
    """Peaks by ``key`` and ``part`` of the contig (0 to ``parts`` - 1): where hotspots show. A peak at the very end is in the last part."""
    part = F.least(F.floor(F.col("coor_per") * parts), F.lit(parts - 1)).cast("bigint")
    return contingency(positions.where(F.col("coor_per").isNotNull()).withColumn("part", part), key, "part")
