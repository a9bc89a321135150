"""Reproducible sites, their means, and the background and edge filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutsites.functions import coordinates as co
from cutsites.functions import keys as k
from cutsites.functions.measures import cpm, pick
from cutsites.operators.regions import TILE, TILE_BITS, best_per_region
from cutsites.schemas import SITE_KEYS

LAYOUT = (*SITE_KEYS, TILE)


def positioned_counts(counts: DataFrame, control_type: str | None = None, tile_bits: int = TILE_BITS) -> DataFrame:
    """Counts with a complete key, their tile, and whether they are control samples (``is_control``, if there are any)."""
    keys = [*SITE_KEYS, "end5", "sample"]
    mark = [f"coalesce(sample_type = '{control_type}', false) as is_control"] if control_type else []
    complete = counts.where(" and ".join(f"{c} is not null" for c in keys))
    # The default never applies; it makes the position (and so its tile and bin)
    # not nullable, and a join on them cannot add filters to one of the two users.
    return complete.selectExpr(*SITE_KEYS, "coalesce(end5, 0L) as end5", "sample", "count_end5", *mark).withColumn(
        TILE, F.expr(f"shiftright(end5 - 1, {tile_bits})")
    )


def tile_counts(counts: DataFrame, control_type: str | None = None, tile_bits: int = TILE_BITS) -> DataFrame:
    """Lay the counts out by (species, method, contig, strand, tile).

    Everything up to the first interval merge, and the points of the ratio join,
    work on this one layout. A tile holds a bounded number of positions and each
    position one row per sample, so a contig or site that dominates the fragments
    does not dominate a task. Rows without a complete key can never become a site.
    What depends on the sample alone is joined later, so both users of the layout read
    the same columns and Spark shuffles the counts once. Control samples travel along,
    marked by ``is_control``, instead of being read in a second pass.
    """
    return positioned_counts(counts, control_type, tile_bits).repartition(*LAYOUT)


def replicate_sums(tiled: DataFrame, design: DataFrame, strict: bool = False) -> DataFrame:
    """CPM of each position summed over the sample types of a replicate.

    ``n_design`` is the number of replicate and type combinations of the method.
    Control samples do not add to the sum (which is NULL if there is nothing else);
    ``in_control`` tells that the position occurs in one. With ``strict`` a sample without
    a library size is an error, found in the same pass; otherwise it adds nothing.
    """
    size = F.col("count_frag_sample")
    if strict:
        missing = F.raise_error(F.concat(F.lit("no library size for the sample "), F.col("sample")))
        size = F.when(size.isNull(), missing).otherwise(size)
    counted, flag = F.col("count_end5"), []
    if "is_control" in tiled.columns:
        counted = F.expr("if(is_control, null, count_end5)")
        flag = [F.max("is_control").alias("in_control")]
    return (
        tiled.join(design, "sample", "left")
        .groupBy(*LAYOUT, "end5", "sample_rep")
        .agg(
            F.sum(cpm(counted, size)).alias("cpm_end5_sum"),
            F.max("n_rep").alias("n_rep"),
            F.max(F.col("n_rep") * F.col("n_type")).alias("n_design"),
            *flag,
        )
    )


def reproducible_sites(tiled: DataFrame, design: DataFrame) -> DataFrame:
    """Replicate sums of positions seen in every replicate of their method."""
    at_site = Window.partitionBy(*LAYOUT, "end5")
    return (
        replicate_sums(tiled, design)
        .withColumn("_seen", F.count("cpm_end5_sum").over(at_site))
        .where("_seen >= n_rep and cpm_end5_sum is not null")
        .drop("_seen", "n_rep")
    )


def site_means(hits: DataFrame) -> DataFrame:
    """Mean CPM per site over the whole design (absent combinations count as 0)."""
    return (
        hits.groupBy(*LAYOUT, "end5")
        .agg(F.sum("cpm_end5_sum").alias("_sum"), F.max("n_design").alias("n_design"))
        .selectExpr(*LAYOUT, "end5", "_sum / n_design as cpm_end5_mean", "n_design")
    )


def reproducible_site_means(tiled: DataFrame, design: DataFrame, strict: bool = False) -> DataFrame:
    """``site_means(reproducible_sites(...))`` as plain aggregations, without a window.

    Also carries ``in_control`` where the layout holds control samples.
    """
    flag = ["in_control"] if "is_control" in tiled.columns else []
    return (
        replicate_sums(tiled, design, strict)
        .groupBy(*LAYOUT, "end5")
        .agg(
            F.count("cpm_end5_sum").alias("_seen"),
            F.sum("cpm_end5_sum").alias("_sum"),
            F.max("n_design").alias("n_design"),
            F.max("n_rep").alias("n_rep"),
            *[F.max(c).alias(c) for c in flag],
        )
        .where("_seen >= n_rep")
        .selectExpr(*LAYOUT, "end5", "_sum / n_design as cpm_end5_mean", "n_design", *flag)
    )


def site_bed(sites: DataFrame) -> DataFrame:
    """Sites as unit intervals with their composed contig and site keys."""
    return sites.select(
        k.contig_key().alias("chrom"),
        co.unit_start(F.col("end5")).alias("start"),
        F.col("end5").alias("end"),
        k.site_id().alias("id"),
        "cpm_end5_mean",
        "strand",
    )


def best_sites(sites: DataFrame, gap: int, tile_bits: int = TILE_BITS) -> DataFrame:
    """Best site of each merged region, within one method."""
    kept = ["cpm_end5_mean", "n_design", *[c for c in ("in_control",) if c in sites.columns]]
    best = pick("cpm_end5_mean", "string(end5)", kept)
    unit = sites.withColumn("start", co.unit_start(F.col("end5"))).withColumn("end", F.col("end5"))
    regions = best_per_region(unit, SITE_KEYS, gap, best, tiled=TILE in sites.columns, tile_bits=tile_bits)
    return regions.selectExpr(
        *SITE_KEYS,
        "start as region_start",
        "end as region_end",
        "bigint(best.tie) as end5",
        *[f"best.{c}" for c in kept],
    )


def control_sites(control_counts: DataFrame, n_rep: DataFrame | None = None) -> DataFrame:
    """Sites seen in any control sample, or (with ``n_rep``) in at least that many."""
    keys = [*SITE_KEYS, "end5"]
    if n_rep is None:
        return control_counts.select(*keys).distinct()
    return (
        control_counts.join(n_rep.withColumnRenamed("n", "n_rep"), ["species", "library_method"], "left")
        .groupBy(*keys)
        .agg(F.count("*").alias("_seen"), F.max("n_rep").alias("n_rep"))
        .where(F.col("_seen") >= F.col("n_rep"))
        .select(*keys)
    )


def background_filter(sites: DataFrame, background: DataFrame) -> DataFrame:
    """Remove sites that also occur in the background."""
    return sites.join(background, [*SITE_KEYS, "end5"], "left_anti")


def without_controls(best: DataFrame) -> DataFrame:
    """``background_filter`` for sites that carry ``in_control``: no join and no second scan."""
    return best.where("not in_control").drop("in_control")


def contig_edge_filter(sites: DataFrame, lengths: DataFrame, margin: int) -> DataFrame:
    """Keep regions more than ``margin`` bases away from both contig ends."""
    return (
        sites.join(lengths, "chr", "left")
        .where((F.col("region_start") > margin) & (F.col("length") - F.col("region_end") > margin))
        .drop("length")
    )
