"""The whole analysis as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation

from cutsites.operators import counts as C
from cutsites.operators import qc, ratio, sequence, sites, tiers
from cutsites.profile import Profile
from cutsites.sources import bucketed, sinks, tables


@dataclass(frozen=True)
class Inputs:
    """Input tables; the sequence tables are optional (no mispriming filter without them).

    ``main_contigs`` lists the pairs (species, chr) to analyse. Sequences come from ``chunks``, or from files through their ``index``.
    """

    fragments: DataFrame
    spikeins: DataFrame
    sheet: DataFrame
    lengths: DataFrame | None = None
    main_contigs: DataFrame | None = None
    chunks: DataFrame | None = None
    chunk_len: int = 0
    oligos: DataFrame | None = None
    alias: DataFrame | None = None
    index: DataFrame | None = None


@dataclass(frozen=True)
class Candidates:
    """Every stage of the analysis; nothing runs until one of them is used."""

    sheet: DataFrame
    sizes: DataFrame
    design: DataFrame
    counts: DataFrame
    tiled: DataFrame
    best: DataFrame
    regions: DataFrame
    tiered: DataFrame
    peaks: DataFrame
    ratios: DataFrame
    info: DataFrame
    known: DataFrame | None = None


def call_sites(
    inputs: Inputs, profile: Profile, tiled: DataFrame, design: DataFrame, windows: Observation | None = None
) -> DataFrame:
    """Best reproducible site of each region, after the background, edge and sequence filters."""
    best = sites.best_sites(sites.reproducible_site_means(tiled, design, strict=True), profile.method_gap)
    if profile.control_type:
        best = sites.without_controls(best)
    if profile.edge_margin is not None and inputs.lengths is not None:
        best = sites.contig_edge_filter(best, inputs.lengths, profile.edge_margin)
    if inputs.oligos is not None and (inputs.chunks is not None or inputs.index is not None):
        best = sequence.mispriming_filter(
            best,
            inputs.chunks,
            inputs.lengths,
            inputs.oligos,
            profile.identity_limits,
            profile.flank,
            inputs.chunk_len,
            inputs.index,
            windows,
        )
    return best


def stages(
    inputs: Inputs, profile: Profile, counts_path: str | None = None, buckets: int | None = None, windows: Observation | None = None
) -> Candidates:
    """Wire all operators; see ``find_candidates`` for the final table alone.

    With ``counts_path`` (on shared storage) the counts are written there once, as a
    dataset partitioned by species, method, contig and strand, and read back: several
    results then share them without going back to the fragments. With ``buckets`` they are stored in the layout of
    the analysis instead, which then needs no shuffle of the counts. ``windows`` observes sequence windows (see ``mispriming_filter``).
    """
    sheet = C.recode_sheet(inputs.sheet, profile)
    sizes = C.library_sizes(inputs.fragments, inputs.spikeins, sheet)
    design = C.sample_design(sizes, sheet, profile)
    counts = C.count_end5(inputs.fragments, sheet, profile)
    if counts_path and not buckets:
        sinks.write_counts(counts, counts_path)
        counts = tables.read_counts_dataset(counts.sparkSession, counts_path)
    used = C.on_grid(counts, profile, inputs.main_contigs)
    if counts_path and buckets:
        tiled = bucketed.write_counts(used, counts_path, buckets, profile.control_type)
    else:
        tiled = sites.tile_counts(used, profile.control_type)
    best = call_sites(inputs, profile, tiled, design, windows)
    regions = tiers.merge_methods(best, profile)
    tiered = tiers.assign_tiers(regions, profile)
    if profile.hotspots and inputs.lengths is not None:
        rules = qc.hotspot_rules(counts.sparkSession, profile.hotspots)
        tiered = qc.outside_hotspots(tiered, inputs.lengths, rules)
    peaks = tiers.tier_sites(tiered, profile.methods)
    ratios = ratio.cleavage_ratio(tiled, peaks, profile.ratio_windows)
    info = ratio.tier_info(ratios, profile, inputs.alias)
    known = None
    if profile.known_sites:
        listed = qc.with_ids(peaks, profile.known_sites)
        own = ratio.cleavage_ratio(tiled, listed, profile.ratio_windows)
        known = qc.known_site_report(own, design, profile.known_sites)
    return Candidates(sheet, sizes, design, counts, tiled, best, regions, tiered, peaks, ratios, info, known)


def find_candidates(inputs: Inputs, profile: Profile, counts_path: str | None = None) -> DataFrame:
    """Tiered table of reproducible sites with their ratios."""
    return stages(inputs, profile, counts_path).info
