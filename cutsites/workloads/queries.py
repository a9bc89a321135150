"""Registered queries: each operator, and the whole analysis, over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cutsites import schemas
from cutsites.functions import coordinates as co
from cutsites.functions import keys as k
from cutsites.operators import counts as C
from cutsites.operators import qc, ratio, regions, sequence, sites, tiers
from cutsites.plans.find_candidates import Inputs, find_candidates, stages
from cutsites.profile import Profile
from cutsites.schemas import REGION_KEYS, SITE_KEYS
from cutsites.session import configure, local_table, scratch_path
from cutsites.sources import bucketed, fasta, fasta_index, order, sinks, tables
from cutsites.workloads import fixtures as fx


class Lab:
    """The steps of one run over one scale, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, control: bool = False, two: bool = False):
        self.spark = configure(spark)
        self.sf_dir = sf_dir
        self.control = control
        self.two = two
        one = fx.THREE if control else fx.FOUR
        self.profile: Profile = (fx.THREE_2S if control else fx.FOUR_2S) if two else one

    @cached_property
    def inputs(self) -> Inputs:
        return fx.inputs(self.spark, self.sf_dir, self.control, sequences=True, two=self.two)

    @cached_property
    def sheet(self) -> DataFrame:
        return C.recode_sheet(self.inputs.sheet, self.profile)

    @cached_property
    def sizes(self) -> DataFrame:
        return C.library_sizes(self.inputs.fragments, self.inputs.spikeins, self.sheet)

    @cached_property
    def design(self) -> DataFrame:
        return C.sample_design(self.sizes, self.sheet, self.profile)

    @cached_property
    def counts(self) -> DataFrame:
        return C.count_end5(self.inputs.fragments, self.sheet, self.profile)

    @cached_property
    def tiled(self) -> DataFrame:
        counts = C.on_grid(self.counts, self.profile, self.inputs.main_contigs)
        return sites.tile_counts(counts, self.profile.control_type)

    @cached_property
    def means(self) -> DataFrame:
        return sites.reproducible_site_means(self.tiled, self.design)

    @cached_property
    def best(self) -> DataFrame:
        best = sites.best_sites(self.means, self.profile.method_gap)
        return sites.without_controls(best) if self.control else best

    @cached_property
    def tiered(self) -> DataFrame:
        return tiers.assign_tiers(tiers.merge_methods(self.best, self.profile), self.profile)

    @cached_property
    def peaks(self) -> DataFrame:
        return tiers.tier_sites(self.tiered, self.profile.methods)

    def ratios(self, windows=None) -> DataFrame:
        return ratio.cleavage_ratio(self.tiled, self.peaks, windows or self.profile.ratio_windows)

    @cached_property
    def sequences(self) -> DataFrame:
        """Best sites with their longest upstream window."""
        return self.upstream(10 + self.profile.flank)

    def upstream(self, n: int) -> DataFrame:
        i = self.inputs
        return sequence.upstream_sequence(self.best, i.chunks, i.lengths, n, i.chunk_len)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Counts and design ---------------------------------------------------------------


def library_sizes(lab: Lab) -> DataFrame:
    return lab.sizes


def design_numbers(lab: Lab) -> DataFrame:
    reps = C.number_of(lab.sizes, lab.sheet, "sample_rep").withColumnRenamed("n", "n_rep")
    types = C.number_of(lab.sizes, lab.sheet, "sample_type").withColumnRenamed("n", "n_type")
    return reps.join(types, ["species", "library_method"])


def fragment_ends(lab: Lab) -> DataFrame:
    return C.normalize_fragments(lab.inputs.fragments)


def end5_counts_by_type(lab: Lab) -> DataFrame:
    return C.count_by_type(lab.inputs.fragments)


def end5_counts(lab: Lab) -> DataFrame:
    return lab.counts


def end5_counts_main_contigs(lab: Lab) -> DataFrame:
    """Deny list and table of (species, contig) pairs at once."""
    i = lab.inputs
    denied = replace(lab.profile, chr_deny=("chr5",))
    listed = i.lengths.where(F.col("chr") != "chr1").withColumn("species", F.lit("spA"))
    return C.on_grid(C.count_end5(i.fragments, lab.sheet, denied), denied, listed)


def end5_counts_grid(lab: Lab) -> DataFrame:
    """Counts on the contigs listed for the species of their sample."""
    return C.on_grid(lab.counts, lab.profile, lab.inputs.main_contigs)


def sample_crosstab(lab: Lab) -> DataFrame:
    """Samples with a size, by method and type."""
    seen = C.sample_details(lab.sheet).join(lab.sizes, "sample", "left_semi")
    return qc.contingency(seen, "library_method", "sample_type")


def spikein_cpm(lab: Lab) -> DataFrame:
    return _rounded(C.spikein_counts(lab.inputs.spikeins, lab.sheet, lab.design), "cpm_end5")


def samples_without_size(lab: Lab) -> DataFrame:
    """One sample's size is missing."""
    return C.samples_without_size(lab.counts, lab.sizes.where(F.col("sample") != "spA|TA|r2|N"))


# Sites and regions ---------------------------------------------------------------


def reproducible_sites(lab: Lab) -> DataFrame:
    hits = sites.reproducible_sites(lab.tiled, lab.design)
    return _rounded(hits, "cpm_end5_sum").select(*SITE_KEYS, "end5", "sample_rep", "cpm_end5_sum")


def site_means(lab: Lab) -> DataFrame:
    return _rounded(sites.site_bed(sites.site_means(sites.reproducible_sites(lab.tiled, lab.design))), "cpm_end5_mean")


def _unit(lab: Lab) -> DataFrame:
    return lab.means.select(
        *SITE_KEYS, co.unit_start(F.col("end5")).alias("start"), F.col("end5").alias("end"), k.site_id().alias("id")
    )


def merge_d5_regions(lab: Lab) -> DataFrame:
    return regions.merge_regions(_unit(lab), SITE_KEYS, 5, [regions.count_members()])


def merge_d5_members(lab: Lab) -> DataFrame:
    return regions.region_members(_unit(lab), SITE_KEYS, 5).select(*SITE_KEYS, "region_start", "region_end", "id")


def merge_d5_id_lists(lab: Lab) -> DataFrame:
    """Ids of each region, one row per id, with their number."""
    members = regions.region_members(_unit(lab), SITE_KEYS, 5)
    sizes = regions.merge_regions(_unit(lab), SITE_KEYS, 5, [regions.count_members("n_ids")])
    sizes = sizes.withColumnsRenamed({"start": "region_start", "end": "region_end"})
    return members.join(sizes, [*SITE_KEYS, "region_start", "region_end"]).drop("start", "end")


def merge_d60_members(lab: Lab) -> DataFrame:
    """Regions of thousands of positions."""
    return regions.region_members(_unit(lab), SITE_KEYS, 60).select(*SITE_KEYS, "region_start", "region_end", "id")


def fragment_islands(lab: Lab) -> DataFrame:
    """Merge of long, nested intervals: fragment coverage per sample."""
    aggs = [regions.count_members("n_fragments"), regions.Agg("count_frag", "sum", "count_frag")]
    return regions.merge_regions(lab.inputs.fragments, ["sample", "chr", "strand"], 0, aggs)


def region_best_site(lab: Lab) -> DataFrame:
    return _rounded(lab.best, "cpm_end5_mean").drop("n_design").withColumn("id", k.site_id())


def site_windows(lab: Lab) -> DataFrame:
    """Upstream extension, clipped to the contig."""
    wide = sequence.upstream_windows(lab.best, lab.inputs.lengths, 250)
    return wide.select(k.site_id().alias("id"), "strand", "start", "end")


def site_id_parts(lab: Lab) -> DataFrame:
    """Composite ids split back into typed columns, by position, token and last token."""
    ids = lab.best.select(k.site_id().alias("id"), k.contig_key().alias("contig"))
    names = {"species": "string", "chr": "string", "strand": "string", "end5": "bigint", "library_method": "string"}
    return ids.select(
        "id",
        *k.split_into(F.col("id"), names),
        k.token(F.col("contig"), 3).alias("contig_chr"),
        k.last_token(F.col("id")).alias("last"),
        k.token(F.col("id"), 9).alias("absent"),
    )


# Methods and tiers ---------------------------------------------------------------


def tailing_merged(lab: Lab) -> DataFrame:
    return tiers.merge_pair(lab.best, ("TA", "TC"), 5).select(*REGION_KEYS, "start", "end", "n_sites")


def tailing_combined(lab: Lab) -> DataFrame:
    return tiers.pair_combined(tiers.merge_pair(lab.best, ("TA", "TC"), 5), ("TA", "TC"))


def tailing_single(lab: Lab) -> DataFrame:
    return tiers.pair_single(tiers.merge_pair(lab.best, ("TA", "TC"), 5), ("TA", "TC"))


def methods_merged_long(lab: Lab) -> DataFrame:
    long = tiers.regions_to_long(tiers.merge_methods(lab.best, lab.profile), lab.profile.methods)
    return _rounded(long, "cpm_end5_mean").drop("n_sites", "n_design")


def tier_peaks(lab: Lab) -> DataFrame:
    return _rounded(lab.peaks, "cpm_end5_mean").drop("n_design", "id")


def tier_region_bounds(lab: Lab) -> DataFrame:
    return lab.tiered.select("tier", "peak_id", "start", "end")


def tier_by_method(lab: Lab) -> DataFrame:
    return qc.contingency(lab.peaks, "tier", "library_method")


# Ratios --------------------------------------------------------------------------


def window_regions(lab: Lab) -> DataFrame:
    return ratio.window_regions(lab.peaks, 100)


def range_join_window(lab: Lab) -> DataFrame:
    pairs = ratio.counts_in_windows(lab.tiled, lab.peaks, [fx.GRID[3]])
    rel = co.relative_position(F.col("end5"), F.col("peak"), F.col("strand"))
    return pairs.select("peak_id", "peak", "library_method", "sample", "end5", "count_end5", rel.alias("rel_coor"))


_RATIO = ["tier", "peak_id", *SITE_KEYS, "peak", "sample", "ratio_type", "cs", "other", "ratio"]


def cleavage_ratio_u100(lab: Lab) -> DataFrame:
    return _rounded(lab.ratios(), "ratio").select(*_RATIO)


def cleavage_ratio_grid(lab: Lab) -> DataFrame:
    return _rounded(lab.ratios(fx.GRID), "ratio").select(*_RATIO)


def ratio_hier_mean(lab: Lab) -> DataFrame:
    designed = ratio.with_design(lab.ratios(fx.GRID), lab.design)
    return _rounded(ratio.hierarchical_mean(designed, lab.profile.method_divisor), "ratio_mean")


def ratio_pivot(lab: Lab) -> DataFrame:
    means = ratio.hierarchical_mean(lab.ratios(fx.GRID), lab.profile.method_divisor)
    tags = [w.tag for w in fx.GRID]
    return _rounded(ratio.ratio_columns(means, tags), *[f"ratio_{t}" for t in tags])


def peak_pivot(lab: Lab) -> DataFrame:
    return ratio.peak_columns(lab.ratios(), lab.profile.methods)


def _info(df: DataFrame) -> DataFrame:
    return _rounded(df, *[c for c in df.columns if c.startswith("ratio_")])


def tier_info(lab: Lab) -> DataFrame:
    return _info(ratio.tier_info(lab.ratios(), lab.profile))


def alias_recode(lab: Lab) -> DataFrame:
    """Final table with display names of contigs; unmatched names are kept."""
    return _info(ratio.tier_info(lab.ratios(), lab.profile, fx.alias(lab.spark)))


# Sequences -----------------------------------------------------------------------


def genome_chunks(lab: Lab) -> DataFrame:
    return lab.inputs.chunks


def _with_id(df: DataFrame) -> DataFrame:
    return df.select(k.site_id().alias("id"), "start", "end", "seq")


def upstream_seq_incl(lab: Lab) -> DataFrame:
    """Ten upstream bases and the site base."""
    return _with_id(lab.upstream(10))


def upstream_seq_excl(lab: Lab) -> DataFrame:
    """Nine upstream bases and the site base."""
    return _with_id(lab.upstream(9))


def oligo_identity(lab: Lab) -> DataFrame:
    identities = sequence.oligo_identities(lab.sequences, lab.inputs.oligos, lab.profile.flank)
    return identities.select(k.site_id().alias("id"), "oligo_len", "identical_base_num")


def identity_intersect(lab: Lab) -> DataFrame:
    """Ids below the limit at both oligo lengths, as an intersection."""
    ids = oligo_identity(lab)
    passed = [sequence.below_limit(ids, n, m).select("id") for n, m in lab.profile.identity_limits.items()]
    return passed[0].intersect(passed[1])


def _misprimed(lab: Lab) -> DataFrame:
    i, p = lab.inputs, lab.profile
    return sequence.mispriming_filter(
        lab.best, i.chunks, i.lengths, i.oligos, p.identity_limits, p.flank, i.chunk_len
    )


def mispriming_filter(lab: Lab) -> DataFrame:
    return _misprimed(lab).select(k.site_id().alias("id"))


def fasta_roundtrip(lab: Lab) -> DataFrame:
    """Upstream windows written as FASTA text and scanned back as chunks."""
    path = scratch_path(lab.spark, "fasta")
    sequence.site_fasta(lab.sequences).write.text(path)
    chunks = fasta.read_genome_chunks(lab.spark, path, fx.CHUNK_LEN)
    return chunks.select(k.without_strand_suffix(F.col("chr")).alias("id"), "chunk", "seq")


def truncated_windows(lab: Lab) -> DataFrame:
    """Sites moved to the contig's start: windows too short to compare, counted while the filter's result is written."""
    i, p = lab.inputs, lab.profile
    seen = Observation("windows")
    near = lab.best.withColumn("end5", F.col("end5") - 195)
    kept = sequence.mispriming_filter(near, i.chunks, i.lengths, i.oligos, p.identity_limits, p.flank, i.chunk_len, observation=seen)
    path = scratch_path(lab.spark, "kept")
    kept.write.parquet(path)
    n_kept = lab.spark.read.schema(kept.schema).parquet(path).count()
    rows = [(n, seen.get[f"truncated_{n}"], seen.get["n_sites"], n_kept) for n in p.identity_limits]
    return local_table(lab.spark, rows, schemas.WINDOW_METRICS)


# Background, edges, hotspots, controls --------------------------------------------


def background_any(lab: Lab) -> DataFrame:
    control = C.split_controls(lab.counts, "endo")[0]
    return sites.control_sites(control).select(k.site_id().alias("site_id"))


def background_all(lab: Lab) -> DataFrame:
    control = C.split_controls(lab.counts, "endo")[0]
    n_rep = C.number_of(lab.sizes, lab.sheet, "sample_rep", "endo")
    return sites.control_sites(control, n_rep).select(k.site_id().alias("site_id"))


def background_filtered(lab: Lab) -> DataFrame:
    """Control samples held out, then used as a background table."""
    control, used = C.split_controls(lab.counts, "endo")
    means = sites.reproducible_site_means(sites.tile_counts(used), lab.design)
    kept = sites.background_filter(sites.best_sites(means, lab.profile.method_gap), control)
    return _rounded(kept, "cpm_end5_mean").drop("n_design").withColumn("id", k.site_id())


def contig_edge(lab: Lab) -> DataFrame:
    return region_best_site_of(sites.contig_edge_filter(lab.best, lab.inputs.lengths, 300))


def region_best_site_of(best: DataFrame) -> DataFrame:
    return best.select(k.site_id().alias("id"), "region_start", "region_end")


def _rules(lab: Lab) -> DataFrame:
    return qc.hotspot_rules(lab.spark, fx.HOTSPOTS)


def _positions(lab: Lab) -> DataFrame:
    return qc.peak_positions(lab.peaks, lab.inputs.lengths)


def hotspot_peaks(lab: Lab) -> DataFrame:
    return qc.hotspot_peaks(_positions(lab), _rules(lab))


def hotspot_anti(lab: Lab) -> DataFrame:
    kept = qc.hotspot_filter(lab.ratios(), qc.hotspot_peaks(_positions(lab), _rules(lab)))
    return _rounded(kept, "ratio").select(*_RATIO)


def position_ecdf(lab: Lab) -> DataFrame:
    keys = ["species", "chr", "library_method"]
    return _rounded(qc.position_ecdf(_positions(lab), keys), "coor_per", "ecdf")


def position_contingency(lab: Lab) -> DataFrame:
    """Peaks by contig and fortieth of it, from which hotspots are read."""
    return qc.position_contingency(_positions(lab), "chr")


def known_sites(lab: Lab) -> DataFrame:
    """Report on four regions given by id, chosen before the range join."""
    listed = qc.with_ids(lab.peaks, fx.KNOWN)
    ratios = ratio.cleavage_ratio(lab.tiled, listed, lab.profile.ratio_windows)
    return _rounded(qc.known_site_report(ratios, lab.design, fx.KNOWN), "cpm")


# Whole analyses ------------------------------------------------------------------


def tier_info_full(lab: Lab) -> DataFrame:
    """With the mispriming filter and hotspots."""
    return _info(find_candidates(lab.inputs, replace(lab.profile, hotspots=fx.HOTSPOTS)))


def tier_info_3m_full(lab: Lab) -> DataFrame:
    """Three methods with background, edge and mispriming filters and hotspots."""
    return _info(find_candidates(lab.inputs, replace(lab.profile, hotspots=fx.HOTSPOTS, edge_margin=100)))


def known_sites_full(lab: Lab) -> DataFrame:
    """The report on known sites out of the whole analysis."""
    return _rounded(stages(lab.inputs, replace(lab.profile, known_sites=fx.KNOWN)).known, "cpm")


def cleavage_ratio_bucketed(lab: Lab) -> DataFrame:
    """The analysis out of bucketed counts, opened again by path: no shuffle of the counts."""
    path = scratch_path(lab.spark, "counts")
    bucketed.write_counts(C.on_grid(lab.counts, lab.profile, lab.inputs.main_contigs), path, 16)
    lab.tiled = bucketed.read_counts(lab.spark, path, 16)
    return cleavage_ratio_u100(lab)


def _sheet_inputs(lab: Lab) -> tuple[DataFrame, str]:
    folder = scratch_path(lab.spark, "sheet")
    fx.write_sheet_files(lab.spark, lab.inputs, folder)
    sheet = tables.read_sample_sheet(lab.spark, f"{folder}/sheet")
    return sheet.where("coalesce(exclude, 'N') <> 'Y'"), folder  # an excluded line has no files


def sheet_files(lab: Lab) -> DataFrame:
    """Rows read for each line of a sheet file."""
    sheet, folder = _sheet_inputs(lab)
    kinds = [tables.files_of_sheet(lab.spark, sheet, folder, kind).withColumn("kind", F.lit(kind)) for kind in ("genome", "spikeins")]
    rows = kinds[0].unionByName(kinds[1])
    return rows.select("kind", F.translate(F.expr("substring(sample, 3)"), "_", "|").alias("sample"), "n_rows", "count_frag", (F.col("n_files") > 0).alias("has_files"))


def tier_info_from_sheet(lab: Lab) -> DataFrame:
    """From a sheet file to the final table: paths resolved, fragments read from them."""
    sheet, folder = _sheet_inputs(lab)
    frags, spikes = (tables.read_sheet_fragments(lab.spark, sheet, folder, kind) for kind in ("genome", "spikeins"))
    return _info(find_candidates(Inputs(frags, spikes, sheet, lab.inputs.lengths), lab.profile))


def tier_info_multi_ucsc(lab: Lab) -> DataFrame:
    """The analysis of two species with display names out of alias files of two archives."""
    folder = scratch_path(lab.spark, "alias")
    fx.write_alias_files(lab.spark, lab.inputs.lengths, folder)
    four = tables.main_chromosomes(tables.without_alternates(tables.read_alias_four(lab.spark, f"{folder}/four")))
    names = tables.resolved_aliases(four, tables.read_alias_two(lab.spark, f"{folder}/two"))
    return _info(find_candidates(replace(lab.inputs, alias=names), replace(lab.profile, hotspots=fx.HOTSPOTS)))


# Sources and sinks ---------------------------------------------------------------


def partition_roundtrip(lab: Lab) -> DataFrame:
    path = scratch_path(lab.spark, "counts")
    sinks.write_counts(lab.counts, path)
    return tables.read_counts_dataset(lab.spark, path)


def bed_roundtrip(lab: Lab) -> DataFrame:
    path = scratch_path(lab.spark, "bed")
    sinks.write_bed(sites.site_bed(lab.means), path)
    return _rounded(tables.read_site_bed(lab.spark, path), "cpm_end5_mean")


def fragment_roundtrip(lab: Lab) -> DataFrame:
    path = scratch_path(lab.spark, "fragments")
    sinks.write_bed(lab.inputs.fragments, path, order=())
    return tables.read_fragments(lab.spark, path)


def merged_bed_roundtrip(lab: Lab) -> DataFrame:
    """Merged regions with their ids as text, read back and unnested to one row per id."""
    path = scratch_path(lab.spark, "merged")
    lists = merge_d5_members(lab).select(
        k.contig_key().alias("chr"), F.col("region_start").alias("start"), F.col("region_end").alias("end"), "strand", "id"
    )
    sinks.write_bed(lists, path, order=("chr", "start"))
    return regions.split_ids(tables.read_merged_bed(lab.spark, path))


def lengths_roundtrip(lab: Lab) -> DataFrame:
    path = scratch_path(lab.spark, "lengths")
    sinks.write_bed(lab.inputs.lengths, path, order=("chr",))
    return tables.read_genome_lengths(lab.spark, path)


def genome_roundtrip(lab: Lab) -> DataFrame:
    """The genome written as wrapped FASTA, a record for 16 chunks with its offset, scanned back into longer chunks over several splits."""
    path = scratch_path(lab.spark, "genome")
    sinks.write_genome(lab.inputs.chunks, path, fx.CHUNK_LEN, part_chunks=16)
    return fasta.read_genome_chunks(lab.spark, path, 3 * fx.CHUNK_LEN, offsets=True)


def upstream_seq_indexed(lab: Lab) -> DataFrame:
    """``upstream_seq_incl`` out of FASTA text, reading only the byte ranges that hold a window."""
    path = scratch_path(lab.spark, "genome")
    sinks.write_genome(lab.inputs.chunks, path, fx.CHUNK_LEN)
    index = fasta_index.build_index(lab.spark, path, range_bytes=1000)
    return _with_id(sequence.upstream_sequence_indexed(lab.best, index, lab.inputs.lengths, 10, range_bytes=1000))


def upstream_seq_blocks(lab: Lab) -> DataFrame:
    """``upstream_seq_incl`` out of block-compressed FASTA."""
    lines = fasta.genome_lines(lab.inputs.chunks, fx.CHUNK_LEN)
    files = fasta_index.write_blocked(lines, scratch_path(lab.spark, "genome"))
    index = fasta_index.build_index(lab.spark, files)
    return _with_id(sequence.upstream_sequence_indexed(lab.best, index, lab.inputs.lengths, 10))


def report_roundtrip(lab: Lab) -> DataFrame:
    """The report on known sites as CSV and as Parquet, read back."""
    report, path = known_sites(lab), scratch_path(lab.spark, "report")
    sinks.write_report(report, f"{path}/csv")
    sinks.write_parquet(report, f"{path}/parquet")
    text = lab.spark.read.schema(report.schema).option("header", True).csv(f"{path}/csv")
    return text.withColumn("form", F.lit("csv")).unionByName(lab.spark.read.parquet(f"{path}/parquet").withColumn("form", F.lit("parquet")))


def tsv_roundtrip(lab: Lab) -> DataFrame:
    path = scratch_path(lab.spark, "tiers")
    bounds = tier_region_bounds(lab)
    sinks.write_tsv(bounds, path)
    return lab.spark.read.schema(bounds.schema).option("header", True).option("sep", "\t").csv(path)


_FEW_LINES = "spark.sql.files.maxRecordsPerFile"


def _in_small_files(lab: Lab, write: Callable[[], None]) -> None:
    """Let Spark begin a new file after 300 lines, so that order over files is seen."""
    lab.spark.conf.set(_FEW_LINES, "300")
    try:
        write()
    finally:
        lab.spark.conf.unset(_FEW_LINES)


def bed_order(lab: Lab) -> DataFrame:
    """Rank of each line of a sorted BED over all its files, and whether files are in order in themselves and among each other."""
    path, keys = scratch_path(lab.spark, "bed"), ["chrom", "start", "id"]
    _in_small_files(lab, lambda: sinks.write_bed(sites.site_bed(lab.best), path, order=keys))
    lines = lab.spark.read.schema(schemas.SITE_BED).option("sep", "\t").csv(path)
    return order.ranked(lines, keys).select("id", "rank", "in_order", "after_previous")


def report_order(lab: Lab) -> DataFrame:
    """Rank of each line of a sorted report, rows without a value last."""
    path, keys = scratch_path(lab.spark, "report"), ["peak_id", "sample"]
    ratios = lab.ratios().select("peak_id", "sample", "library_method", "cs")
    rows = ratios.groupBy(*keys).agg(F.sum("cs").alias("cs"))
    _in_small_files(lab, lambda: sinks.write_tsv(rows, path, keys))
    lines = lab.spark.read.schema(rows.schema).option("header", True).option("sep", "\t").csv(path)
    return order.ranked(lines, keys).select(*keys, "rank", "in_order", "after_previous")


def split_order(lab: Lab) -> DataFrame:
    """Files of each method's folder: rows, and whether they are in order."""
    path, keys = scratch_path(lab.spark, "methods"), ["chr", "start"]
    bed = lab.best.select("library_method", "chr", co.unit_start(F.col("end5")).alias("start"), F.col("end5").alias("end"), "strand")
    _in_small_files(lab, lambda: sinks.write_split(bed, path, "library_method", keys))
    lines = lab.spark.read.schema("chr string, start bigint, end bigint, strand string, library_method string").option("sep", "\t").csv(path)
    return order.ranked(lines, ["library_method", *keys]).groupBy("library_method").agg(
        F.count("*").alias("n_rows"), F.min("in_order").alias("in_order"), F.min("after_previous").alias("after_previous")
    )


def split_by_method(lab: Lab) -> DataFrame:
    path = scratch_path(lab.spark, "methods")
    bed = lab.best.select(
        "library_method", "chr", co.unit_start(F.col("end5")).alias("start"), F.col("end5").alias("end"), "strand"
    )
    sinks.write_split(bed, path, "library_method", ["chr", "start"])
    schema = "chr string, start bigint, end bigint, strand string, library_method string"
    return lab.spark.read.schema(schema).option("sep", "\t").csv(path)


FOUR_METHOD = [
    library_sizes,
    design_numbers,
    fragment_ends,
    end5_counts_by_type,
    end5_counts,
    end5_counts_main_contigs,
    sample_crosstab,
    spikein_cpm,
    samples_without_size,
    reproducible_sites,
    site_means,
    merge_d5_regions,
    merge_d5_members,
    merge_d5_id_lists,
    merge_d60_members,
    fragment_islands,
    region_best_site,
    site_windows,
    site_id_parts,
    tailing_merged,
    tailing_combined,
    tailing_single,
    methods_merged_long,
    tier_peaks,
    tier_region_bounds,
    tier_by_method,
    window_regions,
    range_join_window,
    cleavage_ratio_u100,
    cleavage_ratio_grid,
    ratio_hier_mean,
    ratio_pivot,
    peak_pivot,
    tier_info,
    alias_recode,
    genome_chunks,
    upstream_seq_incl,
    upstream_seq_excl,
    oligo_identity,
    identity_intersect,
    mispriming_filter,
    fasta_roundtrip,
    contig_edge,
    hotspot_peaks,
    hotspot_anti,
    position_ecdf,
    known_sites,
    tier_info_full,
    partition_roundtrip,
    bed_roundtrip,
    fragment_roundtrip,
    merged_bed_roundtrip,
    lengths_roundtrip,
    genome_roundtrip,
    upstream_seq_indexed,
    upstream_seq_blocks,
    truncated_windows,
    position_contingency,
    known_sites_full,
    cleavage_ratio_bucketed,
    sheet_files,
    tier_info_from_sheet,
    bed_order,
    report_order,
    split_order,
    report_roundtrip,
    tsv_roundtrip,
    split_by_method,
]
THREE_METHOD = {
    "background_any": background_any,
    "background_all": background_all,
    "background_filtered": background_filtered,
    "region_best_site_3m": region_best_site,
    "reproducible_sites_3m": reproducible_sites,
    "cleavage_ratio_3m": cleavage_ratio_u100,
    "tier_info_3m": tier_info,
    "tier_info_3m_full": tier_info_3m_full,
}


#: Two species on one genome: with control samples or without.
TWO_SPECIES = {
    "library_sizes_2s": (library_sizes, False),
    "design_numbers_2s": (design_numbers, False),
    "end5_counts_2s": (end5_counts, False),
    "end5_counts_grid_2s": (end5_counts_grid, False),
    "spikein_cpm_2s": (spikein_cpm, False),
    "region_best_site_2s": (region_best_site, False),
    "background_all_2s": (background_all, True),
    "tier_info_2s": (tier_info, False),
    "tier_info_multi": (tier_info_full, False),
    "tier_info_multi_ucsc": (tier_info_multi_ucsc, False),
    "tier_info_3m_2s": (tier_info, True),
}


def _bind(step: Callable[[Lab], DataFrame], control: bool, two: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return step(Lab(spark, sf_dir, control, two))

    run.__doc__ = step.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    registry = {step.__name__: _bind(step, False) for step in FOUR_METHOD}
    registry.update({name: _bind(step, True) for name, step in THREE_METHOD.items()})
    registry.update({name: _bind(step, control, True) for name, (step, control) in TWO_SPECIES.items()})
    return registry
