"""Library sizes, 5'-end counts and the experimental design."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutsites.functions import coordinates as co
from cutsites.functions import keys as k
from cutsites.functions.measures import cpm
from cutsites.profile import Profile
from cutsites.session import BROADCAST_ROWS, broadcast_if_small

def recode_sheet(sheet: DataFrame, profile: Profile) -> DataFrame:
    """Normalise the sample sheet: short method and replicate names, composed sample key.

    Rows flagged for exclusion are dropped when the profile says so (a NULL flag keeps the row).
    A sheet is a few lines: as one partition, its distinct projections need no shuffle.
    """
    if profile.drop_excluded:
        sheet = sheet.where(~F.coalesce(F.col("exclude") == "Y", F.lit(False)))
    species = F.lit(profile.species) if profile.species else F.col("species")
    code = k.case_match(F.col("species"), profile.species_codes) if profile.species_codes else F.col("species")
    rep = k.case_match(F.col("sample_rep"), profile.rep_names) if profile.rep_names else F.col("sample_rep")
    return (
        sheet.withColumn("species", species)
        .withColumn("library_method", k.recode(F.col("library_method"), profile.method_names))
        .withColumn("sample_rep", rep)
        .withColumn("sample_recode", k.joined(code, "library_method", "sample_rep", "sample_type"))
        .select("species", "sample", "sample_recode", "library_method", "sample_rep", "sample_type", "dataset")
        .coalesce(1)
    )


def library_sizes(fragments: DataFrame, spikeins: DataFrame, sheet: DataFrame) -> DataFrame:
    """Total fragment count per recoded sample over genome and spike-ins.

    Nothing is filtered out first. Samples missing from the sheet keep their raw
    name. The sheet joins map-side, so one partially aggregated shuffle suffices.
    """
    counted = fragments.select("sample", "count_frag").unionByName(spikeins.select("sample", "count_frag"))
    names = sheet.select("sample", "sample_recode").distinct()
    return (
        counted.join(names, "sample", "left")
        .groupBy(F.coalesce("sample_recode", "sample").alias("sample"))
        .agg(F.sum("count_frag").alias("count_frag_sample"))
    )


def sample_details(sheet: DataFrame) -> DataFrame:
    """One row per recoded sample: its species (by name, not by code), method, replicate and type."""
    return sheet.select(
        F.col("sample_recode").alias("sample"), "species", "library_method", "sample_rep", "sample_type"
    ).distinct()


def number_of(sizes: DataFrame, sheet: DataFrame, part: str, control_type: str | None = None) -> DataFrame:
    """Distinct replicates (``sample_rep``) or types (``sample_type``) per species and method, of samples with a size.

    Names come from the sheet: the sample key may hold a code in place of the species.
    """
    parts = sample_details(sheet).join(sizes.select("sample"), "sample", "left_semi")
    if control_type:
        parts = parts.where(F.col("sample_type") != control_type)
    return parts.groupBy("species", "library_method").agg(F.countDistinct(part).alias("n"))


def sample_design(
    sizes: DataFrame, sheet: DataFrame, profile: Profile, max_samples: int = BROADCAST_ROWS
) -> DataFrame:
    """One row per sample of the sheet: library size, replicates and types of its method.

    ``sizes`` is computed from all fragments, so its size cannot be looked up
    cheaply; but it holds one row per sample and is cut to the samples of the
    sheet here. Counting the sheet therefore bounds this table, and only then is
    it hinted for broadcast.
    """
    small = sheet.limit(max_samples + 1).count() <= max_samples
    parts = sizes.join(sample_details(sheet), "sample")
    if small:  # one partition, so that no step below shuffles again
        parts = parts.repartition(1)
    used = f"sample_type <> '{profile.control_type}'" if profile.control_type else "true"
    method = Window.partitionBy("species", "library_method")

    def distinct_of(part: str) -> Column:
        return F.size(F.collect_set(F.expr(f"if({used}, {part}, null)")).over(method)).cast("bigint")

    design = parts.select(
        "sample",
        "sample_rep",
        "sample_type",
        "count_frag_sample",
        distinct_of("sample_rep").alias("n_rep"),
        distinct_of("sample_type").alias("n_type"),
    )
    return F.broadcast(design) if small else design


def drop_contigs(df: DataFrame, profile: Profile) -> DataFrame:
    """Remove denied contigs."""
    return df.where(~F.col("chr").isin(*profile.chr_deny)) if profile.chr_deny else df


def on_grid(counts: DataFrame, profile: Profile, main_contigs: DataFrame | None = None) -> DataFrame:
    """Contigs on which sites are called; counts elsewhere are kept but not analysed.

    ``main_contigs`` lists pairs (``species``, ``chr``). Reads are aligned to a combined genome, so a sample also
    has fragments on contigs of other species; these are no sites of its own.
    """
    if profile.chr_allow:
        counts = counts.where(F.col("chr").isin(*profile.chr_allow))
    if main_contigs is not None:
        listed = broadcast_if_small(main_contigs.select("species", "chr").distinct())
        counts = counts.join(listed, ["species", "chr"], "left_semi")
    return counts


def normalize_fragments(fragments: DataFrame) -> DataFrame:
    """1-based, strand-aware end positions in place of the half-open interval."""
    start, end, strand = F.col("start"), F.col("end"), F.col("strand")
    return fragments.select(
        "sample",
        "chr",
        co.end5(start, end, strand).alias("end5"),
        co.end3(start, end, strand).alias("end3"),
        "strand",
        "type",
        "count_frag",
    )


def count_by_type(fragments: DataFrame) -> DataFrame:
    """Counts per raw sample, position and fragment type."""
    return (
        normalize_fragments(fragments)
        .groupBy("sample", "chr", "strand", "type", "end5")
        .agg(F.sum("count_frag").alias("count_end5"))
    )


def count_end5(fragments: DataFrame, sheet: DataFrame, profile: Profile) -> DataFrame:
    """Uncapped 5'-end counts per recoded sample and position.

    Sheet columns depend on the recoded sample alone, so only the sample key and
    the position are shuffled; the sheet is joined map-side before (key) and
    after (details) the one aggregation.
    """
    kept = drop_contigs(fragments.where(F.col("type") != "capped"), profile)
    return _count_positions(kept, sheet)


def _count_positions(fragments: DataFrame, sheet: DataFrame) -> DataFrame:
    names = sheet.select("sample", "sample_recode").distinct()
    counts = (
        normalize_fragments(fragments)
        .join(names, "sample", "left")
        .groupBy(F.col("sample_recode").alias("sample"), "chr", "strand", "end5")
        .agg(F.sum("count_frag").alias("count_end5"))
    )
    return counts.join(sample_details(sheet), "sample", "left").select(
        "species", "sample", "library_method", "sample_rep", "sample_type", "chr", "strand", "end5", "count_end5"
    )


def split_controls(counts: DataFrame, control_type: str) -> tuple[DataFrame, DataFrame]:
    """Control samples and all others."""
    return counts.where(F.col("sample_type") == control_type), counts.where(F.col("sample_type") != control_type)


def spikein_counts(spikeins: DataFrame, sheet: DataFrame, design: DataFrame) -> DataFrame:
    """Uncapped spike-in 5'-end counts with their counts per million."""
    counts = _count_positions(spikeins.where(F.col("type") != "capped"), sheet)
    return (
        counts.join(design.select("sample", "count_frag_sample"), "sample", "left")
        .withColumn("cpm_end5", cpm(F.col("count_end5"), F.col("count_frag_sample")))
    )


def samples_without_size(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Samples of ``counts`` that have no library size; must be empty for a valid run."""
    return counts.select("sample").distinct().join(sizes, "sample", "left_anti")
