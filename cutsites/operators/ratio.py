"""Signal-to-neighbourhood ratio of sites, its design means, and the final table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutsites.functions import keys as k
from cutsites.functions.measures import site_ratio
from cutsites.operators.regions import BIN_BITS, TILE, TILE_BITS, range_join
from cutsites.profile import Profile, RatioWindow
from cutsites.schemas import REGION_KEYS, SITE_KEYS

# Positions this close to the site count neither as site nor as neighbourhood.
SHOULDER = 2


def peak_windows(peaks: DataFrame, windows: Sequence[RatioWindow]) -> DataFrame:
    """Peaks with the inclusive range of positions that any of the windows can use.

    If all windows look upstream only, the other half is left out of the join.
    """
    reach = max(w.offset for w in windows) + SHOULDER
    down = 0 if all(w.upstream_only for w in windows) else reach
    return peaks.selectExpr(
        "*",
        f"if(strand = '+', peak - {reach}, peak - {down}) as window_lo",
        f"if(strand = '+', peak + {down}, peak + {reach}) as window_hi",
    )


def window_regions(peaks: DataFrame, offset: int) -> DataFrame:
    """Full window of each peak with its region key, as a table."""
    return peaks.select(
        k.joined("peak_id", "peak", sep="%").alias("region_id"),
        (F.col("peak") - offset - SHOULDER).alias("region_start"),
        (F.col("peak") + offset + SHOULDER).alias("region_end"),
        *SITE_KEYS,
    )


def counts_in_windows(tiled: DataFrame, peaks: DataFrame, windows: Sequence[RatioWindow]) -> DataFrame:
    """Counts paired with every peak whose window holds them.

    ``tiled`` comes from ``tile_counts``; peaks are repeated for the (at most two)
    tiles of their window so that the counts stay where they are.
    """
    tiles = f"explode(sequence(shiftright(window_lo - 1, {TILE_BITS}), shiftright(window_hi - 1, {TILE_BITS})))"
    split = (
        peak_windows(peaks, windows)
        .withColumn(TILE, F.expr(tiles))
        .withColumn("_lo", F.expr(f"greatest(window_lo, shiftleft({TILE}, {TILE_BITS}) + 1)"))
        .withColumn("_hi", F.expr(f"least(window_hi, shiftleft({TILE} + 1, {TILE_BITS}))"))
        .drop("window_lo", "window_hi")
    )
    return range_join(tiled, split, [*SITE_KEYS, TILE], "end5", "_lo", "_hi", BIN_BITS)


def cleavage_ratio(
    tiled: DataFrame, peaks: DataFrame, windows: Sequence[RatioWindow] = (RatioWindow(100, True),)
) -> DataFrame:
    """Ratio of the counts at a peak to those around it, per sample and window.

    All windows are computed in one pass as conditional sums. A sample without
    any signal in a window has no row for it; control samples never have one.
    """
    # Inside the sums, not as a filter: a filter would move below the layout shared
    # with the site calls and have the counts computed twice.
    used = "not is_control and " if "is_control" in tiled.columns else ""
    sums = [f"sum(if({used}end5 = peak, count_end5, null)) as cs"]
    for w in windows:
        around = f"{used}abs(end5 - peak) between {SHOULDER + 1} and {w.offset + SHOULDER}"
        if w.upstream_only:
            around += " and if(strand = '+', end5 - peak, peak - end5) <= 0"
        sums.append(f"sum(if({around}, count_end5, null)) as _{w.tag}")
    region = ["tier", *SITE_KEYS, "start", "peak", *[c for c in ("n_design",) if c in peaks.columns]]
    group = [*region, "sample"]
    structs = ", ".join(f"struct('{w.tag}' as ratio_type, _{w.tag} as other)" for w in windows)
    names = ["cs", *[f"_{w.tag}" for w in windows]]
    # Sums per tile stay in the layout of the counts; one shuffle by region then
    # serves the sums per peak here and the sums per region of the final table.
    return (
        counts_in_windows(tiled, peaks.select(*region), windows)
        .groupBy(*group, TILE)
        .agg(*[F.expr(s) for s in sums])
        .repartition(*REGION_KEYS, "start")
        .groupBy(*group)
        .agg(*[F.expr(f"sum({n}) as {n}") for n in names])
        .selectExpr(*group, "cs", f"inline(array({structs}))")
        .where("cs is not null or other is not null")
        .selectExpr(*group, "ratio_type", "coalesce(cs, 0L) as cs", "coalesce(other, 0L) as other")
        .withColumn("ratio", site_ratio(F.col("cs"), F.col("other")))
        .withColumn("peak_id", k.peak_id())
    )


def with_design(ratios: DataFrame, design: DataFrame) -> DataFrame:
    """Replicate and type of each ratio's sample, and the size of its design."""
    details = design.selectExpr("sample", "sample_rep", "sample_type", "n_rep", "n_type")
    return ratios.drop("n_design").join(details, "sample", "left").withColumn("n_design", F.expr("n_rep * n_type"))


def hierarchical_mean(ratios: DataFrame, divisor: int) -> DataFrame:
    """Mean over types, then replicates, then methods; missing combinations count as 0.

    The divisors come from the design, so the three means fold into one weighted sum
    and one shuffle.
    """
    return ratios.groupBy("tier", "peak_id", "ratio_type").agg(
        F.expr(f"sum(ratio / (n_design * {divisor}))").alias("ratio_mean")
    )


def ratio_columns(means: DataFrame, tags: Sequence[str]) -> DataFrame:
    """One column ``ratio_<tag>`` per window."""
    return (
        means.withColumn("ratio_type", F.concat(F.lit("ratio_"), "ratio_type"))
        .groupBy("tier", "peak_id")
        .pivot("ratio_type", [f"ratio_{t}" for t in tags])
        .agg(F.max("ratio_mean"))
    )


def peak_columns(ratios: DataFrame, methods: Sequence[str]) -> DataFrame:
    """One column ``peak_<method>`` per method, NULL where the method has no peak."""
    return (
        ratios.withColumn("_column", F.concat(F.lit("peak_"), "library_method"))
        .groupBy("tier", "peak_id", "species", "chr", "strand")
        .pivot("_column", [f"peak_{m}" for m in methods])
        .agg(F.max("peak"))
    )


def tier_info(ratios: DataFrame, profile: Profile, alias: DataFrame | None = None) -> DataFrame:
    """Final table: positions per method and mean ratios of every region.

    Both pivots share the region as key and the peak id is unique over tiers, so one
    aggregation replaces two pivots and a join.
    ``alias`` (``chr``, ``alias``) adds ``chr_UCSC``; unmatched contigs keep their name.
    """
    region = ["tier", "species", "chr", "strand", "start"]
    tags = [w.tag for w in profile.ratio_windows]
    share = f"ratio / (n_design * {profile.method_divisor})"
    info = ratios.groupBy(*region).agg(
        *[F.expr(f"max(if(library_method = '{m}', peak, null)) as peak_{m}") for m in profile.methods],
        *[F.expr(f"sum(if(ratio_type = '{t}', {share}, null)) as ratio_{t}") for t in tags],
    )
    contig = ["chr"]
    if alias is not None:
        info = info.join(alias.select("chr", "alias"), "chr", "left").withColumn("chr_UCSC", F.coalesce("alias", "chr"))
        contig.append("chr_UCSC")
    return info.select(
        "tier",
        k.peak_id().alias("peak_id"),
        "species",
        *contig,
        "strand",
        *[f"peak_{m}" for m in profile.methods],
        *[f"ratio_{t}" for t in tags],
    )
