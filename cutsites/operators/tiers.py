"""Combining library methods: the tailing pair, merged regions, tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutsites.functions import coordinates as co
from cutsites.functions import keys as k
from cutsites.functions.measures import pick
from cutsites.operators.regions import TILE_BITS, Agg, count_members, merge_regions
from cutsites.profile import Profile
from cutsites.schemas import REGION_KEYS


# What is kept of each picked site; its position is the tie-break of the pick.
PICKED = ("cpm_end5_mean", "n_design")


def _method_pick(method: str) -> Agg:
    """Best member of one method, as column ``pick_<method>``."""
    best = pick("cpm_end5_mean", "string(end5)", PICKED, f"library_method = '{method}'")
    return Agg(f"pick_{method}", "min", best)


def pick_per_method(
    intervals: DataFrame,
    methods: Sequence[str],
    gap: int,
    keys: Sequence[str] = REGION_KEYS,
    tile_bits: int = TILE_BITS,
) -> DataFrame:
    """Merge intervals of all methods; one row per region with the best member of each method.

    The number of methods is fixed, so a wide row replaces grouped collections and
    everything that follows (tiers, tightened bounds, long form) stays row-local.
    """
    return merge_regions(intervals, keys, gap, [*[_method_pick(m) for m in methods], count_members()], tile_bits, few=True)


def _explode_picks(methods: Sequence[str]) -> str:
    """One row per present pick, as struct ``_pick`` of the method name and the pick ``p``."""
    tagged = ", ".join(f"struct('{m}' as library_method, pick_{m} as p)" for m in methods)
    return f"explode(filter(array({tagged}), t -> t.p is not null)) as _pick"


_UNPACKED = ("_pick.library_method", "bigint(_pick.p.tie) as end5", *[f"_pick.p.{c}" for c in PICKED])


def _position(method: str) -> str:
    return f"bigint(pick_{method}.tie)"


def _first(methods: Sequence[str]) -> str:
    return f"least({', '.join(map(_position, methods))})"


def _last(methods: Sequence[str]) -> str:
    return f"greatest({', '.join(map(_position, methods))})"


def _n_present(methods: Sequence[str]) -> str:
    return " + ".join(f"int(pick_{m} is not null)" for m in methods)


def _all_present(methods: Sequence[str]) -> str:
    return " and ".join(f"pick_{m} is not null" for m in methods)


def as_intervals(sites: DataFrame) -> DataFrame:
    """Sites as unit intervals."""
    return sites.select(
        *REGION_KEYS,
        co.unit_start(F.col("end5")).alias("start"),
        F.col("end5").alias("end"),
        "library_method",
        "end5",
        *PICKED,
    )


def merge_pair(sites: DataFrame, pair: tuple[str, str], gap: int, tile_bits: int = TILE_BITS) -> DataFrame:
    """Merged regions of two methods, with the best member of each."""
    chosen = sites.where(F.col("library_method").isin(*pair))
    return pick_per_method(as_intervals(chosen), pair, gap, tile_bits=tile_bits)


def _pair_ids(pair: tuple[str, str]) -> list[Column]:
    return [k.site_id(end5=_position(m), method=f"'{m}'") for m in pair]


def pair_combined(regions: DataFrame, pair: tuple[str, str]) -> DataFrame:
    """Regions holding both methods, tightened to the two picks; ``id`` lists both sites."""
    ids = _pair_ids(pair)
    return regions.where(_all_present(pair)).select(
        *REGION_KEYS,
        F.expr(f"{_first(pair)} - 1 as start"),
        F.expr(f"{_last(pair)} as end"),
        F.concat(ids[0], F.lit(","), ids[1]).alias("id"),
        F.lit(".").alias("score"),
    )


def pair_single(regions: DataFrame, pair: tuple[str, str]) -> DataFrame:
    """Regions of one method only, with their own bounds."""
    return regions.where(f"not ({_all_present(pair)})").select(
        *REGION_KEYS,
        "start",
        "end",
        F.coalesce(*_pair_ids(pair)).alias("id"),
        F.lit(".").alias("score"),
    )


def combine_pair(sites: DataFrame, profile: Profile, tile_bits: int = TILE_BITS) -> DataFrame:
    """Intervals of all methods for the final merge, one row per pick.

    The two methods of the pair are merged with each other; every other method is a
    pool of its own, in which picks are further apart than the gap and stay as they
    are. So all methods go through one pass and nothing upstream is computed twice.
    Bounds are tightened to the picks where both methods of the pair are present.
    """
    pair, methods = profile.pair, profile.methods
    in_pair = ", ".join(f"'{m}'" for m in pair)
    pooled = as_intervals(sites).withColumn(
        "_pool", F.expr(f"if(library_method in ({in_pair}), '', library_method)")
    )
    both = _all_present(pair)
    merged = pick_per_method(pooled, methods, profile.pair_gap, [*REGION_KEYS, "_pool"], tile_bits)
    return merged.selectExpr(
        *REGION_KEYS,
        f"if({both}, {_first(pair)} - 1, start) as start",
        f"if({both}, {_last(pair)}, end) as end",
        _explode_picks(methods),
    ).selectExpr(*REGION_KEYS, "start", "end", *_UNPACKED)


def merge_methods(sites: DataFrame, profile: Profile, tile_bits: int = TILE_BITS) -> DataFrame:
    """Regions over all methods (wide: one ``pick_<method>`` per method)."""
    return pick_per_method(combine_pair(sites, profile, tile_bits), profile.methods, profile.final_gap, tile_bits=tile_bits)


def regions_to_long(regions: DataFrame, methods: Sequence[str]) -> DataFrame:
    """One row per region and method."""
    kept = [c for c in regions.columns if not c.startswith("pick_")]
    exploded = regions.selectExpr(*kept, _explode_picks(methods))
    return exploded.selectExpr(*kept, *_UNPACKED).withColumn("id", k.site_id())


def assign_tiers(regions: DataFrame, profile: Profile) -> DataFrame:
    """Tier, tightened bounds and peak id of each region; regions outside all tiers are dropped.

    All tiers in one row-local pass over the wide regions. Still one row per region.
    """
    cases = " ".join(
        f"when _n >= {t.n_min}" + (f" and _n <= {t.n_max}" if t.n_max is not None else "") + f" then '{t.label}'"
        for t in profile.tiers
    )
    picks = [f"pick_{m}" for m in profile.methods]
    return (
        regions.selectExpr(*REGION_KEYS, *picks, f"{_n_present(profile.methods)} as _n")
        .selectExpr(
            *REGION_KEYS,
            *picks,
            f"case {cases} end as tier",
            f"{_first(profile.methods)} - 1 as start",
            f"{_last(profile.methods)} as end",
        )
        .where("tier is not null")
        .withColumn("peak_id", k.peak_id())
    )


def tier_sites(tiered: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Long form of tiered regions: one row per region and method with its ``peak``."""
    return regions_to_long(tiered, methods).withColumnRenamed("end5", "peak")
