"""Interval merging, range joins and best-per-region picks.

Intervals are merged without ever sorting a whole contig in one task. Positions
are cut into fixed tiles; islands are found inside each tile; only islands that
come within the gap of a tile border (at most two per tile) are chained over the
contig. Equal intervals are aggregated first, so what one task sees is bounded by the
distinct intervals of a tile, however many rows lie on one locus.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

TILE_BITS = 14
BIN_BITS = 8
#: Bins for intervals of any length: each lies in at most two bins of the narrowest level that allows it.
BIN_LEVELS = (8, 14, 20, 26, 32)
TILE = "tile"


@dataclass(frozen=True)
class Agg:
    """A decomposable aggregate carried through the merge: ``min``, ``max`` or ``sum`` of an SQL expression."""

    name: str
    how: str
    sql: str

    def update(self, condition: str | None = None) -> Column:
        value = f"if({condition}, {self.sql}, null)" if condition else self.sql
        return F.expr(f"{self.how}({value}) as {self.name}")

    def merge(self) -> Column:
        return F.expr(f"{self.how}({self.name}) as {self.name}")


def count_members(name: str = "n_sites") -> Agg:
    return Agg(name, "sum", "1L")


def merge_regions(
    df: DataFrame,
    keys: Sequence[str],
    gap: int,
    aggs: Sequence[Agg] = (),
    tile_bits: int = TILE_BITS,
    tiled: bool = False,
    few: bool = False,
) -> DataFrame:
    """Merge intervals of equal ``keys`` whose distance is at most ``gap``.

    Returns one row per merged region: keys, ``start``, ``end`` and the aggregates.
    ``gap=0`` merges overlapping and book-ended intervals. ``tiled=True`` states
    that ``df`` holds unit intervals and already carries their tile number, so an
    existing layout hashed on (keys, tile) is used as it is. ``few=True`` states that rows
    per position are bounded (picks of sites); otherwise equal intervals are combined first,
    which costs one more shuffle of what is left.
    """
    if not 0 <= gap < 1 << tile_bits:
        raise ValueError("gap must be at least 0 and smaller than a tile")
    pieces = df if tiled else _cut_at_tiles(df, tile_bits)
    if not tiled and not few:
        pieces = _distinct_pieces(pieces, list(keys), aggs)
        islands = _tile_islands(pieces, list(keys), gap, [a.merge() for a in aggs])
    else:
        islands = _tile_islands(pieces, list(keys), gap, [a.update(None if tiled else "_home") for a in aggs])
    return _chain_over_borders(islands, list(keys), gap, aggs, tile_bits)


def _cut_at_tiles(df: DataFrame, bits: int) -> DataFrame:
    """Cut intervals at tile borders; book-ended pieces stay linked for any gap."""
    first = f"shiftright(start, {bits})"
    tiles = f"explode(sequence({first}, greatest({first}, shiftright(end - 1, {bits}))))"
    rest = [c for c in df.columns if c not in ("start", "end")]
    return df.selectExpr(*rest, "start as _start", "end as _end", f"{first} as _first", f"{tiles} as {TILE}").selectExpr(
        *rest,
        TILE,
        f"{TILE} = _first as _home",
        f"greatest(_start, shiftleft({TILE}, {bits})) as start",
        f"least(_end, shiftleft({TILE} + 1, {bits})) as end",
    )


def _distinct_pieces(pieces: DataFrame, keys: list[str], aggs: Sequence[Agg]) -> DataFrame:
    """One row per distinct piece with its aggregates, combined before the shuffle."""
    return pieces.groupBy(TILE, *keys, "start", "end").agg(
        F.count("*").alias("_rows"), *[a.update("_home") for a in aggs]
    )


def _running_start(df: DataFrame, window: WindowSpec, reach: Column, gap: int) -> DataFrame:
    """Number rows by ``_island``: the start of the last row that lies beyond ``reach`` by more than ``gap``."""
    opens = F.expr(f"if(_reach is null or start - _reach > {gap}, start, null)")
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_reach", reach).withColumn("_island", F.max(opens).over(upto))


def _tile_islands(
    pieces: DataFrame, keys: list[str], gap: int, aggs: Sequence[Column]
) -> DataFrame:
    ordered = Window.partitionBy(TILE, *keys).orderBy("start", "end")
    # Running maximum, not the previous end: intervals may be nested.
    reach = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    return (
        _running_start(pieces, ordered, reach, gap)
        .groupBy(TILE, *keys, "_island")
        .agg(F.expr("max(end) as end"), *aggs)
    )


def _chain_over_borders(islands: DataFrame, keys: list[str], gap: int, aggs: Sequence[Agg], bits: int) -> DataFrame:
    near_border = f"_island - shiftleft({TILE}, {bits}) <= {gap} or shiftleft({TILE} + 1, {bits}) - end <= {gap}"
    names = [a.name for a in aggs]
    # Border islands of a contig share a group; all others stay within their tile.
    grouped = islands.selectExpr(
        *keys, TILE, "_island as start", "end", *names, f"{near_border} as _border"
    ).withColumn("_group", F.expr(f"if(_border, 0L, {TILE})"))
    ordered = Window.partitionBy("_group", "_border", *keys).orderBy("start")
    return (
        _running_start(grouped, ordered, F.lag("end").over(ordered), gap)
        .groupBy("_group", "_border", *keys, "_island")
        .agg(F.expr("max(end) as end"), *[a.merge() for a in aggs])
        .selectExpr(*keys, "_island as start", "end", *names)
    )


def best_per_region(
    df: DataFrame, keys: Sequence[str], gap: int, best: str, tiled: bool = False, tile_bits: int = TILE_BITS
) -> DataFrame:
    """Merged regions with their best member (a struct written by ``measures.pick``) as ``best``."""
    return merge_regions(df, keys, gap, [Agg("best", "min", best)], tile_bits, tiled)


def binned_intervals(intervals: DataFrame, lo: str, hi: str, levels: Sequence[int] = BIN_LEVELS) -> DataFrame:
    """Intervals repeated for the bins (``_level``, ``_bin``) they lie in: at most two, unless the last level is too narrow too."""
    fits = " ".join(f"when ({hi} >> {b}) - ({lo} >> {b}) <= 1 then {b}" for b in levels[:-1])
    level = f"case {fits} else {levels[-1]} end" if fits else str(levels[-1])
    placed = intervals.where(f"{lo} <= {hi}").withColumn("_level", F.expr(level))
    return placed.withColumn("_bin", F.expr(f"explode(sequence({lo} >> _level, {hi} >> _level))"))


def range_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    position: str,
    lo: str,
    hi: str,
    bin_bits: int | Sequence[int] = BIN_BITS,
) -> DataFrame:
    """Pairs of points and intervals with equal ``keys`` and ``lo <= position <= hi``.

    The join is an equi-join on keys and bin without duplicates. With one width of bins, right for intervals of a few
    bins, an interval is repeated for every bin it touches and a point lies in exactly one. With several widths
    (``BIN_LEVELS``), right for intervals of any length, an interval is two rows at most and a point one row for each width. Bins are
    narrow in positions, which also spreads a contig that holds most rows. When the
    points carry their tile, it is part of the key: a layout hashed on (keys, tile)
    then serves the join without another shuffle of the points.
    """
    if isinstance(bin_bits, int):
        left = points.withColumn("_bin", F.expr(f"shiftright({position}, {bin_bits})"))
        bins = f"explode(sequence(shiftright({lo}, {bin_bits}), shiftright({hi}, {bin_bits})))"
        right = intervals.where(f"{lo} <= {hi}").withColumn("_bin", F.expr(bins))
        return left.join(right, [*keys, "_bin"]).where(f"{position} between {lo} and {hi}").drop("_bin")
    left = points.withColumn("_level", F.explode(F.array(*[F.lit(b) for b in bin_bits]))).withColumn("_bin", F.expr(f"{position} >> _level"))
    joined = left.join(binned_intervals(intervals, lo, hi, bin_bits), [*keys, "_level", "_bin"])
    return joined.where(f"{position} between {lo} and {hi}").drop("_level", "_bin")


def region_members(
    df: DataFrame, keys: Sequence[str], gap: int, tile_bits: int = TILE_BITS, bin_bits: int | Sequence[int] = BIN_LEVELS
) -> DataFrame:
    """Rows of ``df`` with the bounds of the merged region they belong to, however long regions become."""
    regions = merge_regions(df.select(*keys, "start", "end"), keys, gap, tile_bits=tile_bits).select(
        *keys,
        F.col("start").alias("region_start"),
        F.col("end").alias("region_end"),
        (F.col("end") - 1).alias("_last"),
    )
    return range_join(df, regions, keys, "start", "region_start", "_last", bin_bits).drop("_last")


def split_ids(df: DataFrame, column: str = "id") -> DataFrame:
    """One row per id of a comma-joined list, as foreign files hold them.

    The library itself keeps one row per (region, id), see ``region_members``: a list
    would grow with its region.
    """
    return df.withColumn(column, F.explode(F.split(column, ",")))
