"""Column expressions on strand-aware coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLUS = "+"


def by_strand(strand: Column, plus: Column, other: Column) -> Column:
    """``plus`` on the forward strand, ``other`` elsewhere, NULL where the strand is NULL."""
    return F.when(strand == PLUS, plus).when(strand.isNotNull(), other)


def end5(start: Column, end: Column, strand: Column) -> Column:
    """1-based 5' end of a 0-based half-open interval."""
    return by_strand(strand, start + 1, end)


def end3(start: Column, end: Column, strand: Column) -> Column:
    """1-based 3' end of a 0-based half-open interval."""
    return by_strand(strand, end, start + 1)


def relative_position(position: Column, peak: Column, strand: Column) -> Column:
    """Signed distance to the peak, negative upstream."""
    return by_strand(strand, position - peak, peak - position)


def unit_start(position: Column) -> Column:
    """Start of the unit interval ``[position - 1, position)`` of a 1-based site."""
    return position - 1


def fraction(position: Column, length: Column) -> Column:
    """Position as a fraction of the contig length (NULL for an unknown or zero length)."""
    return F.try_divide(position.cast("double"), length)


def slop_start(start: Column, strand: Column, upstream: int) -> Column:
    """Start after extending ``upstream`` bases on the 5' side, clipped at 0."""
    return by_strand(strand, F.greatest(start - upstream, F.lit(0).cast("bigint")), start)


def slop_end(end: Column, strand: Column, upstream: int, length: Column) -> Column:
    """End after extending ``upstream`` bases on the 5' side, clipped at the contig end."""
    return by_strand(strand, end, F.least(end + upstream, length))


def tile_of(position: Column, bits: int) -> Column:
    """Index of the fixed tile of ``2**bits`` positions holding a coordinate."""
    return F.shiftright(position, bits)
