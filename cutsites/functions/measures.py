"""Normalisation, ratios and ranking keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def cpm(count: Column, library_size: Column, pseudo: int = 0) -> Column:
    """Counts per million of the library."""
    return F.try_divide((count + pseudo).cast("double") * F.lit(1e6), library_size.cast("double"))


def site_ratio(at_site: Column, around: Column) -> Column:
    """Signal at the site over one plus the signal around it."""
    return at_site / (around + 1)


def pick(score: str, tie: str, payload: Sequence[str], condition: str | None = None) -> str:
    """SQL struct whose minimum is the best row.

    Highest score first (compared at six digits, so that engines summing doubles
    in another order agree), NULL scores last, ties by ``tie`` ascending. Rows that
    fail ``condition`` give NULL.
    """
    rank = f"coalesce(-round({score}, 6), double('infinity')) as rank"
    fields = ", ".join([rank, f"{tie} as tie", *payload])
    return f"if({condition}, struct({fields}), null)" if condition else f"struct({fields})"
