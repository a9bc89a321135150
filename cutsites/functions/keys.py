"""Composite keys, dictionary recodes and string splitting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined(*parts: Column | str, sep: str = "|") -> Column:
    """Concatenate SQL expressions (or columns) with a separator.

    NULL if any part is NULL, unlike ``concat_ws``.
    """
    pieces: list[Column] = []
    if all(isinstance(p, str) for p in parts):
        return F.expr(f"concat({f', {_literal(sep)}, '.join(parts)})")
    for index, part in enumerate(parts):
        if index:
            pieces.append(F.lit(sep))
        pieces.append(F.expr(part) if isinstance(part, str) else part.cast("string"))
    return F.concat(*pieces)


def sample_key(species="species", method="library_method", rep="sample_rep", kind="sample_type") -> Column:
    return joined(species, method, rep, kind)


def site_id(species="species", chr="chr", strand="strand", end5="end5", method="library_method") -> Column:
    return joined(species, chr, strand, end5, method)


def contig_key(species="species", method="library_method", chr="chr") -> Column:
    return joined(species, method, chr)


def peak_id(species="species", chr="chr", start="start", strand="strand") -> Column:
    """Id of a region by the 1-based position of its first base."""
    return joined(species, chr, f"{start} + 1", strand)


def token(column: Column, index: int, sep: str = "|") -> Column:
    """The ``index``-th token (1-based); NULL when there are fewer tokens."""
    return F.try_element_at(F.split(column, _quoted(sep)), F.lit(index))


def last_token(column: Column, sep: str = "|") -> Column:
    return F.try_element_at(F.split(column, _quoted(sep)), F.lit(-1))


def split_into(column: Column, names_and_types: dict[str, str], sep: str = "|") -> list[Column]:
    """Split a composite string into named, typed columns; unparsable parts are NULL."""
    return [
        token(column, i, sep).try_cast(kind).alias(name)
        for i, (name, kind) in enumerate(names_and_types.items(), start=1)
    ]


def recode(column: Column, names: dict[str, str]) -> Column:
    """Replace known values, keep the others."""
    return F.coalesce(case_match(column, names), column) if names else column


def case_match(column: Column, names: dict[str, str]) -> Column:
    """Replace known values; anything else becomes NULL."""
    if not names:
        return F.lit(None).cast("string")
    items = list(names.items())
    first = F.when(column == items[0][0], items[0][1])
    return reduce(lambda acc, kv: acc.when(column == kv[0], kv[1]), items[1:], first)


def without_strand_suffix(column: Column) -> Column:
    """Drop the first ``(+)`` or ``(-)`` of a sequence name."""
    return F.regexp_replace(column, r"^(.*?)\([+-]\)", "$1")


def without_comment(column: Column) -> Column:
    """Drop everything from a ``#`` that is followed by more text."""
    return F.regexp_replace(column, r"^([^#]*)#.+$", "$1")


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _quoted(sep: str) -> str:
    return f"\\Q{sep}\\E"
