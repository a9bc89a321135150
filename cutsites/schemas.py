"""Explicit schemas of the input tables (nothing is ever inferred)."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
    fields = []
    for item in spec.split(","):
        name, kind = item.split()
        fields.append(T.StructField(name, kinds[kind], True))
    return T.StructType(fields)


FRAGMENTS = _struct(
    "chr string, start bigint, end bigint, type string, count_frag bigint, strand string, sample string"
)
SAMPLE_SHEET = _struct(
    "species string, sample string, library_method string, sample_rep string, sample_type string,"
    " dataset string, exclude string"
)
GENOME_LENGTHS = _struct("chr string, length bigint")
ALIAS_FOUR = _struct("UCSC string, ensembl string, ENA string, genbank string")
ALIAS_TWO = _struct("genbank string, UCSC string")
ALIAS_ONE = _struct("chr string")
COUNTS = _struct(
    "species string, sample string, library_method string, sample_rep string, sample_type string,"
    " chr string, strand string, end5 bigint, count_end5 bigint"
)
MAIN_CONTIGS = _struct("species string, chr string")
SITE_BED = _struct("chrom string, start bigint, end bigint, id string, cpm_end5_mean double, strand string")
MERGED_BED = _struct("chr string, start bigint, end bigint, strand string, id string")
OLIGOS = _struct("library_method string, oligo_len bigint, seq string")
GENOME_CHUNKS = _struct("chr string, chunk bigint, seq string")
HOTSPOT_RULES = _struct("species string, chr string, lo double, hi double, lo_incl boolean, hi_incl boolean")
CONTIG_ALIAS = _struct("chr string, alias string, fallback string")
WINDOW_METRICS = _struct("oligo_len bigint, n_truncated bigint, n_sites bigint, n_kept bigint")

# Key columns shared by the operators.
SITE_KEYS = ("species", "library_method", "chr", "strand")
REGION_KEYS = ("species", "chr", "strand")
