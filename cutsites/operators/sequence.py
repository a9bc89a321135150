"""Sequence windows and the mispriming filter."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cutsites.functions import coordinates as co
from cutsites.functions import keys as k
from cutsites.functions.sequences import BASES_PER_WORD, identity, packed, reverse_complement, unequal_bases
from cutsites.sources import fasta_index


def padded_chunks(chunks: DataFrame, chunk_len: int, pad: int) -> DataFrame:
    """Chunks that also carry the next ``pad`` bases.

    Any window of at most ``pad + 1`` bases then lies inside the chunk of its
    first base: fetching it is one equi-join. Chunks must be consecutive and all
    but the last of a contig ``chunk_len`` bases long.
    """
    following = -(-pad // chunk_len)
    shifted = chunks.select(
        "chr", "chunk", "seq", F.explode(F.sequence(F.lit(0), F.lit(following))).alias("_step")
    ).select(
        "chr",
        (F.col("chunk") - F.col("_step")).alias("chunk"),
        "_step",
        F.substring("seq", F.lit(1), chunk_len + pad - F.col("_step") * chunk_len).alias("seq"),
    )
    parts = F.sort_array(F.collect_list(F.struct("_step", "seq")))
    return (
        shifted.where(F.col("chunk") >= 0)
        .groupBy("chr", "chunk")
        .agg(F.max(F.col("_step") == 0).alias("_own"), F.array_join(F.transform(parts, lambda p: p["seq"]), "").alias("seq"))
        .where("_own")
        .select("chr", "chunk", "seq")
    )


def slice_sequences(regions: DataFrame, chunks: DataFrame, chunk_len: int, max_len: int) -> DataFrame:
    """Strand-aware sequence (``seq``) of regions of at most ``max_len`` bases.

    Bases on other strands than ``+`` are reverse-complemented. Regions without
    a chunk get NULL. Both sides are shuffled by contig and chunk: a genome is never
    broadcast, whatever its estimated size (generated chunks are estimated far too
    small), and a contig that holds most sites spreads over its chunks.
    """
    padded = padded_chunks(chunks, chunk_len, max_len - 1).hint("merge")
    located = regions.withColumn("chunk", F.expr(f"bigint(floor(start / {chunk_len}))")).repartition("chr", "chunk")
    offset = F.col("start") - F.col("chunk") * chunk_len
    plain = F.substring("seq", (offset + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return (
        located.join(padded, ["chr", "chunk"], "left")
        .withColumn("seq", co.by_strand(F.col("strand"), plain, reverse_complement(plain)))
        .drop("chunk")
    )


def upstream_windows(sites: DataFrame, lengths: DataFrame, upstream: int) -> DataFrame:
    """``start``/``end`` of the site base and ``upstream`` bases before it, clipped to the contig."""
    start, end, strand = co.unit_start(F.col("end5")), F.col("end5"), F.col("strand")
    return (
        sites.join(lengths, "chr", "left")
        .withColumn("start", co.slop_start(start, strand, upstream))
        .withColumn("end", co.slop_end(end, strand, upstream, F.col("length")))
        .drop("length")
    )


def upstream_sequence(
    sites: DataFrame, chunks: DataFrame, lengths: DataFrame, upstream: int, chunk_len: int
) -> DataFrame:
    """Sites with the sequence of ``upstream`` bases before the site and the site base itself."""
    windows = upstream_windows(sites, lengths, upstream)
    return slice_sequences(windows, chunks, chunk_len, upstream + 1)


def upstream_sequence_indexed(
    sites: DataFrame, index: DataFrame, lengths: DataFrame, upstream: int, range_bytes: int = fasta_index.RANGE_BYTES
) -> DataFrame:
    """``upstream_sequence`` out of indexed FASTA files: only the byte ranges that hold a window are read."""
    windows = upstream_windows(sites, lengths, upstream)
    found = fasta_index.fetch(windows, index, upstream + 1, range_bytes)
    return found.withColumn("seq", co.by_strand(F.col("strand"), F.col("seq"), reverse_complement(F.col("seq"))))


def oligo_identities(with_seq: DataFrame, oligos: DataFrame, flank: int, longest: int = 2 * BASES_PER_WORD) -> DataFrame:
    """Equal bases of each site with every oligo (of at most ``longest`` bases) of its method.

    ``with_seq`` holds the longest window; a shorter oligo is compared with the
    last ``oligo_len + flank + 1`` bases, which is the window of that length even
    where it was clipped. Sequences shorter than the oligo give NULL.
    """
    window = F.expr(f"right(window_seq, oligo_len + {flank} + 1)")
    return (
        with_seq.withColumnRenamed("seq", "window_seq")
        .join(oligos, "library_method")
        .withColumn("identical_base_num", identity(F.col("seq"), window, longest=longest).cast("bigint"))
        .drop("window_seq", "seq")
    )


def truncated(identities: DataFrame) -> DataFrame:
    """Number of sites per oligo length whose window was too short to compare."""
    return identities.groupBy("oligo_len").agg(
        F.sum(F.col("identical_base_num").isNull().cast("bigint")).alias("n_truncated")
    )


def below_limit(identities: DataFrame, oligo_len: int, limit: int) -> DataFrame:
    """Identities of one oligo length that stay below its limit."""
    return identities.where((F.col("oligo_len") == oligo_len) & (F.col("identical_base_num") < limit))


def _below(window: Column, window_words: Column, length: int, limit: int) -> Callable[[Column], Column]:
    """Whether a packed oligo has fewer than ``limit`` bases in common with the window; NULL if one of them is too short."""
    return lambda oligo: F.when(
        (oligo["n"] == length) & (F.length(window) >= length), length - unequal_bases(oligo["words"], window_words, length) < limit
    )


def mispriming_filter(
    sites: DataFrame,
    chunks: DataFrame | None,
    lengths: DataFrame,
    oligos: DataFrame,
    limits: dict[int, int],
    flank: int,
    chunk_len: int,
    index: DataFrame | None = None,
    observation: Observation | None = None,
) -> DataFrame:
    """Keep sites whose upstream bases differ enough from their method's oligos at every length.

    One sequence fetch for the longest window, from the chunks of the genome or through an ``index`` of its files. A method
    needs an oligo of every length; where it has several of one length, the site must pass for each.
    ``observation`` gets the numbers of ``window_metrics`` once the result is computed, without another pass.
    """
    upstream = max(limits) + flank
    if index is not None:
        with_seq = upstream_sequence_indexed(sites, index, lengths, upstream)
    else:
        with_seq = upstream_sequence(sites, chunks, lengths, upstream, chunk_len)
    if observation is not None:
        with_seq = with_seq.observe(observation, *window_metrics(limits, flank))
    return differing_sites(with_seq, oligos, limits, flank).select(*sites.columns)


def window_metrics(lengths: Iterable[int], flank: int) -> list[Column]:
    """Number of sites, and for each oligo length how many windows are too short to compare."""
    found = [F.length(F.expr(f"right(seq, {n + flank + 1})")) for n in lengths]
    short = [F.sum((F.coalesce(size, F.lit(0)) < n).cast("bigint")).alias(f"truncated_{n}") for n, size in zip(lengths, found, strict=True)]
    return [F.count(F.lit(1)).alias("n_sites"), *short]


def differing_sites(with_seq: DataFrame, oligos: DataFrame, limits: dict[int, int], flank: int) -> DataFrame:
    """Sites with their longest window (``seq``) that stay below the limit of every length; the comparison is a predicate on the row."""
    per_method = oligos.groupBy("library_method").agg(
        *[
            F.collect_set(F.when(F.col("oligo_len") == n, F.struct(F.length("seq").alias("n"), packed(F.col("seq"), n).alias("words")))).alias(f"_oligos_{n}")
            for n in limits
        ]
    )
    passed, words = F.lit(True), {}
    for n, limit in limits.items():
        window = F.expr(f"right(seq, {n + flank + 1})")
        words[f"_window_{n}"] = packed(window, n)  # once a site, whatever the number of oligos
        passed = passed & (F.size(f"_oligos_{n}") > 0) & F.forall(f"_oligos_{n}", _below(window, F.col(f"_window_{n}"), n, limit))
    return with_seq.join(per_method, "library_method").withColumns(words).where(passed)


def site_fasta(with_seq: DataFrame) -> DataFrame:
    """Two text lines per site (name with strand suffix, bases) as one ``value`` with a line break."""
    name = F.concat(k.site_id(), F.lit("("), F.col("strand"), F.lit(")"))
    return with_seq.select(F.concat(F.lit(">"), name, F.lit("\n"), F.col("seq")).alias("value"))
