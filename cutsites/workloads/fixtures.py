"""Interval-shaped views over the test tables, and a profile that fits them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutsites import schemas
from cutsites.plans.find_candidates import Inputs
from cutsites.profile import PROFILE_CONTROL, PROFILE_HUMAN, HotspotRule, RatioWindow
from cutsites.session import local_table

CHUNK_LEN = 32
METHODS = ("L1", "L2", "TA", "TC")
TYPES = ("A", "N", "R")

HOTSPOTS = (
    HotspotRule("chr2", lo=0.875),
    HotspotRule("chr4", lo=0.375, hi=0.5, lo_incl=True, hi_incl=True),
    HotspotRule("chr5", hi=0.03),
)
FOUR = replace(
    PROFILE_HUMAN,
    species=None,
    chr_allow=(),
    rep_names={"rep1": "r1", "rep2": "r2", "rep3": "r3"},
    drop_excluded=True,
    hotspots=(),
    known_sites=(),
)
THREE = replace(
    PROFILE_CONTROL,
    species_codes={},
    rep_names={"rep1": "r1", "rep2": "r2", "rep3": "r3"},
    drop_excluded=True,
    method_names={"ligation_oligo1": "L1", "tailing_polyA": "TA", "tailing_polyC": "TC"},
    hotspots=(),
    edge_margin=None,
)
# Two species aligned to one genome: codes in the sample keys, two raw samples under one name.
SPECIES_CODES = {"spA": "A1", "spB": "B1"}
FOUR_2S = replace(FOUR, species_codes=SPECIES_CODES)
THREE_2S = replace(THREE, species_codes=SPECIES_CODES)
MAIN_CONTIGS = (("spA", "chr1"), ("spA", "chr2"), ("spA", "chr3"), ("spB", "chr3"), ("spB", "chr4"), ("spB", "chr5"))
GRID = (RatioWindow(50, True), RatioWindow(100, True), RatioWindow(50, False), RatioWindow(100, False))

OLIGOS = (
    ("L1", 4, "ACGT"),
    ("L1", 10, "ACGTTGCAAC"),
    ("L2", 4, "TTGA"),
    ("L2", 10, "TTGACCGTAA"),
    ("TA", 4, "AAAA"),
    ("TA", 10, "AAAAAAAAAA"),
    ("TC", 4, "CCCC"),
    ("TC", 10, "CCCCCCCCCC"),
)
# Ids of four regions that reach the first tier at every scale.
KNOWN = ("spA|chr1|2161|-", "spA|chr1|3241|-", "spA|chr1|521|+", "spA|chr1|5401|-")
ALIAS = (("chr1", "c1", None), ("chr2", "c2", None), ("chr3", None, "c3"))


# One accession is missing from one archive, one line is an alternate, one contig has no name at all.
ALIAS_FOUR = (("chr11", "e1", "x1", "chr1"), ("chr12", "e2", "chr2", None), ("chrX", "e3", None, "chr3"), ("chrX_alt", "e4", None, "chr3"), ("chrUn_5", None, None, "chr5"))
ALIAS_TWO = (("chr4", "chr14"), ("chr3", "chrX"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _method(index):
    return F.element_at(F.array(*[F.lit(m) for m in METHODS]), (index + 1).cast("int"))


def _sample(two: bool, species, lane, method, rep, kind):
    """Sample key; with ``two`` species a raw name that differs from it and has a lane."""
    key = F.concat(method, F.lit("|r"), rep.cast("string"), F.lit("|"), kind)
    if not two:
        return F.concat(F.lit("spA|"), key)
    return F.concat(F.lit("raw_"), F.when(species == 0, "spA").otherwise("spB"), F.lit("_"), F.translate(key, "|", "_"), F.lit("_"), lane.cast("string"))


def fragments(spark: SparkSession, sf_dir: str, control: bool = False, two: bool = False) -> DataFrame:
    """Fragments from line items; with ``control``, the three-method variant with control samples; with ``two`` species on all contigs."""
    q = F.col("l_quantity").cast("bigint")
    key = F.expr("l_partkey div 5")
    pos = 201 + F.expr("(l_partkey div 5) div 3") * 40 + (key % 3) * 2
    base = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("chr"), (F.col("l_partkey") % 5 + 1).cast("string")).alias("chr"),
        pos.alias("pos"),
        F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"),
        q.alias("q"),
        (F.col("l_orderkey") % 3 + 1).alias("rep"),
        _method(F.expr("(l_orderkey div 3) % 4")).alias("method"),
        F.col("l_returnflag").alias("kind"),
        (F.col("l_linenumber") % 2).alias("species"),
        F.expr("(l_linenumber div 2) % 2").alias("lane"),
    )
    if control:
        base = base.where(F.col("method") != "L2").withColumn("kind", F.when(F.col("q") >= 46, "endo").otherwise(F.col("kind")))
    plus = F.col("strand") == "+"
    return base.select(
        "chr",
        F.when(plus, F.col("pos") - 1).otherwise(F.col("pos") - 20 - F.col("q")).alias("start"),
        F.when(plus, F.col("pos") + 19 + F.col("q")).otherwise(F.col("pos")).alias("end"),
        F.when(F.col("q") <= 2, "capped").otherwise("uncapped").alias("type"),
        F.col("q").alias("count_frag"),
        "strand",
        _sample(two, F.col("species"), F.col("lane"), F.col("method"), F.col("rep"), F.col("kind")).alias("sample"),
    )


def spikeins(spark: SparkSession, sf_dir: str, two: bool = False) -> DataFrame:
    """Spike-ins from orders; with ``two`` species some are capped."""
    base = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("spike"), (F.col("o_custkey") % 3 + 1).cast("string")).alias("chr"),
        (F.col("o_custkey") % 20 + 101).alias("pos"),
        F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"),
        (F.col("o_orderkey") % 10 + 1).alias("q"),
        (F.col("o_orderkey") % 3 + 1).alias("rep"),
        _method(F.expr("(o_orderkey div 3) % 4")).alias("method"),
        F.expr("(o_orderkey div 12) % 3").alias("t"),
        (F.col("o_custkey") % 2).alias("species"),
        F.expr("(o_custkey div 2) % 2").alias("lane"),
    )
    plus = F.col("strand") == "+"
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("t") + 1).cast("int"))
    return base.select(
        "chr",
        F.when(plus, F.col("pos") - 1).otherwise(F.col("pos") - 20).alias("start"),
        F.when(plus, F.col("pos") + 19).otherwise(F.col("pos")).alias("end"),
        (F.when(F.col("q") <= 2, "capped").otherwise("uncapped") if two else F.lit("uncapped")).alias("type"),
        F.col("q").alias("count_frag"),
        "strand",
        _sample(two, F.col("species"), F.col("lane"), F.col("method"), F.col("rep"), kind).alias("sample"),
    )


def sample_sheet(spark: SparkSession, control: bool = False, two: bool = False) -> DataFrame:
    """Sheet of all designed samples, with one excluded line that must not count."""
    names = {v: n for n, v in PROFILE_HUMAN.method_names.items()}
    methods = [m for m in METHODS if not (control and m == "L2")]
    kinds = [*TYPES, "endo"] if control else list(TYPES)
    rows = [
        ("spA", f"spA|{m}|r{r}|{t}", names[m], f"rep{r}", t, f"run{r}#{t}", None)
        for m in methods
        for r in (1, 2, 3)
        for t in kinds
    ]
    if two:
        rows = [
            (sp, f"raw_{sp}_{m}_r{r}_{t}_{lane}", names[m], f"rep{r}", t, f"run{r}#{t}", None)
            for sp in SPECIES_CODES for m in methods for r in (1, 2, 3) for t in kinds for lane in (0, 1)
        ]
    rows.append(("spA", "spA|L1|r9|A", "ligation_oligo1", "rep9", "A", "run9", "Y"))
    return local_table(spark, rows, schemas.SAMPLE_SHEET)


def genome_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    longest = table(spark, sf_dir, "lineitem").agg(F.max("l_partkey").alias("m"))
    return longest.select(
        F.explode(F.array(*[F.lit(f"chr{c}") for c in range(1, 6)])).alias("chr"),
        (F.lit(400) + F.expr("m div 15") * 40).alias("length"),
    )


def genome_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random-looking bases, 32 per chunk, generated in parallel blocks of 4,096 chunks."""
    last = F.expr(f"(length - 1) div {CHUNK_LEN}")
    blocks = genome_lengths(spark, sf_dir).select(
        "chr", last.alias("last"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.shiftright(last, 12))).alias("block")
    )
    chunks = blocks.repartition("chr", "block").select(
        "chr",
        F.explode(
            F.sequence(F.shiftleft("block", 12), F.least("last", F.shiftleft(F.col("block") + 1, 12) - 1))
        ).alias("chunk"),
    )
    digest = F.md5(F.concat("chr", F.lit(":"), F.col("chunk").cast("string")).cast("binary"))
    return chunks.select("chr", "chunk", F.translate(digest, "0123456789abcdef", "ACGT" * 4).alias("seq"))


def oligos(spark: SparkSession) -> DataFrame:
    return local_table(spark, list(OLIGOS), schemas.OLIGOS)


def alias(spark: SparkSession) -> DataFrame:
    raw = local_table(spark, list(ALIAS), schemas.CONTIG_ALIAS)
    return raw.select("chr", F.coalesce("alias", "fallback").alias("alias"))


def inputs(spark: SparkSession, sf_dir: str, control: bool = False, sequences: bool = False, two: bool = False) -> Inputs:
    return Inputs(
        fragments=fragments(spark, sf_dir, control, two),
        spikeins=spikeins(spark, sf_dir, two),
        sheet=sample_sheet(spark, control, two),
        lengths=genome_lengths(spark, sf_dir),
        main_contigs=local_table(spark, list(MAIN_CONTIGS), schemas.MAIN_CONTIGS) if two else None,
        chunks=genome_chunks(spark, sf_dir) if sequences else None,
        chunk_len=CHUNK_LEN,
        oligos=oligos(spark) if sequences else None,
    )


def write_alias_files(spark: SparkSession, lengths: DataFrame, folder: str) -> None:
    """Alias files of two archives, with comment lines, for the contigs of ``lengths``."""
    for name, rows, schema in (("four", ALIAS_FOUR, schemas.ALIAS_FOUR), ("two", ALIAS_TWO, schemas.ALIAS_TWO)):
        listed = local_table(spark, list(rows), schema)
        listed = listed.join(lengths.select(F.col("chr").alias("genbank_")), F.coalesce(*[c for c in ("genbank", "ENA") if c in listed.columns]) == F.col("genbank_"), "left_semi")
        text = listed.select(F.concat_ws("\t", *[F.coalesce(c, F.lit("")) for c in listed.columns]).alias("value"))
        text.unionByName(spark.range(1).select(F.lit("# accession and name").alias("value"))).write.text(f"{folder}/{name}")


def write_sheet_files(spark: SparkSession, data: Inputs, folder: str) -> None:
    """A sheet as CSV and a fragment table for each of its samples, where the sheet's data sets and samples say."""

    def raw(column):
        return F.concat(F.lit("s="), F.translate(column, "|", "_"))

    sheet = data.sheet.withColumn("sample", raw(F.col("sample"))).withColumn("dataset", F.lit("run1#first")).withColumnRenamed("library_method", "method")
    sheet.coalesce(1).write.option("header", True).csv(f"{folder}/sheet")
    for kind, rows in (("genome", data.fragments), ("spikeins", data.spikeins)):
        # A folder named s=<sample>_<kind>.bed is what the sheet's path of the sample means.
        named = rows.withColumn("s", F.concat(F.translate("sample", "|", "_"), F.lit(f"_{kind}.bed"))).withColumn("sample", raw(F.col("sample")))
        named.write.mode("append").partitionBy("s").option("sep", "\t").csv(f"{folder}/run1/results/04.bed")
