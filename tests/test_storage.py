"""Bucketed counts, written order, sheets and aliases from files, observed windows, bins of many widths."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from cutsites import schemas
from cutsites.operators import regions as R
from cutsites.operators import sequence as S
from cutsites.operators import sites
from cutsites.plans.find_candidates import stages
from cutsites.sources import bucketed, order, sinks, tables
from cutsites.workloads import fixtures as fx
from cutsites.workloads.queries import Lab

SMALL = "/root/testdata/sf0.001"


def tree(df):
    """Lines of the executed plan with their depth."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return [(len(x) - len(x.lstrip(" :+-*()0123456789")), x) for x in lines if x.strip()]


def above(lines, at):
    """Nodes above a line, nearest first."""
    depth, found = lines[at][0], []
    for d, x in reversed(lines[:at]):
        if d < depth:
            depth = d
            found.append(x)
    return found


# Bucketed counts --------------------------------------------------------------------


def test_bucketed_counts_need_no_exchange(spark, tmp_path):
    lab = Lab(spark, SMALL)
    bucketed.write_counts(lab.counts, str(tmp_path / "counts"), 4)
    lab.tiled = bucketed.read_counts(spark, str(tmp_path / "counts"), 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = tree(lab.ratios())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scans = [i for i, (_, x) in enumerate(lines) if "FileScan parquet" in x and "Bucketed: true" in x]
    assert len(scans) == 2  # for the sites and for the ratio
    before = []
    for at in scans:
        path = above(lines, at)
        first = next((i for i, x in enumerate(path) if "Exchange" in x), len(path))
        before.append(path[:first])
    # Sums of replicates and sites are done where the rows lie, and so is the ratio join.
    assert any(any("SortMergeJoin" in x for x in nodes) for nodes in before) and any(sum("HashAggregate" in x for x in nodes) >= 4 for nodes in before)


def test_bucketed_analysis_equals_the_plain_one(spark, tmp_path):
    lab = Lab(spark, SMALL, control=True)
    want = stages(lab.inputs, lab.profile).info
    got = stages(lab.inputs, lab.profile, str(tmp_path / "c"), buckets=3).info
    columns = [c for c in want.columns if not c.startswith("ratio_")]
    assert sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, want.select(columns).collect()))
    again = bucketed.read_counts(spark, str(tmp_path / "c"), 3)
    assert again.schema.fieldNames() == sites.positioned_counts(lab.counts, "endo").schema.fieldNames()
    assert again.count() == sites.positioned_counts(lab.counts, "endo").count()


# Samples without a size -----------------------------------------------------------------


def test_a_missing_library_size_is_an_error(spark):
    lab = Lab(spark, SMALL)
    some = lab.design.where("sample <> 'spA|L1|r1|A'")
    assert sites.reproducible_site_means(lab.tiled, some).count() >= 0
    with pytest.raises(PySparkException, match="no library size for the sample spA.L1.r1.A"):
        sites.reproducible_site_means(lab.tiled, some, strict=True).collect()
    assert sites.reproducible_site_means(lab.tiled, lab.design, strict=True).count() == lab.means.count()


# Observed windows -----------------------------------------------------------------------


def test_short_windows_are_counted_in_the_same_pass(spark):
    chunks = spark.createDataFrame([("c", i, "ACGTACGT") for i in range(10)], schemas.GENOME_CHUNKS)
    rows = [("sp", "TA", c, s, p) for c, s, p in (("c", "+", 3), ("c", "+", 5), ("c", "+", 40), ("c", "-", 79), ("x", "+", 9))]
    df = spark.createDataFrame(rows, "species string, library_method string, chr string, strand string, end5 long")
    lengths = spark.createDataFrame([("c", 80)], schemas.GENOME_LENGTHS)
    oligos = spark.createDataFrame([("TA", 4, "TTTT"), ("TA", 8, "TTTTTTTT")], schemas.OLIGOS)
    seen = Observation("windows")
    kept = S.mispriming_filter(df, chunks, lengths, oligos, {4: 4, 8: 8}, 0, 8, observation=seen)
    assert {(r.strand, r.end5) for r in kept.collect()} == {("+", 40)}
    assert seen.get == {"n_sites": 5, "truncated_4": 3, "truncated_8": 4}


# Written order ---------------------------------------------------------------------------


def test_order_of_files_is_proved_and_refuted(spark, tmp_path):
    rng = random.Random(2)
    df = spark.createDataFrame([(rng.choice(["a", "b", None]), rng.randrange(500)) for _ in range(1000)], "k string, n long").repartition(4)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "90")
    try:
        sinks.write_tsv(df, str(tmp_path / "good"), ["k", "n"])
        df.write.option("sep", "\t").option("header", True).csv(str(tmp_path / "none"))
        for part in range(2):  # files in order in themselves, the second one before the first
            df.where(f"n % 2 = {1 - part}").coalesce(1).sortWithinPartitions("n").write.mode("append").csv(str(tmp_path / "mixed"))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    read = spark.read.schema("k string, n long").option("sep", "\t").option("header", True)
    good = order.ranked(read.csv(str(tmp_path / "good")), ["k", "n"]).orderBy("rank").collect()
    assert [(r.k, r.n) for r in good] == sorted(((r.k, r.n) for r in df.collect()), key=lambda x: (x[0] is None, x[0] or "", x[1]))
    assert [r["rank"] for r in good] == list(range(1, 1001)) and all(r.in_order and r.after_previous for r in good)
    files = order.file_order(order.placed(read.csv(str(tmp_path / "good"))), ["k", "n"])
    assert files.count() >= 12 and files.agg(F.sum("n_rows")).first()[0] == 1000
    assert order.ranked(read.csv(str(tmp_path / "none")), ["k", "n"]).where("not in_order").count() > 0
    mixed = order.file_order(order.placed(spark.read.schema("k string, n long").csv(str(tmp_path / "mixed"))), ["n"]).collect()
    assert all(r.in_order for r in mixed) and not all(r.after_previous for r in mixed)


def test_order_over_text_splits(spark, tmp_path):
    spark.range(5000).selectExpr("id", "concat('row number ', id) as t").coalesce(1).write.csv(str(tmp_path / "o"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for name in old:
            spark.conf.set(name, "4000")
        lines = spark.read.schema("id long, t string").csv(str(tmp_path / "o"))
        assert lines.rdd.getNumPartitions() > 10
        assert order.placed(lines).where("place <> id + 1").count() == 0
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)


# Sheets and aliases from files --------------------------------------------------------------


def test_what_was_read_for_each_line_of_a_sheet(spark, tmp_path):
    for sample, rows in (("a", ["c\t0\t5\tuncapped\t3\t+\ta", "c\t1\t5\tuncapped\t4\t+\ta"]), ("b", [])):
        folder = tmp_path / "d1" / "results" / "04.bed"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{sample}_genome.bed").write_text("".join(r + "\n" for r in rows))
    sheet = spark.createDataFrame([("sp", s, "m", "rep1", "t", "d1#x", None) for s in "ab"], schemas.SAMPLE_SHEET)
    got = {r["sample"]: (r.n_files, r.n_rows, r.count_frag) for r in tables.files_of_sheet(spark, sheet, str(tmp_path), "genome").collect()}
    assert got == {"a": (1, 2, 7), "b": (0, 0, 0)}


def test_aliases_of_several_archives(spark):
    first = spark.createDataFrame([("chr1", "A"), ("chr2", "B"), (None, "C"), ("chr9", None)], "UCSC string, genbank string")
    second = spark.createDataFrame([("chr1", "A"), ("chr3", "D")], "UCSC string, genbank string")
    assert {tuple(r) for r in tables.resolved_aliases(first, second).collect()} == {("A", "chr1"), ("B", "chr2"), ("D", "chr3")}
    for clash in (("chr5", "A"), ("chr1", "Z")):  # a second name, a second contig
        with pytest.raises(PySparkException, match="has two values"):
            tables.resolved_aliases(first, spark.createDataFrame([clash], "UCSC string, genbank string")).collect()


def test_alias_files_of_the_fixture(spark, tmp_path):
    fx.write_alias_files(spark, fx.genome_lengths(spark, SMALL), str(tmp_path / "a"))
    four = tables.read_alias_four(spark, str(tmp_path / "a" / "four"))
    assert {(r.UCSC, r.genbank) for r in four.collect()} == {("chr11", "chr1"), ("chr12", "chr2"), ("chrX", "chr3"), ("chrX_alt", "chr3"), ("chrUn_5", "chr5")} - {("chr12", "chr2")} | {
        (r.UCSC, r.genbank) for r in four.where("UCSC = 'chr12'").collect()
    }
    kept = tables.main_chromosomes(tables.without_alternates(four))
    assert {r.UCSC for r in kept.collect()} == {"chr11", "chr12", "chrX"}
    with pytest.raises(PySparkException, match="has two values"):
        tables.resolved_aliases(four.where("UCSC like 'chrX%'")).collect()


# Bins of many widths ----------------------------------------------------------------------


def test_intervals_of_any_length_are_two_rows_at_most(spark):
    rng = random.Random(6)
    rows = [(i, lo := rng.randrange(10**8), lo + rng.randrange(10 ** rng.randrange(1, 10))) for i in range(3000)] + [(-1, 0, 2 * 10**9), (-2, 5, 5), (-3, 255, 256)]
    df = spark.createDataFrame(rows, "i long, lo long, hi long")
    counts = R.binned_intervals(df, "lo", "hi").groupBy("i").count()
    assert counts.count() == len(rows) and counts.agg(F.max("count")).first()[0] <= 2
    levels = {r[0] for r in R.binned_intervals(df, "lo", "hi").select("_level").distinct().collect()}
    assert levels == set(R.BIN_LEVELS)


def test_join_of_intervals_of_any_length(spark):
    rng = random.Random(7)
    points = [(rng.choice("ab"), rng.randrange(10 ** rng.randrange(1, 9)), i) for i in range(300)]
    spans = [(rng.choice("ab"), lo := rng.randrange(10 ** rng.randrange(1, 9)), lo + rng.randrange(10 ** rng.randrange(1, 9)) - 2, j) for j in range(200)]
    p = spark.createDataFrame(points, "key string, pos long, i long")
    s = spark.createDataFrame(spans, "key string, lo long, hi long, j long")
    got = R.range_join(p, s, ["key"], "pos", "lo", "hi", bin_bits=R.BIN_LEVELS).select("i", "j").collect()
    want = {(i, j) for k, x, i in points for key, lo, hi, j in spans if k == key and lo <= x <= hi}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_members_of_a_region_of_100_megabases(spark):
    rows = [("k", at, at + 1000) for at in range(0, 10**8, 10**6)]
    rows += [("k", 0, 10**8), ("k", 10**8 + 50, 10**8 + 60)]
    members = R.region_members(spark.createDataFrame(rows, "key string, start long, end long"), ["key"], 5)
    got = {(r.start, r.region_start, r.region_end) for r in members.collect()}
    assert got == {(s, 0, 10**8) for _, s, _ in rows[:-1]} | {(10**8 + 50, 10**8 + 50, 10**8 + 60)}
