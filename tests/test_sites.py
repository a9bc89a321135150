"""Counts, reproducibility, methods, tiers and ratios on hand-made rows."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cutsites import schemas
from cutsites.operators import counts as C
from cutsites.operators import ratio, sites, tiers
from cutsites.profile import PROFILE_CONTROL, PROFILE_HUMAN, PROFILE_MULTI, Profile, RatioWindow
from cutsites.session import configure, local_table

SITE = "species string, library_method string, chr string, strand string, end5 long, cpm_end5_mean double, n_design long"


def sheet_rows(spark, rows):
    return local_table(spark, rows, schemas.SAMPLE_SHEET)


def test_sheet_recode(spark):
    rows = [
        ("mouse", "s1", "ligation_oligo1", "rep1", "A", "d1", None),
        ("mouse", "s2", "tailing_polyC", "rep2", "A", "d1", "Y"),
        ("mouse", "s3", "other", "rep9", "A", "d1", "N"),
    ]
    got = C.recode_sheet(sheet_rows(spark, rows), PROFILE_MULTI).orderBy("sample").collect()
    assert [(r.sample, r.sample_recode, r.library_method, r.sample_rep) for r in got] == [
        ("s1", "mouse|L1|r1|A", "L1", "r1"),
        ("s3", None, "other", None),
    ]
    coded = C.recode_sheet(sheet_rows(spark, [("Drosophila", "s", "ligation", "r1", "endo", "d", None)]), PROFILE_CONTROL)
    assert coded.first().sample_recode == "Dr|L1|r1|endo"
    assert C.recode_sheet(sheet_rows(spark, rows[:1]), PROFILE_HUMAN).first().species == "human"


FRAGS = [
    ("chr1", 9, 20, "uncapped", 5, "+", "raw1"),
    ("chr1", 9, 30, "x", 2, "+", "raw2"),
    ("chr1", 9, 30, "capped", 100, "+", "raw1"),
    ("chr1", 0, 10, None, 50, "-", "raw1"),
    ("chrPt", 0, 10, "x", 7, "-", "raw1"),
    ("chr2", 0, 10, "x", 1, "-", "unlisted"),
]


def test_sizes_and_counts(spark):
    """Two raw samples share one name; sizes keep capped fragments, counts do not."""
    frags = spark.createDataFrame(FRAGS, schemas.FRAGMENTS)
    rows = [("sp", s, "ligation", "r1", "A", "d", None) for s in ("raw1", "raw2")]
    profile = replace(PROFILE_CONTROL, species_codes={})
    sheet = C.recode_sheet(sheet_rows(spark, rows), profile)
    sizes = dict(map(tuple, C.library_sizes(frags, frags.limit(0), sheet).collect()))
    assert sizes == {"sp|L1|r1|A": 164, "unlisted": 1}
    counts = C.count_end5(frags, sheet, profile)
    got = sorted((str(r.sample), r.chr, r.end5, r.count_end5) for r in counts.collect())
    assert got == [("None", "chr2", 10, 1), ("sp|L1|r1|A", "chr1", 10, 7)]
    design = C.sample_design(C.library_sizes(frags, frags.limit(0), sheet), sheet, profile).collect()
    assert [(r.sample, r.n_rep, r.n_type) for r in design] == [("sp|L1|r1|A", 1, 1)]
    assert C.samples_without_size(counts.where("sample is not null"), C.library_sizes(frags, frags.limit(0), sheet)).count() == 0


def test_reproducible_needs_every_replicate(spark):
    rows = []
    for rep, kinds in (("r1", "AN"), ("r2", "A")):
        for kind in kinds:
            rows.append(("sp", f"sp|L1|{rep}|{kind}", "L1", rep, kind, "chr1", "+", 7, 10))
    rows.append(("sp", "sp|L1|r1|A", "L1", "r1", "A", "chr1", "+", 9, 10))
    counts = spark.createDataFrame(
        rows, "species string, sample string, library_method string, sample_rep string, sample_type string, chr string, strand string, end5 long, count_end5 long"
    )
    design = spark.createDataFrame(
        [(f"sp|L1|{r}|{t}", r, t, 1_000_000, 2, 2) for r in ("r1", "r2") for t in "AN"],
        "sample string, sample_rep string, sample_type string, count_frag_sample long, n_rep long, n_type long",
    )
    tiled = sites.tile_counts(counts)
    hits = sites.reproducible_sites(tiled, design)
    assert sorted((r.end5, r.sample_rep, r.cpm_end5_sum) for r in hits.collect()) == [(7, "r1", 20.0), (7, "r2", 10.0)]
    means = [(r.end5, r.cpm_end5_mean, r.n_design) for r in sites.site_means(hits).collect()]
    assert means == [(7, 7.5, 4)]
    assert means == [(r.end5, r.cpm_end5_mean, r.n_design) for r in sites.reproducible_site_means(tiled, design).collect()]


def site_df(spark, rows):
    return spark.createDataFrame([("sp", m, "chr1", s, p, c, 9) for m, s, p, c in rows], SITE)


def test_pair_and_final_merge(spark):
    """TA and TC within the gap tighten to their picks; the ligation site inside joins them."""
    rows = [("TA", "+", 100, 1.0), ("TC", "+", 106, 2.0), ("L1", "+", 103, 3.0), ("L2", "+", 107, 4.0), ("TA", "-", 100, 1.0)]
    df = site_df(spark, rows)
    pair = tiers.merge_pair(df, ("TA", "TC"), 5)
    combined = tiers.pair_combined(pair, ("TA", "TC")).collect()
    assert [(r.start, r.end, r.id) for r in combined] == [(99, 106, "sp|chr1|+|100|TA,sp|chr1|+|106|TC")]
    single = tiers.pair_single(pair, ("TA", "TC")).collect()
    assert [(r.start, r.end, r.strand, r.id) for r in single] == [(99, 100, "-", "sp|chr1|-|100|TA")]
    merged = tiers.merge_methods(df, PROFILE_HUMAN)
    assert sorted((r.start, r.end, r.n_sites) for r in merged.collect()) == [(99, 100, 1), (99, 107, 4)]
    tiered = tiers.assign_tiers(merged, PROFILE_HUMAN).collect()
    assert [(r.tier, r.start, r.end, r.peak_id) for r in tiered] == [("t0", 99, 107, "sp|chr1|100|+")]
    long = tiers.tier_sites(tiers.assign_tiers(merged, PROFILE_HUMAN), PROFILE_HUMAN.methods)
    assert sorted((r.library_method, r.peak) for r in long.collect()) == [("L1", 103), ("L2", 107), ("TA", 100), ("TC", 106)]


def test_single_methods_never_merge_in_the_pair_pass(spark):
    df = site_df(spark, [("L1", "+", 100, 1.0), ("L2", "+", 102, 1.0)])
    assert tiers.merge_methods(df, PROFILE_HUMAN).count() == 2
    assert tiers.assign_tiers(tiers.merge_methods(df, PROFILE_HUMAN), PROFILE_HUMAN).count() == 0


def test_profile_rejects_a_wider_pair_gap():
    with pytest.raises(ValueError):
        Profile(methods=("TA", "TC"), tiers=(), method_gap=3, pair_gap=5)


def ratio_rows(spark, counts, strand="+", windows=(RatioWindow(100, True),), peaks=((1000,),)):
    rows = [("sp", "L1", "chr1", strand, p, "sp|L1|r1|A", "r1", c) for p, c in counts]
    df = spark.createDataFrame(
        rows, "species string, library_method string, chr string, strand string, end5 long, sample string, sample_rep string, count_end5 long"
    )
    peak_df = spark.createDataFrame(
        [("t0", "sp", "L1", "chr1", strand, p[0] - 1, p[0]) for p in peaks],
        "tier string, species string, library_method string, chr string, strand string, start long, peak long",
    )
    got = ratio.cleavage_ratio(sites.tile_counts(df), peak_df, windows).collect()
    return {(r.ratio_type, r.peak): (r.cs, r.other, r.ratio) for r in got}


def test_ratio_window_and_shoulder(spark):
    """Shoulder 1-2 bp is left out, 3 bp and offset + 2 count, offset + 3 does not."""
    counts = [(1000, 12), (999, 50), (998, 50), (997, 1), (898, 2), (897, 100), (1005, 3)]
    windows = (RatioWindow(100, True), RatioWindow(100, False), RatioWindow(50, True))
    got = ratio_rows(spark, counts, "+", windows)
    assert got == {
        ("u_100", 1000): (12, 3, 3.0),
        ("ud_100", 1000): (12, 6, 12 / 7),
        ("u_50", 1000): (12, 1, 6.0),
    }
    assert ratio_rows(spark, counts, "-") == {("u_100", 1000): (12, 3, 3.0)}


def test_ratio_only_other_only_site_and_none(spark):
    assert ratio_rows(spark, [(990, 4)]) == {("u_100", 1000): (0, 4, 0.0)}
    assert ratio_rows(spark, [(1000, 4)]) == {("u_100", 1000): (4, 0, 4.0)}
    assert ratio_rows(spark, [(999, 4), (1010, 4)]) == {}


def test_ratio_window_over_a_tile_border(spark):
    """Windows that cross a tile, and peaks on both sides of it, see every count once."""
    edge = 1 << 14
    counts = [(edge - 20, 1), (edge, 2), (edge + 1, 4), (edge + 20, 8)]
    got = ratio_rows(spark, counts, "+", (RatioWindow(100, False),), ((edge,), (edge + 1,)))
    assert got == {("ud_100", edge): (2, 9, 2 / 10), ("ud_100", edge + 1): (4, 9, 4 / 10)}


def test_hierarchical_mean_counts_missing_as_zero(spark):
    rows = [("t0", "p", "u_100", "L1", "r1", 3.0, 2, 2), ("t0", "p", "u_100", "L1", "r2", 1.0, 2, 2), ("t0", "p", "u_100", "TA", "r1", 6.0, 3, 1)]
    df = spark.createDataFrame(rows, "tier string, peak_id string, ratio_type string, library_method string, sample_rep string, ratio double, n_rep long, n_type long")
    got = ratio.hierarchical_mean(df.withColumn("n_design", F.expr("n_rep * n_type")), 4).collect()
    assert got[0].ratio_mean == pytest.approx(((3 / 2 + 1 / 2) / 2 + 6 / 3) / 4)


def test_background_and_edges(spark):
    df = site_df(spark, [("L1", "+", 150, 1.0), ("L1", "+", 200, 1.0), ("L1", "+", 101, 1.0)])
    df = df.withColumn("region_start", F.col("end5") - 1).withColumn("region_end", F.col("end5"))
    back = spark.createDataFrame([("sp", "L1", "chr1", "+", 150)] * 2, "species string, library_method string, chr string, strand string, end5 long")
    lengths = spark.createDataFrame([("chr1", 301)], schemas.GENOME_LENGTHS)
    kept = sites.background_filter(df, back)
    assert sorted(r.end5 for r in kept.collect()) == [101, 200]
    assert sorted(r.end5 for r in sites.contig_edge_filter(kept, lengths, 100).collect()) == [200]
    n_rep = spark.createDataFrame([("sp", "L1", 2)], "species string, library_method string, n long")
    assert sites.control_sites(back, n_rep).count() == 1
    assert sites.control_sites(back.limit(1), n_rep).count() == 0
    assert sites.control_sites(back).count() == 1


def test_species_codes_and_contig_pairs(spark):
    """Codes in the sample key meet names in the sheet; contigs count for their own species only."""
    names = ("Drosophila", "Trichoderma")
    rows = [(sp, f"raw{i}", "ligation", r, t, "d", None) for sp in names for i, (r, t) in enumerate([("r1", "A"), ("r2", "A"), ("r1", "endo"), ("r2", "endo")])]
    rows = [(sp, f"{sp}-{s}", *rest) for sp, s, *rest in rows]
    sheet = C.recode_sheet(sheet_rows(spark, rows), PROFILE_CONTROL)
    frags = spark.createDataFrame([(c, 5, 9, "x", 3, "+", r[1]) for r in rows for c in ("c1", "c2")], schemas.FRAGMENTS)
    sizes = C.library_sizes(frags, frags.limit(0), sheet)
    n_rep = C.number_of(sizes, sheet, "sample_rep", "endo")
    assert sorted(map(tuple, n_rep.collect())) == [(n, "L1", 2) for n in names]
    counts = C.count_end5(frags, sheet, PROFILE_CONTROL)
    control, _ = C.split_controls(counts, "endo")
    assert sites.control_sites(control).count() == 4
    assert sites.control_sites(control, n_rep).count() == 4
    main = spark.createDataFrame([("Drosophila", "c1"), ("Trichoderma", "c2")], schemas.MAIN_CONTIGS)
    grid = C.on_grid(counts, PROFILE_CONTROL, main)
    assert {(r.species, r.chr) for r in grid.collect()} == {("Drosophila", "c1"), ("Trichoderma", "c2")}


def test_a_task_reads_a_bounded_part_of_the_counts(spark):
    """What one task of the layout reads does not grow with the counts as long as there are partitions left."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", "64")
    configure(own)
    n = 3_000_000
    counts = own.range(n).selectExpr(
        "'sp' as species", "'L1' as library_method", "'chr1' as chr", "'+' as strand", "abs(xxhash64(id)) % 100000000 + 1 as end5",
        "concat('s', hex(hash(id, 1))) as sample", "xxhash64(id, 2) as count_end5",
    )
    used = [F.max(c) for c in ("end5", "sample", "count_end5")]  # so that these columns travel
    per_task = [r["n"] for r in sites.tile_counts(counts).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), *used).collect()]
    assert sum(per_task) == n and max(per_task) < n / 7


def test_a_size_of_partitions_that_the_user_set_stays(spark):
    name, own = "spark.sql.adaptive.advisoryPartitionSizeInBytes", spark.newSession()
    own.conf.set(name, "32m")
    assert configure(own).conf.get(name) == "32m"
    assert configure(spark.newSession()).conf.get(name) == "8m"
