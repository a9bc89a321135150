"""Hotspots, distributions, known sites, contingency."""

import random

import pytest

from cutsites.operators import qc
from cutsites.profile import HotspotRule

PEAKS = "species string, chr string, strand string, library_method string, start long, peak_id string"


def test_hotspot_bounds_and_species(spark):
    rows = [("sp", "c", "+", "L1", p - 1, f"p{p}") for p in (1, 42, 43, 44, 88, 90)]
    rows.append(("other", "c", "+", "L1", 41, "q42"))
    peaks = spark.createDataFrame(rows, PEAKS)
    lengths = spark.createDataFrame([("c", 100), ("z", 5)], "chr string, length long")
    rules = qc.hotspot_rules(
        spark, [HotspotRule("c", 0.42, 0.43, True, True, "sp"), HotspotRule("c", lo=0.88), HotspotRule("c", hi=0.01)]
    )
    found = qc.hotspot_peaks(qc.peak_positions(peaks, lengths), rules)
    assert sorted(r.peak_id for r in found.collect()) == ["p42", "p43", "p90"]
    left = sorted(r.peak_id for r in qc.outside_hotspots(peaks, lengths, rules).collect())
    assert left == ["p1", "p44", "p88", "q42"]
    assert left == sorted(r.peak_id for r in qc.hotspot_filter(peaks, found).collect())


def test_anti_filter_keeps_null_ids(spark):
    ratios = spark.createDataFrame([("a",), (None,)], "peak_id string")
    excluded = spark.createDataFrame([("a",), (None,)], "peak_id string")
    assert [r.peak_id for r in qc.hotspot_filter(ratios, excluded).collect()] == [None]


@pytest.mark.parametrize("tile_bits", [3, 14])
def test_ecdf_equals_brute_force(spark, tile_bits):
    rng = random.Random(tile_bits)
    rows = [("sp", rng.choice(["c", "d"]), "+", rng.choice(["L1", "TA"]), rng.randrange(0, 200), "p") for _ in range(400)]
    lengths = spark.createDataFrame([("c", 1000), ("d", 500)], "chr string, length long")
    positions = qc.peak_positions(spark.createDataFrame(rows, PEAKS), lengths)
    got = {
        (r.chr, r.library_method, r.coor_per): r.ecdf
        for r in qc.position_ecdf(positions, ["chr", "library_method"], tile_bits).collect()
    }
    want = {}
    for _, c, _, m, p, _ in rows:
        same = [x[4] for x in rows if x[1] == c and x[3] == m]
        want[(c, m, (p + 1) / (1000 if c == "c" else 500))] = sum(x <= p for x in same) / len(same)
    assert got == pytest.approx(want)


def test_unknown_contig_has_no_position(spark):
    peaks = spark.createDataFrame([("sp", "?", "+", "L1", 5, "p")], PEAKS)
    lengths = spark.createDataFrame([("c", 0)], "chr string, length long")
    assert qc.peak_positions(peaks, lengths).first().coor_per is None


def test_known_sites_and_contingency(spark):
    ratios = spark.createDataFrame(
        [("t0", "p", "s", "L1", 2), ("t0", "p", "s", "L1", 2), ("t0", "x", "s", "L1", 9)],
        "tier string, peak_id string, sample string, library_method string, cs long",
    )
    design = spark.createDataFrame([("s", 1_000_000, "r1", "A")], "sample string, count_frag_sample long, sample_rep string, sample_type string")
    got = [tuple(r) for r in qc.known_site_report(ratios, design, ["p"]).collect()]
    assert got == [("t0", "p", "s", "L1", "r1", "A", 2, 2.0)]
    more = ratios.union(ratios.limit(1).selectExpr("tier", "peak_id", "sample", "'new' as library_method", "cs"))
    table = qc.contingency(more, "peak_id", "library_method").orderBy("peak_id", "library_method")
    assert [tuple(r) for r in table.collect()] == [("p", "L1", 2), ("p", "new", 1), ("x", "L1", 1)]
    assert [r.peak_id for r in qc.with_ids(ratios, ["x"]).collect()] == ["x"]


def test_distribution_evaluates_its_input_once(spark):
    positions = spark.range(100).selectExpr("'c' as chr", "id as start", "id / 100.0D as coor_per")
    plan = qc.position_ecdf(positions, ["chr"], tile_bits=3)
    assert len(plan.collect()) == 100
    text = plan._jdf.queryExecution().executedPlan().toString()
    final = text.split("Initial Plan")[0]
    assert final.count("Range (0, 100") == 1 and "ReusedExchange" in final
