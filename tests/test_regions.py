"""Interval merge, picks and range join against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from cutsites.functions.measures import pick
from cutsites.operators import regions as R


def brute_merge(rows, gap):
    """Sweep of (key, start, end) rows."""
    out = []
    for key in sorted({r[0] for r in rows}):
        current = None
        for _, s, e in sorted(r for r in rows if r[0] == key):
            if current and s - current[2] <= gap:
                current[2] = max(current[2], e)
                current[3] += 1
            else:
                current = [key, s, e, 1]
                out.append(current)
    return sorted(map(tuple, out))


@pytest.mark.parametrize("gap", [0, 5])
@pytest.mark.parametrize("tile_bits", [3, 5, 14])
def test_merge_equals_sweep(spark, gap, tile_bits):
    rng = random.Random(gap * 100 + tile_bits)
    rows = []
    for key in "ab":
        for _ in range(300):
            s = rng.randrange(0, 2500)
            rows.append((key, s, s + rng.choice([0, 1, 1, 2, 7, 40, 300 if rng.random() < 0.05 else 3])))
    df = spark.createDataFrame(rows, "key string, start long, end long").repartition(5)
    got = R.merge_regions(df, ["key"], gap, [R.count_members("n")], tile_bits)
    assert sorted(map(tuple, got.collect())) == brute_merge(rows, gap)


def test_gap_bounds(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 6, 7), ("a", 13, 14), ("a", 14, 15)], "key string, start long, end long")
    assert sorted(map(tuple, R.merge_regions(df, ["key"], 5).collect())) == [("a", 0, 7), ("a", 13, 15)]
    assert sorted(map(tuple, R.merge_regions(df, ["key"], 0).collect())) == [("a", 0, 1), ("a", 6, 7), ("a", 13, 15)]
    with pytest.raises(ValueError):
        R.merge_regions(df, ["key"], 8, tile_bits=3)


def test_chain_over_many_tiles_is_one_region(spark):
    """A dense contig: every tile is one border island."""
    df = spark.range(0, 4000).selectExpr("'a' as key", "id * 2 as start", "id * 2 + 1 as end", "id as v")
    got = R.merge_regions(df, ["key"], 1, [R.Agg("v", "max", "v"), R.count_members("n")], tile_bits=4).collect()
    assert [tuple(r) for r in got] == [("a", 0, 7999, 3999, 4000)]


def test_best_per_region_ties_and_nulls(spark):
    rows = [("a", 1, 2, 5.0, "z"), ("a", 2, 3, 5.0000000001, "y"), ("a", 3, 4, None, "x"), ("a", 50, 51, None, "w")]
    df = spark.createDataFrame(rows, "key string, start long, end long, score double, id string")
    got = R.best_per_region(df, ["key"], 0, pick("score", "id", ["id"])).select("start", "end", "best.id")
    assert sorted(map(tuple, got.collect())) == [(1, 4, "y"), (50, 51, "w")]


def test_members_and_lists(spark):
    rows = [("a", p, p + 1, f"i{p:05d}") for p in (1, 3, 10, 30, 31, 32)]
    df = spark.createDataFrame(rows, "key string, start long, end long, id string")
    members = R.region_members(df, ["key"], 5, tile_bits=3, bin_bits=2)
    assert sorted((r.region_start, r.region_end, r.id) for r in members.collect()) == [
        (1, 4, "i00001"), (1, 4, "i00003"), (10, 11, "i00010"), (30, 33, "i00030"), (30, 33, "i00031"), (30, 33, "i00032"),
    ]
    lists = spark.createDataFrame([("r1", "a,b"), ("r2", "c")], "region string, id string")
    assert sorted((r.region, r.id) for r in R.split_ids(lists).collect()) == [("r1", "a"), ("r1", "b"), ("r2", "c")]


def test_members_of_a_long_region(spark):
    """A region of 9,000 positions is one region, whatever the tiles, with one row per member."""
    df = spark.range(0, 9000, 3).selectExpr("'a' as key", "id as start", "id + 1 as end", "string(id) as id")
    members = R.region_members(df, ["key"], 5, tile_bits=9)
    assert members.select("region_start", "region_end").distinct().collect() == [(0, 8998)]
    assert members.count() == 3000


def test_equal_intervals_are_combined_before_the_window(spark):
    """One deep locus is one row for the sort of its tile."""
    df = spark.range(5000).selectExpr("'a' as key", "id % 3 as start", "10L as end", "id % 2 as v")
    pieces = R._distinct_pieces(R._cut_at_tiles(df, 14), ["key"], [R.count_members("n"), R.Agg("v", "sum", "v")])
    assert pieces.count() == 3
    got = R.merge_regions(df, ["key"], 0, [R.count_members("n"), R.Agg("v", "sum", "v")])
    assert [tuple(r) for r in got.collect()] == [("a", 0, 10, 5000, 2500)]


def test_range_join_equals_theta_join(spark):
    rng = random.Random(3)
    points = [(rng.choice("ab"), rng.randrange(0, 3000), i) for i in range(500)]
    spans = [(rng.choice("ab"), lo, lo + rng.randrange(-1, 400), j) for j, lo in enumerate(rng.sample(range(-50, 3000), 60))]
    p = spark.createDataFrame(points, "key string, pos long, i long")
    s = spark.createDataFrame(spans, "key string, lo long, hi long, j long")
    got = R.range_join(p, s, ["key"], "pos", "lo", "hi", bin_bits=5).select("i", "j")
    want = [(i, j) for k1, pos, i in points for k2, lo, hi, j in spans if k1 == k2 and lo <= pos <= hi]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_no_task_depends_on_a_whole_contig(spark):
    """The windows of the merge are keyed by tile or border group, never by contig alone."""
    df = spark.range(10).selectExpr("'a' as key", "id as start", "id + 1 as end")
    plan = R.merge_regions(df, ["key"], 5, few=True)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert len(exchanges) == 2
    assert "tile" in exchanges[1] and "_group" in exchanges[0]
