"""The whole analysis on the smallest scale: plan shape, invariants, repeatability, SQL."""

from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from cutsites.plans.find_candidates import stages
from cutsites.session import scratch_path
from cutsites.workloads import fixtures as fx
from cutsites.workloads import oracle, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark):
    return stages(fx.inputs(spark, SF), fx.FOUR)


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def test_every_query_has_sql():
    assert set(queries.queries()) == set(oracle.oracle_sql())
    assert set(queries.queries()) <= set(entry_module.queries()) and set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_fragments_are_aggregated_once(spark, run):
    """One scan for the sizes, one for the counts; both users of the counts share a shuffle."""
    run.info.collect()
    plan = run.info._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")]
    assert sum("FileScan parquet" in line and "l_quantity" in line for line in final.splitlines()) == 2
    assert any("ReusedExchange" in line and "count_end5" in line for line in final.splitlines())
    assert "CartesianProduct" not in final and "BroadcastNestedLoopJoin" not in final


def test_control_run_also_aggregates_once(spark):
    info = stages(fx.inputs(spark, SF, control=True), fx.THREE).info
    info.collect()
    plan = info._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")]
    assert sum("FileScan parquet" in line and "l_quantity" in line for line in final.splitlines()) == 2


def test_large_sides_are_not_moved_again(spark):
    """Without broadcasts the range join still uses the layout of the counts."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        s = stages(fx.inputs(spark, SF), fx.FOUR)
        plan = s.ratios._jdf.queryExecution().executedPlan().toString().splitlines()
        at = next(i for i, line in enumerate(plan) if "SortMergeJoin" in line and "_bin" in line)
        first_exchange = next(line for line in plan[at:] if "Exchange" in line)
        assert "REPARTITION_BY_COL" in first_exchange
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_invariants(run):
    total = fx.fragments(run.counts.sparkSession, SF).where("type <> 'capped'").agg(F.sum("count_frag")).first()[0]
    assert run.counts.agg(F.sum("count_end5")).first()[0] == total
    sizes = run.tiered.selectExpr("size(filter(array(pick_L1, pick_L2, pick_TA, pick_TC), p -> p is not null)) as n", "tier")
    assert {(r.tier, r.n) for r in sizes.distinct().collect()} == {("t0", 4), ("t1", 3), ("t2", 2)}
    assert run.tiered.count() == run.tiered.select("peak_id").distinct().count()


def test_twice_and_from_written_counts(spark, run):
    first = rows(run.info.withColumn("ratio_u_100", F.round("ratio_u_100", 6)))
    assert first == rows(run.info.withColumn("ratio_u_100", F.round("ratio_u_100", 6)))
    stored = stages(fx.inputs(spark, SF), fx.FOUR, scratch_path(spark, "counts")).info
    assert first == rows(stored.withColumn("ratio_u_100", F.round("ratio_u_100", 6)))


def test_grid_restricts_contigs(spark):
    some = stages(fx.inputs(spark, SF), replace(fx.FOUR, chr_allow=("chr1",)))
    assert {r.chr for r in some.info.select("chr").distinct().collect()} == {"chr1"}
    assert some.counts.select("chr").distinct().count() == 5


@pytest.mark.parametrize("name", ["tier_info_full", "tier_info_3m_full", "cleavage_ratio_grid", "merge_d5_members"])
def test_against_sql(spark, name):
    db = duckdb.connect()
    for table in ("lineitem", "orders"):
        db.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got = entry_module.queries()[name](spark, SF)
    want = db.sql(entry_module.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    expected = want.select(*[f'"{c}"' for c in columns]).fetchall()
    assert rows(got) == sorted(map(tuple, expected), key=repr)
