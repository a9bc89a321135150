"""Mixing, sharding, the whole pipeline, and the SQL of the text queries."""

from __future__ import annotations

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cutsites.llm import mixing, oracle, queries, sharding

SMALL = "/root/testdata/sf0.001"


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Water filling by repetition: full sources give their excess to the others."""
    keys = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {k: weights[i % len(weights)] for i, k in enumerate(keys)}
    budget, target, open_ = share * sum(sizes.values()), {}, set(keys)
    while open_:
        rest, total = budget - sum(target.values()), sum(weight[k] for k in open_)
        full = {k for k in open_ if rest * weight[k] / total >= most * sizes[k]}
        if not full:
            target |= {k: rest * weight[k] / total for k in open_}
            break
        target |= {k: float(most * sizes[k]) for k in full}
        open_ -= full
    return target


def test_mix_follows_targets(make_docs):
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.integers(0, 60)), ["big", "a", "ä", None, "tiny"][min(int(rng.integers(0, 12)), 4)] if i % 3 else "big") for i in range(900)]
    got = mixing.mix(make_docs(rows)).collect()
    assert len(got) == 900
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want, taken = brute_targets(sizes), {}
    for r in got:
        assert r.size == len(rows[r.doc_id][1].split()) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source]) and r.taken in (0, r.size, 2 * r.size)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert sum(taken.values()) <= 1.5 * sum(sizes.values()) < sum(taken.values()) + 61
    assert all(abs(taken[s] - want[s]) <= 130 for s in want)
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in mixing.mix(make_docs(rows)).collect())


def test_mix_of_odd_rows(odd, empty):
    got = mixing.mix(odd)
    assert got.count() == 11 and got.where("text is null and (size > 0 or taken > 0)").count() == 0
    assert got.where("taken > 2 * size").count() == 0
    assert mixing.mix(empty).count() == 0


def test_shards_are_exact(make_docs):
    docs = make_docs([(i, f"text {i}") for i in range(1003)], clash=True)
    got = sharding.shard(docs, 16).collect()
    assert len(got) == 1003 and {r.doc_id for r in got} == set(range(1003))
    for s in range(16):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(1003 // 16 + (s < 1003 % 16)))
    again = sharding.shard(docs.repartition(7), 16).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in got} == {r.doc_id: (r.shard, r.slot) for r in again}
    other = sharding.shard(docs, 16, seed=1).collect()
    assert {r.doc_id: r.shard for r in got} != {r.doc_id: r.shard for r in other}


def test_shards_of_odd_rows(odd, empty):
    got = sharding.shard(odd, 4)
    assert got.count() == 11 and sorted(r["count"] for r in got.groupBy("shard").count().collect()) == [2, 3, 3, 3]
    assert got.columns == [c for c in odd.columns if c != "shard"] + ["shard", "slot"]
    assert sharding.shard(empty, 4).count() == 0


def test_hypergeometric_law():
    rng = np.random.default_rng(0)
    for good, bad, drawn in ((50, 70, 40), (500, 700, 400)):
        draws = [sharding.hypergeometric(rng, good, bad, drawn) for _ in range(4000)]
        n = good + bad
        mean, variance = drawn * good / n, drawn * good / n * bad / n * (n - drawn) / (n - 1)
        assert np.mean(draws) == pytest.approx(mean, abs=5 * (variance / 4000) ** 0.5)
        assert np.var(draws) == pytest.approx(variance, rel=0.12)
    assert 0 <= sharding.hypergeometric(rng, 10**12, 10**13, 10**11) <= 10**11
    matrix = sharding.communication_matrix([100, 0, 57, 3], [40, 40, 40, 40], 5)
    assert matrix.sum(1).tolist() == [100, 0, 57, 3] and matrix.sum(0).tolist() == [40] * 4


def test_queries_against_sql(spark):
    db = duckdb.connect()
    for name in ("documents", "benchmark", "labels", "conversations"):
        db.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    for name, sql in oracle.oracle_sql().items():
        got = queries.queries()[name](spark, SMALL)
        relation = db.execute(sql)
        columns = [d[0] for d in relation.description]
        assert sorted(columns) == sorted(got.columns)
        assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(relation.fetchall(), key=repr)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SMALL).cache()
        kept[name] = (before.count(), docs.count())
        if name != "sharding":
            assert docs.dtypes == before.dtypes
    assert kept["quality_rules"][1] < kept["quality_rules"][0] and kept["near_duplicates"][1] < kept["near_duplicates"][0]
    assert kept["decontamination"][1] == kept["decontamination"][0]
    assert sorted({r.shard for r in docs.collect()}) == list(range(16))
    direct = corpus_pipeline.run(spark, SMALL)
    key = lambda df: sorted((r.doc_id, r.shard, r.slot, r.text) for r in df.collect())
    assert key(direct) == key(docs)
    # Brute force: no benchmark window is left, no two texts are equal but repeats of one id.
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    windows = set()
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
    by_text = {}
    for r in docs.collect():
        w = words(r.text)
        assert not any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9))
        by_text.setdefault(r.text, set()).add(r.doc_id)
    assert all(len(ids) == 1 for ids in by_text.values())


def test_pipeline_stages_on_odd_rows(spark, tmp_path, odd, empty):
    folder = str(tmp_path)
    spark.createDataFrame([(4, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "one")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for docs in (odd.select("doc_id", "text", "lang", "source", "n_chars"), empty):
        docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, folder)
            assert got.count() <= 2 * docs.count(), name
            if name != "sharding":
                assert got.columns == docs.columns


def test_every_operator_has_one_query():
    names = list(queries.queries())
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert F is not None
