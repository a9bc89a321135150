"""Column expressions on hand-made rows."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cutsites.functions import coordinates as co
from cutsites.functions import keys as k
from cutsites.functions.measures import cpm, site_ratio
from cutsites.functions.sequences import identity, identity_of_length, reverse_complement


def one(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_ends_by_strand(spark):
    df = spark.createDataFrame([(10, 30, "+"), (10, 30, "-"), (10, 30, None)], "s long, e long, strand string")
    got = one(df, co.end5(F.col("s"), F.col("e"), F.col("strand")), co.end3(F.col("s"), F.col("e"), F.col("strand")))
    assert got == [(11, 30), (30, 11), (None, None)]


def test_relative_position_and_slop(spark):
    df = spark.createDataFrame([("+",), ("-",)], "strand string")
    got = one(
        df,
        co.relative_position(F.lit(95), F.lit(100), F.col("strand")),
        co.slop_start(F.lit(5), F.col("strand"), 10),
        co.slop_end(F.lit(6), F.col("strand"), 10, F.lit(12)),
    )
    assert got == [(-5, 0, 6), (5, 5, 12)]


def test_keys_are_null_propagating_and_split_back(spark):
    df = spark.createDataFrame([("a", "m", "r1", "t"), ("a", None, "r1", "t")], "species string, library_method string, sample_rep string, sample_type string")
    assert one(df, k.sample_key()) == [("a|m|r1|t",), (None,)]
    ids = spark.createDataFrame([("x|7|y",), ("x|q",)], "id string")
    got = one(ids, *k.split_into(F.col("id"), {"a": "string", "n": "bigint", "c": "string"}), k.last_token(F.col("id")))
    assert got == [("x", 7, "y", "y"), ("x", None, None, "q")]


def test_recode_keeps_and_case_match_drops(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    names = {"a": "A"}
    assert one(df, k.recode(F.col("v"), names), k.case_match(F.col("v"), names)) == [("A", "A"), ("b", None), (None, None)]


def test_regex_helpers_touch_the_first_match_only(spark):
    df = spark.createDataFrame([("id(+)x(-)", "run1#a#b"), ("id", "run2#"), ("(-)", "plain")], "n string, d string")
    got = one(df, k.without_strand_suffix(F.col("n")), k.without_comment(F.col("d")))
    assert got == [("idx(-)", "run1"), ("id", "run2#"), ("", "plain")]


def test_measures(spark):
    df = spark.createDataFrame([(5, 1000, 4), (5, 0, 0)], "c long, n long, o long")
    assert one(df, cpm(F.col("c"), F.col("n")), cpm(F.col("c"), F.col("n"), 1), site_ratio(F.col("c"), F.col("o"))) == [
        (5000.0, 6000.0, 1.0),
        (None, None, 5.0),
    ]


def test_sequences(spark):
    df = spark.createDataFrame([("ACGT", "ACGAT"), ("ACGT", "acgt"), ("ACGT", "ACG")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    assert one(df, identity(a, b), identity_of_length(a, b, 4), identity(a, b, False)) == [
        (3, 3, 3),
        (0, 0, 4),
        (None, None, None),
    ]
    assert one(df.limit(1), reverse_complement(F.lit("AACGTc"))) == [("gACGTT",)]


def test_packed_identity_equals_letter_by_letter(spark):
    """All letters of sequence files, both cases, at lengths around the word size."""
    rng = random.Random(9)
    letters = "ACGT" * 6 + "acgt" * 2 + "NnRYSWKMBDHVUXryswkmbdhvux-.*"
    rows = []
    for n in (0, 1, 4, 10, 30, 31, 32, 61, 62) * 12:
        oligo = "".join(rng.choice(letters) for _ in range(n))
        seq = "".join(x if rng.random() < 0.6 else rng.choice(letters) for x in oligo) + "".join(rng.choice(letters) for _ in range(rng.randrange(3)))
        rows.append((oligo, seq if rng.random() < 0.9 else seq[: n // 2]))
    df = spark.createDataFrame(rows + [(None, "A"), ("A", None)], "a string, b string")
    got = one(df, "a", "b", identity(F.col("a"), F.col("b")), identity(F.col("a"), F.col("b"), False))
    for a, b, exact, folded in got:
        short = a is None or b is None or len(b) < len(a)
        assert exact == (None if short else sum(x == y for x, y in zip(a, b)))
        assert folded == (None if short else sum(x == y for x, y in zip(a.upper(), b.upper())))
    plan = df.select(identity(F.col("a"), F.col("b")))._jdf.queryExecution().toString()
    assert "aggregate(" not in plan and "bit_count(" in plan


@pytest.mark.parametrize("a, b", [("AC!", "ACG"), ("ACG", "AEG"), ("A" * 63, "A" * 63)])
def test_what_cannot_be_packed_is_an_error(spark, a, b):
    with pytest.raises(PySparkException):
        spark.createDataFrame([(a, b)], "a string, b string").select(identity(F.col("a"), F.col("b"))).collect()
