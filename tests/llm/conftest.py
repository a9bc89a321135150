from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from (id, text) or (id, text, source) rows; extra columns have names that operators also use."""

    def make(rows, clash=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(3)
        if clash:
            for name in ("size", "n_words", "kept", "spans", "score", "shard", "text2", "class_id", "g", "start", "rule", "taken"):
                df = df.selectExpr("*", f"'x' as {name}")
        return df

    return make


@pytest.fixture(scope="session")
def odd(make_docs):
    """Null ids and texts, empty and white texts, a long text, repeated rows."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
    return make_docs([
        (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (4, "one"), (None, "no id here at all"), (None, None), (5, long), (6, "é ñ 漢字 😀 ünï"),
        (7, None, None), (8, "x" * 5000, None),
    ], clash=True)


@pytest.fixture(scope="session")
def empty(make_docs):
    return make_docs([])
