"""Documents from raw to mixed and sharded: quality rules, near-duplicates, decontamination, mixing, sharding.

``run`` applies the stages to ``documents``; each stage reads what its predecessor wrote as Parquet in the shared folder. All
but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutsites.llm import decontamination, mixing, near_duplicates, quality_rules, sharding
from cutsites.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned rules keep."""
    rules = quality_rules.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_rules.apply(docs, rules).where("kept").select(*docs.columns)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest id."""
    found = written(near_duplicates.classes(docs), "classes")
    return near_duplicates.one_of_each(docs, found)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the spans that hold benchmark phrases."""
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    dirty = F.size("spans") > 0
    text = F.when(dirty, F.col("cleaned")).otherwise(F.col("text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(dirty, F.length("cleaned").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumns(changed).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one without words costs nothing and stays once."""
    hidden = {c: f"__own_{c}" for c in docs.columns if c in ("size", "source_size", "target", "taken")}
    taken = mixing.mix(docs.withColumnsRenamed(hidden))
    copies = F.expr("cast(case when size > 0 then taken div size else 1 end as int)")
    repeated = taken.withColumn("__copies", copies).where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies")))
    return repeated.select(*[F.col(hidden.get(c, c)).alias(c) for c in docs.columns])


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard (0 to 15) and place in it."""
    return sharding.shard(docs, 16)


STAGES = [("quality_rules", quality), ("near_duplicates", deduplicated), ("decontamination", decontaminated), ("mixing", mixed), ("sharding", sharded)]

#: Learned rules and random draws have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
