"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutsites.llm import block_anchors, burst_tries, decontamination, html_wrapper, line_dedup, mixing, near_duplicates, quality_mil, quality_rules, secret_scan, sharding, suffix_dedup, text_tries
from cutsites.llm.common import table


def op1_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return near_duplicates.classes(docs).select("doc_id", "class_id", "class_size", F.hex("root").alias("root"))


def op2_html_wrapper(spark: SparkSession, folder: str) -> DataFrame:
    return html_wrapper.extract(table(spark, folder, "pages"), keep=["page_id", "url"])


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.classes(table(spark, folder, "documents").select("doc_id", "text")).drop("text_hash")


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_bytes", F.expr("n_bytes - octet_length(kept_bytes)").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )


def op5_quality_mil(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality_mil.fit(docs, table(spark, folder, "labels"))
    return quality_mil.score(docs, model, ["doc_id"]).select(
        "doc_id", quality_mil.held_out().alias("held_out"), "score", F.expr("cast(score >= 0.5 as int)").alias("predicted")
    )


def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return secret_scan.scan(docs).select("doc_id", "start", "n_chars", F.sha2("token", 256).alias("token_sha256"), "score", "is_secret")


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").selectExpr(
        "doc_id", "coalesce(cast(octet_length(text) as bigint), 0L) + 1 as size", "crc32(coalesce(text, '')) as text_crc32", "md5(coalesce(text, '')) as content"
    )
    return sharding.shard(docs, 16, text="content").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.decontaminate(docs, table(spark, folder, "benchmark"), ["doc_id"], cleaned=False)
    return found.select("doc_id", *decontamination.digest(found))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rules = quality_rules.fit(docs, table(spark, folder, "labels"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"]
    return quality_rules.apply(docs, rules, ["doc_id"]).select(*columns)


def op11_block_anchors(spark: SparkSession, folder: str) -> DataFrame:
    found = block_anchors.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return text_tries.audit(table(spark, folder, "documents").select("doc_id", "text", "source"), table(spark, folder, "labels"))


def op13_burst_tries(spark: SparkSession, folder: str) -> DataFrame:
    return burst_tries.nodes(table(spark, folder, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: value for name, value in globals().items() if name.startswith("op")}
