"""The thin queries of the llm operators, and their SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embed_dedup, license_scan, line_template, mixing, ngram_join, packing, pii, quality, sharding, token_store
from .oracle import oracle_sql as oracle_sql


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies on this machine and the executors'."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc.doc_id",
        *[count(k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        F.sha2(pii.written(F.col("base_spans")), 256).alias("base_sha256"),
        pii.written(F.col("spans")).alias("spans"),
        pii.scores(F.col("spans")).alias("scores"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = ngram_join.similarity_classes(documents(spark, sf_dir), width=3, percent=90)
    return classes.select("doc_id", "n_shingles", "component_id", "n_links")


def op3_token_store(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    store = token_store.write_store(documents(spark, sf_dir), tokenizer or vocabulary("byte_bpe_50k.json"), end_id=2)
    return token_store.read_spans(store)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.dedup_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer or vocabulary("word_bpe_49k.json"), end_id=1)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(documents(spark, sf_dir))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "fraction",
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(documents(spark, sf_dir))
    first = F.when(F.col("copies") > 0, mixing.position(F.lit(0)))
    plan = plan.select("doc_id", "size", "source_size", "target", "taken", "copies", first.alias("first_position"))
    return plan.repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")  # many are null


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_documents(documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select("doc.doc_id", *[
        f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_chars")
    ])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_template.drop_recurring_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(
        "doc.doc_id", "n_lines", "n_dropped", F.length("clean_text").alias("clean_chars"), F.md5("clean_text").alias("clean_md5")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_ngram_join, op3_token_store, op4_embedding_dedup, op5_license_scan, op6_packing, op7_sharding, op8_mixing, op9_quality, op10_line_dedup)}
