"""The corpus pipeline: raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and its result is written and read again as the
next stage's ``docs``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brevier.llm import line_template, mixing, ngram_join, packing, quality, scratch
from brevier.llm.queries import vocabulary


def _with_text(docs: DataFrame, columns: list[str], text) -> DataFrame:
    """``columns`` of the struct ``doc`` with another text and the length that goes with it."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return docs.select(*[new[c].alias(c) if c in new else F.col(f"doc.`{c}`") for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and with them the documents that lose too much or fail the base limits."""
    kept = quality.judge_documents(docs).where("quality.kept")
    lost = F.col("quality.clean_chars") < F.col("quality.word_chars")
    return _with_text(kept, docs.columns, F.when(lost, F.col("quality.clean_text")).otherwise(F.col("doc.text")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines stay in their first document only; documents left without a word go."""
    out = line_template.drop_recurring_lines(docs)
    left = out.where((F.col("n_dropped") == 0) | F.col("clean_text").rlike(r"[^\x20\x09-\x0D]"))
    return _with_text(left, docs.columns, F.col("clean_text"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by 5-word shingles at a similarity of 0.8 or more."""
    return ngram_join.one_of_each(docs, width=5, percent=80).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, cut or left out to meet the sources' targets, in training order."""
    mixed = mixing.mix_documents(docs).select(F.struct(*docs.columns).alias("doc"))
    return _with_text(mixed, docs.columns, F.col("doc.text"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its place in a sequence of at most 4096 tokens."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard),
    ("mixing", source_mix),
    ("best-fit packing", best_fit_packing),
]

#: Tokenizing and the similarity join have no SQL form; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.save(docs, f"stage-{i}-{name.replace(' ', '-')}")
    return docs
