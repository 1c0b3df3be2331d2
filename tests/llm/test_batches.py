"""Texts reach the Python workers in batches of bounded size, however many bytes a task has."""

from brevier.llm import ngram_join, packing, token_store
from brevier.llm.queries import vocabulary
from pyspark.sql import functions as F

MOST = 6 << 20


def _texts(spark):
    """12 MB of text in one partition."""
    return spark.range(120, numPartitions=1).select(F.col("id").alias("doc_id"), F.expr("repeat(concat('w', id, ' and '), 12000)").alias("text"))


def _bounded(steps):
    def run(batches, *rest):
        for batch in batches:
            assert batch.nbytes < MOST, batch.nbytes
            yield from steps(iter([batch]), *rest)

    return run


def test_packing_reads_small_batches(spark, monkeypatch):
    monkeypatch.setattr(packing, "text_steps", _bounded(token_store.text_steps))
    pieces = packing.cut_pieces(_texts(spark), vocabulary("word_bpe_49k.json"), end_id=1)
    assert pieces.select("doc_id").distinct().count() == 120


def test_ngram_join_reads_small_batches(spark, monkeypatch):
    steps = ngram_join._steps

    def bounded(batch):
        assert batch.nbytes < MOST, batch.nbytes
        return steps(batch)

    monkeypatch.setattr(ngram_join, "_steps", bounded)
    monkeypatch.setattr(ngram_join, "text_steps", _bounded(token_store.text_steps))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    classes = ngram_join.similarity_classes(_texts(spark), width=3, percent=90)
    assert classes.count() == 120
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
