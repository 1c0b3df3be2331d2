"""Sharding by proportional stratified interleaving.

Each source's rows are put in a seeded order and ranked; a row's fractional rank
(rank + 0.5) / rows-of-its-source spreads every source evenly over [0, 1).  Sorted by that
fraction, any contiguous cut holds each source in its overall share, so equal cuts give
shards that all match the mixture.

Defined cases: a null source is a stratum of its own; a null text has size 1 and the
checksum of no bytes; a null doc_id hashes like the word "null" and the text; identical rows are
interchangeable; no rows give no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranking, scratch

SHARDS, SEED = 16, "interleave-1"


def stratum(source: str = "source"):
    """A non-null sort key: sources in code point order, null after all of them."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("t"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, text_crc32, fraction, position, shard, slot for each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id",
        "source",
        stratum().alias("stratum"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), text)))).alias("h"),
        F.lit(1).cast("long").alias("one"),
    )
    base = scratch.save(ranking.hash_buckets(base, "h"), "shard-rows")
    ties = [F.col("h"), F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    ranked = ranking.running(base, ["stratum"], ties, ["one"])
    ranked = ranked.select(
        "doc_id", "source", "stratum", "size", "text_crc32", "h", "one",
        ((F.col("one_before") + F.lit(0.5)) / F.col("one_total")).alias("fraction"),
    )
    ranked = scratch.save(ranking.unit_buckets(ranked, "fraction"), "shard-ranks")
    placed = ranking.running(ranked, [], [F.col("fraction"), F.col("stratum"), *ties], ["one"])
    pos, total = F.col("one_before"), F.col("one_total")
    shard = F.expr(f"one_before * {shards} div one_total")
    return placed.select(
        "doc_id", "source", "size", "text_crc32", "fraction", pos.alias("position"),
        shard.cast("int").alias("shard"), total.alias("rows"),
    ).withColumn("slot", F.expr(f"position - (shard * rows + {shards - 1}) div {shards}").cast("long"))
