"""Mixing sources to target weights along a curriculum.

Targets: sources in code point order (null last) carry the weights in turn and share all
words; no source exceeds ``max_epochs`` times its size, and what it cannot take goes to the
others by weight (water level over the sources sorted by size / weight).  Within a source
documents stand in a seeded order; whole epochs take every document, and the last, partial
epoch takes documents in that order until the words due are reached.  The document in which
that happens is cut there, so a source's total misses its target by less than a word.

Curriculum: source s has the weight schedule 1 + slope_s (2t - 1) over training time
t in [0, 1].  Its integral, the share of the source's words due by time t, is
t + slope_s (t^2 - t); inverting it at a document's middle word gives the document's
training position, and documents are range-sorted by position.

Defined cases: null or wordless texts have size 0 and take nothing; a source without words
has target 0; a null source is a source; repeated rows are separate documents; no rows
give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranking, scratch
from .sharding import stratum

WEIGHTS, SLOPES, MAX_EPOCHS, SEED = (5, 2, 1), (0.5, 0.0, -0.5), 3, "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: Sequence[int], slopes: Sequence[float], cap: int) -> DataFrame:
    """``sizes`` has stratum, source_size.  One row per source: small by nature."""
    turn = lambda xs, kind: F.expr(
        f"element_at(array({', '.join(f'CAST({x} AS {kind})' for x in xs)}), CAST(i % {len(xs)} AS INT) + 1)"
    )
    everything = Window.partitionBy()
    s = sizes.withColumn("i", F.row_number().over(Window.orderBy("stratum")) - 1)
    s = s.withColumns({"w": turn(weights, "BIGINT"), "slope": turn(slopes, "DOUBLE"), "most": F.col("source_size") * cap})
    s = s.withColumn("level", F.col("most") / F.col("w"))
    before = Window.orderBy("level", "i").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns(
        {
            "due": F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0)),
            "open_w": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)),
        }
    ).withColumn("rate", F.col("due") / F.col("open_w"))
    free = F.col("most") > F.col("rate") * F.col("w")
    s = s.withColumn("first_free", F.min(F.when(free, F.struct("level", "i", "rate"))).over(everything))
    open_ = F.struct("level", "i") >= F.struct("first_free.level", "first_free.i")
    target = F.when(open_, F.col("first_free.rate") * F.col("w")).otherwise(F.col("most").cast("double"))
    return s.select("stratum", "source_size", "slope", target.alias("target"))


def plan_mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    slopes: Sequence[float] = SLOPES,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """A row per document: its source's target, its copies, and where they begin."""
    rows = docs.select(
        "doc_id",
        stratum().alias("stratum"),
        F.xxhash64("text").alias("place"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), "text"), F.lit("null")))).alias("h"),
    )
    rows = scratch.save(ranking.hash_buckets(rows, "h"), "mix-rows")
    sizes = rows.groupBy("stratum").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, slopes, max_epochs)
    order = [F.col("h"), F.col("doc_id"), F.col("size")]
    placed = ranking.running(rows, ["stratum"], order, ["size"], targets)
    size, total = F.col("size"), F.col("source_size")
    epochs = F.when(total > 0, F.floor(F.col("target") / total)).otherwise(F.lit(0)).cast("long")
    due = F.floor(F.col("target") - F.col("epochs") * total) - F.col("size_before")
    placed = placed.withColumn("epochs", epochs).withColumn("part", F.greatest(F.least(due, size), F.lit(0)).cast("long"))
    return placed.select(
        "doc_id", "size", "source_size", "target",
        (F.col("epochs") * size + F.col("part")).alias("taken"),
        F.when(size > 0, F.col("epochs") + (F.col("part") > 0).cast("long")).otherwise(F.lit(0).cast("long")).alias("copies"),
        "epochs", "part", "slope", "size_before", "stratum", "place",
    )


def position(copy):
    """Training time of copy number ``copy`` (from 0) of a planned document."""
    u = (copy * F.col("source_size") + F.col("size_before") + F.col("size") / F.lit(2.0)) / F.col("target")
    u = F.least(u, F.lit(1.0))
    back = F.lit(1.0) - F.col("slope")
    return F.lit(2.0) * u / (back + F.sqrt(back * back + F.lit(4.0) * F.col("slope") * u))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The training stream: every taken copy with its text, range-sorted by ``mix_position``.

    ``docs`` is read twice.  Rows are matched to the plan by doc_id, source and text; rows that
    repeat all three are numbered on both sides, so each takes the copies of one plan row.
    """
    key = ["doc_id", "stratum", "place"]
    same = Window.partitionBy("mix_key")
    plan = plan_mix(docs, **options).withColumn("mix_key", F.struct(*key))
    plan = plan.withColumn("mix_nth", F.row_number().over(same.orderBy("size_before", F.desc("copies")))).where("copies > 0")
    plan = plan.select("mix_key", "mix_nth", "copies", "size", "source_size", "target", "epochs", "part", "slope", "size_before")
    rows = docs.select(
        F.struct("doc_id", stratum().alias("stratum"), F.xxhash64("text").alias("place")).alias("mix_key"), F.struct("*").alias("mix_doc")
    )
    rows = rows.withColumn("mix_nth", F.row_number().over(same.orderBy(F.lit(0))))
    head = F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), F.col("part").cast("string"), F.lit("}+"))
    cut = (F.col("mix_copy") == F.col("epochs")) & (F.col("part") < F.col("size"))
    text = F.when(cut, F.regexp_substr("mix_doc.text", head)).otherwise(F.col("mix_doc.text"))
    copies = (
        rows.join(plan, ["mix_key", "mix_nth"])
        .withColumn("mix_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .withColumn("mix_position", position(F.col("mix_copy")))
        .select(*[text.alias(c) if c == "text" else F.col(f"mix_doc.`{c}`") for c in docs.columns], "mix_copy", "mix_position")
    )
    return copies.repartitionByRange("mix_position").sortWithinPartitions("mix_position")
