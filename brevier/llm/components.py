"""Connected components by alternating star contraction.

Each round makes every node point at the smallest node near it, first from the large side,
then from the small side; the rounds needed grow with the logarithm of the graph.  Minima
are partial aggregates and joins have plain exchanges on both sides, so that a node with
very many neighbours is summed per task and its join partition can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def _signature(edges: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
    row = edges.agg(F.count("*").alias("n"), total).first()
    return row["n"], row["s"]


def components(links: DataFrame) -> DataFrame:
    """``links`` has two columns of one orderable type.  Returns node, root (the smallest
    node reachable) for every node that has a link to another; a written table."""
    a, b = links.columns
    up = F.col(a) > F.col(b)
    u, v = F.when(up, F.col(a)).otherwise(F.col(b)), F.when(up, F.col(b)).otherwise(F.col(a))
    edges = links.where(F.col(a) != F.col(b)).select(u.alias("u"), v.alias("v")).distinct()
    edges = scratch.save(edges, "edges")
    known = _signature(edges)
    while known[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.when(F.col("m") < F.col("u"), F.col("m")).otherwise(F.col("u")).alias("m"))
        low = scratch.save(low, "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.save(large.where("u != v").distinct(), "large")
        low2 = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.where("u != v").unionByName(low2.select("u", F.col("m").alias("v"))).distinct()
        small = scratch.save(small, "edges")
        for old in (edges, low, large, low2):
            scratch.drop(old)
        edges, before, known = small, known, _signature(small)
        if known == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
