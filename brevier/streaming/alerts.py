"""Monitoring queries over events: gauges, counters, buckets, ratios and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gauge_sum(events: DataFrame, series: list[str], by: list[str]) -> DataFrame:
    """The last value of each series, summed by labels."""
    last = events.groupBy(*series).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return last.groupBy(*by).agg(F.sum("value").alias("value"))


def increase(events: DataFrame, by: list[str], length: str = "1 hour") -> DataFrame:
    w = events.groupBy(F.window("ts", length).alias("w"), *by).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), *by, "n")


def counter_increase(samples: DataFrame, series: list[str]) -> DataFrame:
    """The growth of a counter; a fall is a restart, after which the whole value counts."""
    before = F.lag("value").over(Window.partitionBy(*series).orderBy("ts", "event_id"))
    step = F.when(before.isNull(), 0.0).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    return samples.withColumn("step", step).groupBy(*series).agg(F.sum("step").alias("increase"))


def bucket_quantile(events: DataFrame, by: str, bounds: list[float], q: float) -> DataFrame:
    """A quantile from counts of values up to each bound, linear inside its bucket; above the
    last bound it is that bound.  Counts are partial sums, so no task sees a label's values."""
    counts = events.groupBy(by).agg(*[F.count_if(F.col("value") <= b).alias(f"c{i}") for i, b in enumerate(bounds)], F.count("value").alias("n"))
    rank = F.col("n") * q
    out: Column = F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        low, under = (0.0, F.lit(0)) if i == 0 else (bounds[i - 1], F.col(f"c{i - 1}"))
        inside = F.lit(low) + (bounds[i] - low) * (rank - under) / (F.col(f"c{i}") - under)
        out = F.when(F.col(f"c{i}") >= rank, inside).otherwise(out)
    return counts.where("n > 0").select(by, out.alias("value"))


def used_share(samples: DataFrame, by: str, idle: Column, most: int = 100) -> DataFrame:
    """100 * (1 - mean idle share) by label."""
    return samples.groupBy(by).agg((most * (1 - F.avg(idle))).alias("used"))


def log_counts(lines: DataFrame, text: str, length: str = "5 minutes") -> DataFrame:
    """Lines that contain a text, by level and window."""
    hits = lines.where(F.contains(F.col("line"), F.lit(text))).groupBy(F.window("ts", length).alias("w"), "level").agg(F.count("*").alias("n"))
    return hits.select(F.col("w.start").alias("start"), "level", "n")


def held_above(samples: DataFrame, key: str, limit: float, slots: int) -> DataFrame:
    """Slots at which the value has been above ``limit`` in this and the ``slots`` - 1 before,
    one slot a minute, none missing."""
    w = Window.partitionBy(key).orderBy("minute").rangeBetween(1 - slots, 0)
    lows = samples.select(key, "minute", F.min("value").over(w).alias("low"), F.count("*").over(w).alias("n"))
    return lows.where((F.col("low") > limit) & (F.col("n") >= slots)).select(key, "minute", "low")


def failures(events: DataFrame, failed: Column, length: str) -> DataFrame:
    """Windows with a failure."""
    hits = events.where(failed).groupBy(F.window("ts", length).alias("w")).agg(F.count("*").alias("n"))
    return hits.select(F.col("w.start").alias("start"), "n")


def ratio_alert(events: DataFrame, failed: Column, length: str = "10 minutes", least: float = 0.2) -> DataFrame:
    """Windows whose failure share is above ``least`` in this and the window before."""
    w = events.groupBy(F.window("ts", length).alias("w")).agg((F.count_if(failed) / F.count("*")).alias("share"))
    w = w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "share")
    before = w.select(F.col("end").alias("start"), F.col("share").alias("last"))
    both = w.join(before, "start")
    return both.where((F.col("share") > least) & (F.col("last") > least)).select("start", "share")


def clamp(x: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))
