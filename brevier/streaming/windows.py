"""Windowed monitoring, as batch and as streams over the same plans."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared


def rate(events: DataFrame, length: str = "5 minutes", seconds: int = 300) -> DataFrame:
    """Events a second by type in tumbling windows."""
    w = F.window("ts", length)
    out = events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", (F.col("n") / seconds).alias("rate"))


def peak(events: DataFrame) -> DataFrame:
    """For each hour and type the count, and the largest count of this and the two hours before."""
    hours = events.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"))
    seconds = F.unix_timestamp("hour")
    w = Window.partitionBy("event_type").orderBy(seconds).rangeBetween(-7200, 0)
    return hours.select("hour", "event_type", "n", F.max("n").over(w).alias("peak"), F.avg("n").over(w).alias("mean"))


def error_alert(events: DataFrame, least: float = 0.2) -> DataFrame:
    """Hours whose error share is above ``least`` in the hour and in the one before."""
    hours = events.groupBy(F.date_trunc("hour", "ts").alias("hour"))
    hours = hours.agg((F.count_if(F.col("event_type") == "error") / F.count("*")).alias("share"))
    w = Window.orderBy("hour")  # one row per hour
    lagged = hours.withColumns({"last": F.lag("share").over(w), "last_hour": F.lag("hour").over(w)})
    near = F.col("last_hour") == F.col("hour") - F.expr("INTERVAL 1 HOUR")
    return lagged.where((F.col("share") > least) & (F.col("last") > least) & near).select("hour", "share")


def quantiles(events: DataFrame) -> DataFrame:
    """Nearest-rank quantiles from mergeable summaries, off by at most one rank in 10,000."""
    return events.groupBy("event_type").agg(*[F.percentile_approx("value", q, 10_000).alias(n) for n, q in (("p95", 0.95), ("p50", 0.5))])


def last_values(events: DataFrame) -> DataFrame:
    order = F.struct("ts", "event_id")
    return events.groupBy("user_id", "event_type").agg(F.max_by("value", order).alias("last_value"), F.max("ts").alias("ts"))


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    s = events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("s.start").alias("start"), "n")


def run_stream(spark: SparkSession, path: str, schema, plan: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Run ``plan`` over a directory of Parquet files as a stream until all input is read; the
    result is a table in the shared folder, under a name of its own."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(path)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    home = f"{shared(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "complete":
        stream = plan(stream.withWatermark("ts", "1 hour"))
        out = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{home}/rows"))
    else:
        stream = plan(stream)
        out = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{home}/rows")
    query = out.option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(f"{home}/rows")


def daily_counts(events: DataFrame) -> DataFrame:
    out = events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


def first_of_key(events: DataFrame) -> DataFrame:
    """Each (user, type) once, in a stream that forgets keys after its watermark."""
    return events.withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type")
