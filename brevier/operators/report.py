"""Product analytics: feedback, intent, retention, segments, the daily report."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import percent
from ..params import SEGMENT_OF
from ..sources.tables import ts

DAY = timedelta(days=1)


def within(column: str, start: datetime, end: datetime):
    return (F.col(column) >= ts(start)) & (F.col(column) < ts(end))


def feedback_stats(feedback: DataFrame, start: datetime, end: datetime) -> DataFrame:
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in ("useful", "noise", "anxious")]
    return feedback.where(within("occurred_at", start, end)).agg(
        F.count("*").alias("events"), *kinds, F.countDistinct("user_id").alias("users")
    )


def delivered_users(users: DataFrame, start: datetime, end: datetime) -> DataFrame:
    return users.where(within("last_delivery_at", start, end)).agg(F.count("*").alias("delivered"))


def intent_stats(intents: DataFrame, start: datetime, end: datetime) -> DataFrame:
    return intents.where(within("occurred_at", start, end)).agg(
        F.count("*").alias("intent_events"), F.countDistinct("user_id").alias("intent_users")
    )


def intent_by_segment(intents: DataFrame, start: datetime, end: datetime) -> DataFrame:
    segment = F.coalesce(F.nullif(F.btrim("segment"), F.lit("")), F.lit("general")).alias("segment")
    return intents.where(within("occurred_at", start, end)).groupBy(segment).agg(
        F.count("*").alias("intent_events"), F.countDistinct("user_id").alias("intent_users")
    )


def retention(users: DataFrame, feedback: DataFrame, end: datetime, days: int) -> DataFrame:
    """Users onboarded on the day ``days`` before the report day, and those with any feedback since."""
    start = end - (days + 1) * DAY
    cohort = users.where(within("onboarded_at", start, start + DAY)).select("user_id")
    active = feedback.where(within("occurred_at", start + DAY, end)).select("user_id").distinct()
    joined = cohort.join(active.withColumn("back", F.lit(1)), "user_id", "left")
    return joined.agg(F.count("*").alias("cohort"), F.count("back").alias("retained"))


def topics_csv(users: DataFrame, topics: DataFrame) -> DataFrame:
    joined = users.select("user_id").join(topics, "user_id", "left")
    csv = F.array_join(F.sort_array(F.collect_list("topic_slug")), ",")
    return joined.groupBy("user_id").agg(csv.alias("topics"))


def user_segments(users: DataFrame, topics: DataFrame) -> DataFrame:
    """The one segment a user's topics fall in; mixed if several, general if none."""
    table = F.create_map(*[F.lit(x) for pair in SEGMENT_OF.items() for x in pair])
    joined = users.select("user_id").join(topics.withColumn("s", table[F.col("topic_slug")]), "user_id", "left")
    found = joined.groupBy("user_id").agg(F.min("s").alias("a"), F.max("s").alias("b"))
    segment = F.when(F.col("a").isNull(), "general").when(F.col("a") != F.col("b"), "mixed").otherwise(F.col("a"))
    return found.select("user_id", segment.alias("segment"))


def segment_report(users: DataFrame, topics: DataFrame, intents: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Delivered users and intents side by side for each segment, zeros where one side is missing."""
    delivered = user_segments(users.where(within("last_delivery_at", start, end)), topics)
    left = delivered.groupBy("segment").agg(F.count("*").alias("delivered"))
    right = intent_by_segment(intents, start, end)
    right = right.withColumn("segment", F.lower(F.trim("segment")))
    both = left.join(right, "segment", "full_outer").na.fill(0)
    return both.select("segment", "delivered", "intent_users", "intent_events", percent(F.col("intent_users"), F.col("delivered")).alias("intent_pct"))


def daily_report(users: DataFrame, feedback: DataFrame, intents: DataFrame, start: datetime) -> DataFrame:
    """One row: counts and rates of a day."""
    end = start + DAY
    parts = feedback_stats(feedback, start, end)
    for other in (
        delivered_users(users, start, end),
        intent_stats(intents, start, end),
        retention(users, feedback, end, 1).toDF("d1_cohort", "d1_retained"),
        retention(users, feedback, end, 7).toDF("d7_cohort", "d7_retained"),
    ):
        parts = parts.join(other)  # each side is one aggregate row
    rated = F.col("useful") + F.col("noise") + F.col("anxious")
    return parts.withColumns(
        {
            "useful_rate": percent(F.col("useful"), rated), "noise_rate": percent(F.col("noise"), rated),
            "ctr": percent(F.col("users"), F.col("delivered")), "intent_pct": percent(F.col("intent_users"), F.col("delivered")),
            "d1_pct": percent(F.col("d1_retained"), F.col("d1_cohort")), "d7_pct": percent(F.col("d7_retained"), F.col("d7_cohort")),
        }
    )


def due_users(users: DataFrame, as_of: datetime) -> DataFrame:
    """Users whose next digest is due, with the lookback since their last one (6 h to 7 d)."""
    step = F.when(F.col("frequency") == "DAILY", 1).when(F.col("frequency") == "EVERY_2_DAYS", 2).otherwise(3)
    next_at = F.timestamp_add("DAY", step, F.col("last_delivery_at"))
    due = F.when(F.col("last_delivery_at").isNull(), F.col("onboarded_at").isNotNull()).otherwise(next_at <= ts(as_of))
    hours = F.floor(F.timestamp_diff("SECOND", F.col("last_delivery_at"), ts(as_of)) / 3600)
    rows = users.where(F.col("enabled") & (F.btrim("chat_id") != "") & due)
    lookback = F.least(F.greatest(F.coalesce(hours, F.lit(24)), F.lit(6)), F.lit(168)).cast("long")
    return rows.select("user_id", "chat_id", "frequency", lookback.alias("lookback_hours"))


def delivery_totals(sent: DataFrame) -> DataFrame:
    """By frequency: users due, users served, messages sent; a failed user counts as due only."""
    return sent.groupBy("frequency").agg(
        F.count("*").alias("due"), F.count_if("ok").alias("delivered"), F.sum(F.when(F.col("ok"), F.col("messages")).otherwise(0)).cast("long").alias("messages")
    )
