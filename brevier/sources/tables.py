"""The domain tables as views over the star schema, each with the SQL that says the same."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import FREQUENCY_DAYS, TOPICS


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ts(t: datetime):
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


def users(spark: SparkSession, sf_dir: str, before: datetime) -> DataFrame:
    """One row per customer; deliveries are views before ``before``."""
    e = read(spark, sf_dir, "events")
    onboarded = F.min(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("onboarded_at")
    delivered = F.max(F.when((F.col("event_type") == "view") & (F.col("ts") < ts(before)), F.col("ts")))
    times = e.groupBy("user_id").agg(onboarded, delivered.alias("last_delivery_at"))
    names = F.array(*[F.lit(k) for k in FREQUENCY_DAYS])
    c = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("chat_id"), F.col("c_mktsegment").alias("segment"),
        (F.col("c_acctbal") >= 0).alias("enabled"), F.get(names, (F.col("c_custkey") % 3).cast("int")).alias("frequency"),
    )
    return c.join(times, "user_id", "left")


def users_sql(before: datetime) -> str:
    names = "[" + ", ".join(f"'{k}'" for k in FREQUENCY_DAYS) + "]"
    return f"""users AS (
      SELECT c_custkey AS user_id, c_name AS chat_id, c_mktsegment AS segment, c_acctbal >= 0 AS enabled,
             {names}[c_custkey % 3 + 1] AS frequency, t.onboarded_at, t.last_delivery_at
      FROM customer LEFT JOIN (
        SELECT user_id, min(ts) FILTER (event_type = 'signup') AS onboarded_at,
               max(ts) FILTER (event_type = 'view' AND ts < TIMESTAMP '{before}') AS last_delivery_at
        FROM events GROUP BY user_id) t ON t.user_id = c_custkey)"""


def user_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    slugs = F.array(*[F.lit(t) for t in TOPICS])
    k = F.get_json_object("props", "$.k").cast("int") % len(TOPICS)
    return read(spark, sf_dir, "events").select("user_id", F.get(slugs, k).alias("topic_slug")).distinct()


def user_topics_sql() -> str:
    slugs = "[" + ", ".join(f"'{t}'" for t in TOPICS) + "]"
    return f"""user_topics AS (
      SELECT DISTINCT user_id, {slugs}[CAST(json_extract_string(props, '$.k') AS INT) % {len(TOPICS)} + 1] AS topic_slug
      FROM events)"""


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "useful").when(F.col("event_type") == "error", "noise")
    kind = kind.when(F.col("event_type") == "purchase", "anxious").otherwise("open")
    return read(spark, sf_dir, "events").select("event_id", "user_id", kind.alias("kind"), F.col("ts").alias("occurred_at"))


FEEDBACK_SQL = """feedback AS (
  SELECT event_id, user_id, ts AS occurred_at, CASE event_type WHEN 'click' THEN 'useful' WHEN 'error' THEN 'noise'
         WHEN 'purchase' THEN 'anxious' ELSE 'open' END AS kind FROM events)"""


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases; every seventh comes with a blank segment."""
    e = read(spark, sf_dir, "events").where("event_type = 'purchase'")
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    blank = F.when(F.col("event_id") % 7 == 0, F.lit("  ")).otherwise(F.col("segment"))
    price = F.get(F.array(*[F.lit(p) for p in (199, 299, 399)]), (F.col("event_id") % 3).cast("int"))
    return e.join(c, "user_id").select("event_id", "user_id", F.col("ts").alias("occurred_at"), blank.alias("segment"), price.alias("price_rub"))


INTENTS_SQL = """intents AS (
  SELECT event_id, user_id, ts AS occurred_at, CASE WHEN event_id % 7 = 0 THEN '  ' ELSE c_mktsegment END AS segment,
         [199, 299, 399][event_id % 3 + 1] AS price_rub
  FROM events JOIN customer ON c_custkey = user_id WHERE event_type = 'purchase')"""


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as news; stage statuses and times follow from the id."""
    status = F.array(*[F.lit(x) for x in ("PENDING", "IN_PROGRESS", "DONE", "DONE", "DONE", "FAILED")])
    at = lambda minutes: F.timestamp_add("MINUTE", minutes, F.lit("2024-01-19 00:00:00").cast("timestamp_ntz"))
    d = read(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("https://n/"), F.col("doc_id")).alias("url"), F.col("source").alias("media"),
        F.col("lang").alias("language"), F.col("text").alias("content_clean"), F.sha2("text", 256).alias("content_hash"),
        F.get(status, (F.col("doc_id") % 6).cast("int")).alias("status_content"),
        F.get(status, F.floor(F.col("doc_id") / 6 % 6).cast("int")).alias("status_embedding"),
        F.get(status, F.floor(F.col("doc_id") / 36 % 6).cast("int")).alias("status_summary"),
        at((F.col("doc_id") % 1500).cast("int")).alias("event_at"),
        F.when(F.col("doc_id") % 4 != 0, at((F.col("doc_id") * 7 % 1460).cast("int"))).alias("claimed_at"),
    )


NEWS_SQL = """news AS (
  SELECT doc_id AS id, 'https://n/' || doc_id AS url, source AS media, lang AS language, text AS content_clean,
         sha256(text) AS content_hash, st[doc_id % 6 + 1] AS status_content, st[doc_id // 6 % 6 + 1] AS status_embedding,
         st[doc_id // 36 % 6 + 1] AS status_summary,
         TIMESTAMP '2024-01-19 00:00:00' + to_minutes(doc_id % 1500) AS event_at,
         CASE WHEN doc_id % 4 <> 0 THEN TIMESTAMP '2024-01-19 00:00:00' + to_minutes(doc_id * 7 % 1460) END AS claimed_at
  FROM documents, (SELECT ['PENDING', 'IN_PROGRESS', 'DONE', 'DONE', 'DONE', 'FAILED'] AS st))"""


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").where("role = 'assistant'")
    lang = F.get(F.array(*[F.lit(x) for x in ("ru", "en", "es")]), (F.col("turn") % 3).cast("int"))
    return c.select(F.col("conv_id").alias("news_id"), F.col("turn").alias("version"), lang.alias("lang"), F.col("text").alias("summary"))


SUMMARIES_SQL = """summaries AS (
  SELECT conv_id AS news_id, turn AS version, ['ru', 'en', 'es'][turn % 3 + 1] AS lang, text AS summary
  FROM conversations WHERE role = 'assistant')"""
