"""The processing queue as queries: claims, backlog, planner, merges."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import ts


def _stale(as_of: datetime, lease: timedelta) -> Column:
    return F.col("claimed_at").isNull() | (F.col("claimed_at") < ts(as_of - lease))


def _waiting(stage: str, as_of: datetime, lease: timedelta) -> Column:
    status = F.col(f"status_{stage}")
    return (status == "PENDING") | ((status == "IN_PROGRESS") & _stale(as_of, lease))


def _has_text() -> Column:
    return F.btrim("content_clean") != ""


def claim_content(news: DataFrame, as_of: datetime, lease: timedelta, batch: int) -> DataFrame:
    return news.where(_waiting("content", as_of, lease)).orderBy("event_at", "id").limit(batch).select("id", "event_at")


def claim_embedding(news: DataFrame, vectors: DataFrame, as_of: datetime, lease: timedelta, batch: int) -> DataFrame:
    """Also takes rows marked done that have no vector."""
    known = vectors.select("id").distinct().withColumn("has", F.lit(True))
    rows = news.where((F.col("status_content") == "DONE") & _has_text()).join(known, "id", "left")
    lost = (F.col("status_embedding") == "DONE") & F.col("has").isNull()
    rows = rows.where(_waiting("embedding", as_of, lease) | lost)
    return rows.orderBy("event_at", "id").limit(batch).select("id", "event_at")


def claim_summary(news: DataFrame, as_of: datetime, lease: timedelta, maturity: timedelta, batch: int) -> DataFrame:
    ready = (F.col("status_content") == "DONE") & (F.col("status_embedding") == "DONE") & _has_text()
    mature = F.col("event_at") <= ts(as_of - maturity)
    rows = news.where(ready & mature & _waiting("summary", as_of, lease))
    return rows.orderBy("event_at", "id").limit(batch).select("id", "event_at")


def backlog(news: DataFrame, vectors: DataFrame) -> DataFrame:
    """Nine counters and their outstanding total in one pass."""
    known = vectors.select("id").distinct().withColumn("has", F.lit(True))
    rows = news.join(known, "id", "left")
    content, embedding, summary = (F.col(f"status_{s}") for s in ("content", "embedding", "summary"))
    ready = (content == "DONE") & _has_text()
    lost = (embedding == "DONE") & F.col("has").isNull()
    tests = {
        "content_pending": content == "PENDING", "content_active": content == "IN_PROGRESS", "content_failed": content == "FAILED",
        "embedding_pending": ready & ((embedding == "PENDING") | lost), "embedding_active": embedding == "IN_PROGRESS",
        "embedding_failed": embedding == "FAILED", "summary_pending": ready & (embedding == "DONE") & (summary == "PENDING"),
        "summary_active": summary == "IN_PROGRESS", "summary_failed": summary == "FAILED",
    }
    out = rows.agg(*[F.count_if(test).alias(name) for name, test in tests.items()])
    outstanding = sum((F.col(n) for n in tests if not n.endswith("failed")), F.lit(0))
    return out.withColumn("outstanding", outstanding.cast("long"))


def latest_summary(summaries: DataFrame, lang: str) -> DataFrame:
    """The newest summary in the wanted language of each item, else its newest in any."""
    order = Window.partitionBy("news_id").orderBy((F.col("lang") == lang).desc(), F.col("version").desc())
    return summaries.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def last_wins(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col(version).desc())
    return rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def reusable_summary(news: DataFrame, summaries: DataFrame, lang: str) -> DataFrame:
    """For each item a summary of itself or of an item with the same content, its own first.
    The best offer of each content is aggregated before the join, so copies never meet in pairs."""
    s = summaries.where(F.col("lang") == lang).select(F.col("news_id").alias("of"), "version")
    offers = news.select(F.col("id").alias("of"), "content_hash").join(s, "of")
    order = F.struct((-F.col("version")).alias("old"), "of")
    own = offers.groupBy("of").agg(F.max("version").alias("version"))
    twin = offers.groupBy("content_hash").agg(F.min(order).alias("best"))
    found = news.join(own.select(F.col("of").alias("id"), F.col("version").alias("own_version")), "id", "left").join(twin, "content_hash", "left")
    hit = F.col("own_version").isNotNull()
    return found.where(hit | F.col("best").isNotNull()).select(
        "id", F.when(hit, F.col("id")).otherwise(F.col("best.of")).alias("of"),
        F.when(hit, F.col("own_version")).otherwise(-F.col("best.old")).alias("version"), hit.cast("int").alias("own"),
    )


def resolve_natural_keys(probes: DataFrame, news: DataFrame) -> DataFrame:
    """The stored row that matches a probe best: id counts 3, url 2, content hash 1.

    Of a content's rows only the smallest id can win by content alone, so copies meet their
    probes once; the rows found by id or url are looked at for the content too.
    """
    named = news.select(F.col("id").alias("found"), F.col("url").alias("u"), F.col("content_hash").alias("c"))
    by_content = named.groupBy(F.col("c").alias("content_hash")).agg(F.min("found").alias("found"))
    parts = [
        probes.join(named, probes["id"] == named["found"]).select("probe", "id", "url", "content_hash", "found", "u", "c"),
        probes.join(named, probes["url"] == named["u"]).select("probe", "id", "url", "content_hash", "found", "u", "c"),
        probes.join(by_content, "content_hash").join(named, "found").select("probe", "id", "url", "content_hash", "found", "u", "c"),
    ]
    weight = lambda a, b, n: F.coalesce(F.when(F.col(a) == F.col(b), n), F.lit(0))
    score = weight("id", "found", 3) + weight("url", "u", 2) + weight("content_hash", "c", 1)
    found = parts[0].unionByName(parts[1]).unionByName(parts[2]).select("probe", "found", score.cast("long").alias("score"))
    best = found.groupBy("probe").agg(F.min(F.struct((-F.col("score")).alias("minus"), "found")).alias("best"))
    return best.select("probe", "best.found", (-F.col("best.minus")).alias("score"))


def upsert(old: DataFrame, new: DataFrame, key: str, replace: list[str], keep: list[str]) -> DataFrame:
    """Merge by key: ``replace`` columns come from the new row, ``keep`` columns only if it has them."""
    o, n = old.alias("o"), new.withColumn("hit", F.lit(True)).alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    pick = lambda c: F.when(F.col("n.hit"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    fill = lambda c: F.coalesce(f"n.{c}", f"o.{c}").alias(c)
    return joined.select(fill(key), *[pick(c) for c in replace], *[fill(c) for c in keep])


def first_by_content(news: DataFrame) -> DataFrame:
    """One row for each content hash, the smallest id, with the number of copies."""
    return news.groupBy("content_hash").agg(F.min("id").alias("id"), F.count("*").alias("copies"))


def plan_summaries(news: DataFrame, cached: DataFrame, top: DataFrame, as_of: datetime, maturity: timedelta, budget: int) -> DataFrame:
    """Reuse, defer, fall back or use the provider, in that order; the budget is per day."""
    rows = news.where("status_content = 'DONE' AND status_embedding = 'DONE'")
    rows = rows.join(cached.select("id").withColumn("hit", F.lit(True)), "id", "left")
    rows = rows.join(top.select("id").withColumn("top", F.lit(True)), "id", "left")
    rows = rows.withColumn("day", F.to_date("event_at"))
    wants = F.col("hit").isNull() & (F.col("event_at") <= ts(as_of - maturity)) & F.col("top").isNotNull()
    asking = rows.where(wants).withColumn("nth", F.row_number().over(Window.partitionBy("day").orderBy("event_at", "id")))
    rows = rows.join(asking.select("id", "nth"), "id", "left")
    plan = (
        F.when(F.col("hit").isNotNull(), "REUSE_CACHED").when(F.col("event_at") > ts(as_of - maturity), "DEFER")
        .when(F.col("top").isNull(), "USE_FALLBACK").when(F.col("nth") > budget, "USE_FALLBACK").otherwise("USE_PROVIDER")
    )
    return rows.select("id", "day", plan.alias("plan"))
