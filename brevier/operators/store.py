"""The write side as merge queries: each returns the new state of a table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import ts
from .backlog import last_wins

STAGES = ("content", "embedding", "summary")
STATUSES = tuple(f"status_{s}" for s in STAGES)


def _merged(old: DataFrame, new: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """``rules``: new (the new row's value), filled (new unless null), old (the stored one stays)."""
    o, n = old.alias("o"), new.withColumn("hit", F.lit(True)).alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    fresh, stored = F.col("n.hit"), F.col(f"o.{key}").isNotNull()
    pick = {
        "new": lambda c: F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")),
        "filled": lambda c: F.coalesce(f"n.{c}", f"o.{c}"),
        "old": lambda c: F.when(stored, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")),
    }
    return both.select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *[pick[r](c).alias(c) for c, r in rules.items()])


def upsert_fetched(old: DataFrame, new: DataFrame) -> DataFrame:
    """By url: title, hash and statuses are overwritten, so a row that is stored again starts
    its stages anew; the other columns keep their value where the new one is null."""
    fixed = dict.fromkeys(("title", "content_hash", *STATUSES), "new")
    return _merged(old, new, "url", fixed | dict.fromkeys(("author", "language", "content_clean"), "filled"))


def upsert_discovered(old: DataFrame, new: DataFrame) -> DataFrame:
    """By url: content, hash and statuses of a stored row are not touched."""
    kept = dict.fromkeys(("content_clean", "content_hash", *STATUSES), "old")
    return _merged(old, new, "url", {"title": "new", "author": "filled", "language": "filled"} | kept)


def resolve_conflicts(new: DataFrame, stored: DataFrame) -> DataFrame:
    """The stored row a new one falls on: by url, else by medium and external id (if it has
    text), else by content; ``by`` is null where there is none."""
    least = lambda *keys: stored.groupBy(*keys).agg(F.min("id").alias("id"))
    url = least("url").withColumnRenamed("id", "by_url")
    outer = least("media", "external_id").where("trim(external_id) <> ''").withColumnRenamed("id", "by_external")
    content = least("content_hash").withColumnRenamed("id", "by_content")
    found = new.join(url, "url", "left").join(outer, ["media", "external_id"], "left").join(content, "content_hash", "left")
    by = F.when(F.col("by_url").isNotNull(), "url").when(F.col("by_external").isNotNull(), "external").when(F.col("by_content").isNotNull(), "content")
    return found.select("probe", F.coalesce("by_url", "by_external", "by_content").alias("id"), by.alias("by"))


def upsert_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """One vector an item, the last written."""
    both = old.withColumn("seq", F.lit(0)).unionByName(new.withColumn("seq", F.lit(1)))
    return last_wins(both, ["news_id"], "seq").drop("seq")


def set_stage(rows: DataFrame, stage: str, status: Column, as_of: datetime) -> DataFrame:
    """The stage's status; a claim time only while it is in progress."""
    claimed = F.when(status == "IN_PROGRESS", ts(as_of))
    return rows.withColumns({f"status_{stage}": status, "claimed_at": claimed})


def claim_rows(rows: DataFrame, claimed: DataFrame, stage: str, as_of: datetime) -> DataFrame:
    """The claimed rows with the status and claim time they get."""
    mine = rows.join(claimed.select("id"), "id", "left_semi")
    return set_stage(mine, stage, F.lit("IN_PROGRESS"), as_of)


def replace_topics(old: DataFrame, chosen: DataFrame) -> DataFrame:
    """The topics of each user in ``chosen`` give way to the new ones, each once."""
    kept = old.join(chosen.select("user_id").distinct(), "user_id", "left_anti")
    return kept.unionByName(chosen.where("topic_slug IS NOT NULL").select("user_id", "topic_slug").distinct())


def update_profiles(users: DataFrame, changes: DataFrame, as_of: datetime) -> DataFrame:
    """Frequency (which also onboards), switch and delivery time; a change of no known chat is an error row."""
    c = changes.select("chat_id", F.col("frequency").alias("f"), F.col("enabled").alias("e"), F.col("delivered").alias("d"))
    both = users.join(c, "chat_id", "full_outer")
    onboarded = F.coalesce("onboarded_at", F.when(F.col("f").isNotNull(), ts(as_of)))
    return both.select(
        "chat_id", "user_id", F.coalesce("f", "frequency").alias("frequency"), F.coalesce("e", "enabled").alias("enabled"),
        F.when(F.col("user_id").isNotNull(), onboarded).alias("onboarded_at"),
        F.when(F.coalesce("d", F.lit(False)), ts(as_of)).otherwise(F.col("last_delivery_at")).alias("last_delivery_at"),
        F.when(F.col("user_id").isNull(), "unknown_chat").alias("error"),
    )


def payload_json(payload: Column) -> Column:
    """A map as JSON; null where it is empty."""
    return F.when(F.size(payload) > 0, F.to_json(payload))


def append_events(events: DataFrame, users: DataFrame) -> DataFrame:
    """Events with the user of their chat; an event of an unknown chat is kept without a user."""
    who = users.select("chat_id", F.col("user_id").alias("by"))
    out = events.join(who, "chat_id", "left")
    return out.select("event_id", F.col("by").alias("user_id"), "event_type", payload_json(F.col("payload")).alias("payload"))


def priced(intents: DataFrame, prices: tuple[int, ...]) -> DataFrame:
    """Intent events with one of the offered prices; others carry an error."""
    return intents.withColumn("error", F.when(~F.coalesce(F.col("price").isin(*prices), F.lit(False)), "invalid_price"))


def fixed_batches(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """``batch`` and ``place`` of rows cut into batches in order.  For a claimed set, which is bounded."""
    nth = F.row_number().over(Window.orderBy(*order)) - 1
    rows = rows.withColumn("nth", nth)
    return rows.withColumns({"batch": F.floor(F.col("nth") / size).cast("int"), "place": (F.col("nth") % size).cast("int")}).drop("nth")
