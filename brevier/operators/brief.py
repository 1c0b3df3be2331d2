"""The ranked digest: candidates, features, rank, greedy selection."""

from __future__ import annotations

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import ts

OVERLAP, RATIO = 5, 0.6


def candidates(news: DataFrame, latest: DataFrame, as_of: datetime, hours: int, limit: int) -> DataFrame:
    """The most recent summarised items of the lookback, eight for each wanted item."""
    recent = news.where((F.col("status_summary") == "DONE") & (F.col("event_at") >= ts(as_of - timedelta(hours=hours))))
    s = latest.select(F.col("news_id").alias("id"), "summary")
    rows = recent.join(s, "id").orderBy(F.col("event_at").desc(), "id").limit(8 * limit)
    title = T.limit_length(T.clean(F.col("content_clean")), 60)
    return rows.select("id", "url", "media", "event_at", title.alias("title"), "summary")


def first_seen(rows: DataFrame) -> DataFrame:
    """Drop repeated titles, then repeated urls among what is left, in candidate order."""
    order = [F.col("event_at").desc(), F.col("id")]
    rows = rows.where("title <> '' AND url <> ''").withColumn("key", T.dedup_key(F.col("title")))
    for column in ("key", "url"):
        rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy(column).orderBy(*order))).where("rn = 1").drop("rn")
    return rows.drop("key")


def ranked(rows: DataFrame, topics: tuple[str, ...] = ()) -> DataFrame:
    """Summary parts, importance and rank of each candidate."""
    parts = {
        "what": T.sentence(F.col("summary"), 0, F.col("title")),
        "why": T.sentence(F.col("summary"), 1, F.lit(T.WHY_DEFAULT)),
        "next": T.sentence(F.col("summary"), 2, F.lit(T.NEXT_DEFAULT)),
    }
    rows = rows.withColumns(parts)
    if topics:
        rows = rows.where(T.matches_topics(F.concat_ws(" ", "title", "summary", "media", "what", "why", "next"), topics))
    latest = rows.agg(F.max("event_at").alias("reference"))
    rows = rows.join(F.broadcast(latest))  # one row
    c = F.col
    score = T.importance_score(c("title"), c("summary"), c("why"), c("next"), c("media"), c("event_at"), c("reference"))
    shown = [F.when(c(p) != d, c(p)) for p, d in (("why", T.WHY_DEFAULT), ("next", T.NEXT_DEFAULT))]
    rows = rows.withColumn("score", score).withColumns(
        {
            "importance": T.importance(c("score")),
            "tokens": T.fingerprint(c("title"), c("what"), *shown),
            "tone": T.tone_score(T.calm(F.concat_ws(" ", "title", "what", "why", "next"))),
        }
    )
    order = Window.orderBy(c("score").desc(), c("event_at").desc_nulls_last(), "title", "id")
    return rows.withColumn("rank", F.row_number().over(order))  # at most eight times the limit of rows


def quota(must: int, good: int, most: int) -> int:
    if not must:
        return 0
    if not good:
        return min(most, must)
    return min(min(max(1, -(-most // 3)), must), max(1, most - 1))


def choose(items: list[dict], near: dict[int, set[int]], most: int) -> list[dict]:
    """Six greedy passes in rank order; a pass asks for a label and, if fresh, an unused medium."""
    chosen: list[dict] = []
    must = sum(x["importance"] == "MUST_KNOW" for x in items)
    share = quota(must, len(items) - must, most)

    def twin(x: dict) -> bool:
        mine = set(x["tokens"])
        for y in chosen:
            other = set(y["tokens"])
            common = len(mine & other)
            if y["id"] in near.get(x["id"], ()) or mine == other:
                return True
            if common >= OVERLAP and common / max(1, min(len(mine), len(other))) >= RATIO:
                return True
        return False

    def count(label: str) -> int:
        return sum(x["importance"] == label for x in chosen)

    for label, fresh in (("MUST_KNOW", 1), ("MUST_KNOW", 0), ("GOOD_TO_KNOW", 1), ("GOOD_TO_KNOW", 0), (None, 1), (None, 0)):
        room = share - count(label) if label == "MUST_KNOW" else most - len(chosen)
        for x in items:
            if room <= 0 or len(chosen) >= most:
                break
            if (label and x["importance"] != label) or x["url"] in {y["url"] for y in chosen}:
                continue
            if fresh and (x["media"] or "").strip() and x["media"] in {y["media"] for y in chosen}:
                continue
            if twin(x) or x["tone"] >= (7 if x["importance"] == "MUST_KNOW" else 5):
                continue
            chosen.append(x)
            room -= 1
    return chosen


def select_digest(rows: DataFrame, near_pairs: DataFrame, most: int) -> DataFrame:
    """The digest in selection order.  ``rows`` is one brief's ranked candidates."""
    pairs = near_pairs.groupBy("src").agg(F.collect_set("dst").alias("near")).withColumnRenamed("src", "id")
    rows = rows.join(pairs, "id", "left").withColumn("brief", F.lit(0))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        items = pdf.sort_values("rank").to_dict("records")
        near = {x["id"]: set(x["near"]) for x in items if x["near"] is not None}
        got = choose(items, near, most)
        return pd.DataFrame(
            {"position": range(1, len(got) + 1), **{c: [x[c] for x in got] for c in ("id", "media", "importance", "score")}}
        )

    kept = rows.select("brief", "rank", "id", "url", "media", "importance", "score", "tokens", "tone", "near")
    return kept.groupBy("brief").applyInPandas(pick, "position long, id long, media string, importance string, score int")
