from datetime import datetime

from brevier.functions import html
from brevier.functions import text as X
from brevier.operators import backlog, brief, report
from brevier.sources import feeds
from pyspark.sql import functions as F


def one(spark, expr, **values):
    columns = [F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")]
    return spark.range(1).select(*columns).select(expr.alias("r")).first()["r"]


def test_text(spark):
    assert one(spark, X.clean(F.col("t")), t=" a\r\n b\t c ") == "a b c"
    assert one(spark, X.dedup_key(F.col("t")), t="Hello,  WORLD! №5") == "hello world 5"
    assert one(spark, X.limit_length(F.col("t"), 5), t="abc defg") == "abc…"
    assert one(spark, X.sentence(F.col("t"), 1, F.lit("none")), t="One. Two! Three?") == "Two!"
    assert one(spark, X.sentence(F.col("t"), 5, F.lit("none")), t="One.") == "none"
    assert one(spark, X.calm(F.col("t")), t="What??? Wow!!") == "What? Wow!"
    assert one(spark, X.tone_score(F.col("t")), t="SHOCKING: you won't believe this panic!?") == 7
    assert one(spark, X.percent(F.lit(2), F.lit(1))) == 200.0
    assert one(spark, X.percent(F.lit(2), F.lit(0))) == 0.0
    assert one(spark, X.segment_slug(F.lit(" A b!!C "))) == "a_b_c"
    assert one(spark, X.code(F.lit("fb|useful|42"), "fb")).asDict() == {"kind": "useful", "value": "42"}
    assert one(spark, X.code(F.lit("zz|useful|42"), "fb")).asDict() == {"kind": None, "value": None}


def test_stable_id_is_a_version_3_uuid(spark):
    import hashlib
    import uuid

    digest = hashlib.md5(b"a|b").digest()
    assert one(spark, X.stable_id(F.lit("a"), F.lit("b"))) == str(uuid.UUID(bytes=digest, version=3))


def test_html():
    long = "A sentence that is long enough to be kept. " * 8
    page = f"<html><script>x</script><nav><p>menu</p></nav><article><p>{long}</p><p>End.</p></article></html>"
    assert html.article_text(page) == f"{long.strip()}\n\nEnd."
    assert html.article_text("") == ""
    assert html.chunks("a. b.", 3) == ["a.", "b."]
    assert html.clean_article("T", "D", "") == "T\n\nD"
    body = "First paragraph, long enough to be kept in the end.\n\nFirst paragraph, long enough to be kept in the end.\n\n"
    body += "Second paragraph, long enough to be kept in the end.\n\nRelated article: more"
    assert html.clean_article("", "", body).count("\n\n") == 1


def test_feeds(spark):
    rss = '<?xml version="1.0"?><rss><item><title>A b</title><link>https://x/1</link><description><![CDATA[d]]></description>'
    rss += "<pubDate>Fri, 08 Mar 2024 10:00:00 GMT</pubDate></item><item><title>no link</title></item></rss>"
    atom = '<feed><entry><title>E</title><link href="https://y/2"/><summary>s</summary><updated>2024-03-08T10:00:00+00:00</updated></entry></feed>'
    df = spark.createDataFrame([("S", rss), ("T", atom), ("U", "junk"), ("V", None)], "source string, xml string")
    got = {r["source"]: r for r in feeds.parse_feeds(df).collect()}
    assert set(got) == {"S", "T"}
    assert (got["S"]["id"], got["S"]["title"], got["S"]["description"]) == ("https://x/1", "A b", "d")
    assert got["T"]["link"] == "https://y/2"
    assert got["S"]["published_at"] == got["T"]["published_at"] == datetime(2024, 3, 8, 10)
    urls = one(spark, feeds.candidate_urls(F.lit("https://a.com/rss")))
    assert urls[0] == "https://a.com/rss" and "http://www.a.com/rss/index.xml" in urls and len(urls) == len(set(urls))


def item(i, importance, media, tokens=(), tone=0):
    return {"id": i, "url": f"u{i}", "importance": importance, "media": media, "tokens": list(tokens) or [f"t{i}"], "tone": tone}


def test_greedy_selection():
    must, good = "MUST_KNOW", "GOOD_TO_KNOW"
    items = [item(1, must, "A"), item(2, must, "A"), item(3, good, "A"), item(4, good, "B"), item(5, good, "C", tone=5)]
    assert brief.quota(2, 3, 4) == 2 and brief.quota(0, 3, 4) == 0 and brief.quota(5, 0, 4) == 4
    assert [x["id"] for x in brief.choose(items, {2: {1}}, 4)] == [1, 4, 3]
    same = [item(1, good, "A", "abcdef"), item(2, good, "B", "abcdeg"), item(3, good, "C")]
    assert [x["id"] for x in brief.choose(same, {}, 3)] == [1, 3]


def test_due_users(spark):
    at = datetime(2026, 3, 8, 12)
    rows = [
        (1, "a", "DAILY", True, None, datetime(2026, 3, 7, 11)), (2, "b", "DAILY", True, None, datetime(2026, 3, 7, 13)),
        (3, "c", "EVERY_2_DAYS", True, datetime(2026, 3, 1), None), (4, "d", "DAILY", True, None, None),
        (5, "e", "DAILY", False, datetime(2026, 3, 1), None),
    ]
    kind = "user_id long, chat_id string, frequency string, enabled boolean, onboarded_at timestamp_ntz, last_delivery_at timestamp_ntz"
    got = report.due_users(spark.createDataFrame(rows, kind), at).collect()
    assert sorted(r["user_id"] for r in got) == [1, 3]


def test_upsert_keeps_and_replaces(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, r string, p string")
    new = spark.createDataFrame([(2, None, None), (3, "c", "z")], "k int, r string, p string")
    got = sorted(map(tuple, backlog.upsert(old, new, "k", ["r"], ["p"]).collect()))
    assert got == [(1, "a", "x"), (2, None, "y"), (3, "c", "z")]
