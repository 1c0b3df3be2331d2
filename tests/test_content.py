"""Content cleaning, HTML places, feed addresses, messages and merges on small inputs."""

import pytest
from brevier.functions import html
from brevier.functions import text as X
from brevier.operators import planner, store
from brevier.sources import feeds, messages
from pyspark.sql import functions as F

LONG = "This paragraph is long enough to be kept by the rule for short ones, and it ends well."


def test_cleaner_cuts_head_tail_and_markers():
    raw = f"menu {'x ' * 100}Title here\n\nText: by someone\n\n{LONG}\n\nRelated article: more\n\n{LONG} again"
    assert html.clean_article("Title here", "", raw) == LONG
    assert html.clean_article("T", "<b>D</b>", "short") == "T\n\nD"
    twice = f"Text: one\n\n{LONG}\n\ntext: two\n\n{LONG} again"
    assert html.clean_article("", "", twice) == LONG
    for noise in ("Scan the QR code to go on with the app.", "At 10:20 and 11:30 the trains leave from here today.", "see http://a.b and http://c.d for all of it.", "no mark"):
        assert html.clean_article("", "", f"{LONG}\n\n{noise}\n\n{LONG} again") == f"{LONG}\n\n{LONG} again"


def test_places_of_an_article_depend_on_the_medium():
    inside, outside = "a" * 300, "b" * 300
    page = f"<main><p>{outside}</p></main><div class='x news-text-1'><p>{inside}</p></div><script>no</script>"
    assert html.article_text(page, "TASS") == inside
    assert html.article_text(page) == outside
    assert html.article_text(f"<div class='entry-content'><p>{inside}<p>end</div><p>{outside}</p>") == f"{inside}\n\nend"
    assert html.article_text("<nav>off</nav><p>one<br>two</p>") == "one two" or "one" in html.article_text("<p>one<br>two</p>")


def test_messages_are_cut_at_blank_lines():
    text = "a" * 3000 + "\n\n" + "b" * 3000
    assert html.message_parts(text) == ["a" * 3000, "b" * 3000]
    assert [len(p) for p in html.message_parts("c" * 8000)] == [3900, 3900, 200]
    assert html.message_parts("short") == ["short"]


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


def value(one, column):
    return one.select(column).first()[0]


def test_feed_addresses(one):
    made = value(one, feeds.candidate_urls(F.lit("https://www.a.org/rss")))
    assert made[0] == "https://www.a.org/rss" and "http://a.org/rss/index.xml" in made and len(made) == 12
    assert value(one, feeds.candidate_urls(F.lit("http://localhost/feed"))) == ["http://localhost/feed", "http://localhost/feed.xml"]
    assert value(one, feeds.candidate_urls(F.lit("https://a.org/x.xml")))[1:] == ["http://a.org/x.xml", "https://www.a.org/x.xml", "http://www.a.org/x.xml"]
    assert len(value(one, feeds.search_urls(F.lit("https://www.a.org/rss"), F.lit("ru")))) == 5
    assert value(one, feeds.search_urls(F.lit("https://news.google.com/rss"), F.lit("ru"))) == []
    link = feeds.preferred_link(F.lit("https://news.google.com/x"), F.lit('<a href="https://news.google.com/y">n</a> <a class="k" href="https://b.org/z">z</a>'))
    assert value(one, link) == "https://b.org/z"
    assert value(one, feeds.unwrapped(F.lit("https://www.google.com/url?sa=t&url=https%3A%2F%2Fb.org%2Fz%3Fq%3D1"))) == "https://b.org/z?q=1"


def test_first_answer_of_a_feed(spark):
    tries = spark.createDataFrame([("f", 0, [], True), ("f", 1, ["x"], False), ("f", 2, ["y"], True), ("f", 3, ["z"], True), ("g", 0, [], True)], "feed string, place int, items array<string>, ok boolean")
    assert [tuple(r) for r in feeds.first_answer(tries).collect()] == [("f", ["y"], 2)]


def test_updates(spark):
    bodies = [
        '{"message":{"chat":{"id":7},"text":"/topics world, economy"}}', '{"message":{"chat":{"id":"8"},"caption":"hello"}}',
        '{"callback_query":{"message":{"chat":{"id":9}},"data":"ob|topic|world"}}', "broken",
    ]
    got = messages.update(spark.createDataFrame(list(enumerate(bodies)), "n long, body string")).collect()
    assert [(r["chat"], r["action"], r["handler"]) for r in sorted(got)] == [(7, "topics", None), (8, "help", None), (9, "callback", "onboarding"), (None, "help", None)]
    assert sorted(got)[0]["arguments"] == ["world", "economy"]


def test_small_text_rules(one):
    assert value(one, X.last_url_line(F.lit("a\n https://b.org \nc"))) == "https://b.org"
    assert value(one, X.duration_text(F.lit(59))) == "< 1 мин" and value(one, X.duration_text(F.lit(100))) == "~2 мин"
    assert value(one, X.gauge(F.lit(float("inf")), True)) == 0.0 and value(one, X.gauge(F.lit(140.0), True)) == 100.0
    assert value(one, X.toggled(F.array(F.lit("a")), F.lit("a"))) == ["a"]
    assert value(one, X.tone_score(F.lit("Шок и сенсация, вы не поверите"), F.lit("ru"))) == 4


def test_profiles_of_unknown_chats_are_errors(spark):
    from datetime import datetime

    users = spark.createDataFrame([("a", 1, "DAILY", True, None, None)], "chat_id string, user_id long, frequency string, enabled boolean, onboarded_at timestamp_ntz, last_delivery_at timestamp_ntz")
    changes = spark.createDataFrame([("a", "EVERY_2_DAYS", None, None), ("b", None, False, None)], "chat_id string, frequency string, enabled boolean, delivered boolean")
    got = {r["chat_id"]: r for r in store.update_profiles(users, changes, datetime(2024, 1, 1)).collect()}
    assert got["a"]["onboarded_at"] == datetime(2024, 1, 1) and got["a"]["frequency"] == "EVERY_2_DAYS" and got["a"]["error"] is None
    assert got["b"]["error"] == "unknown_chat"


def test_providers():
    assert planner.providers("a", ["b", "a", "c"], {"a", "c"}) == ["a", "c"]


def test_feeds_as_a_source(spark, tmp_path):
    from brevier.sources import fetch

    fetch.register(spark)
    good, empty = tmp_path / "good.xml", tmp_path / "empty.xml"
    good.write_text("<rss><item><title>é</title><link>https://x/1</link></item></rss>", encoding="utf-8")
    empty.write_text("<rss></rss>")
    options = {"one": f"file://{tmp_path}/none.xml file://{empty} file://{good}", "two": f"file://{empty}"}
    rows = spark.read.format("feeds").options(**options).load()
    assert [(r["feed"], r["place"]) for r in rows.collect()] == [("one", 2)]
    items = feeds.parse_feeds(rows.selectExpr("feed AS source", "body AS xml")).collect()
    assert [(r["id"], r["title"]) for r in items] == [("https://x/1", "é")]
    assert fetch.charset('text/xml; charset="ISO-8859-1"') == "ISO-8859-1" and fetch.charset(None) == "utf-8"
