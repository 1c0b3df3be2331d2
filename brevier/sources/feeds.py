"""Feed items from RSS and Atom documents, and the URLs under which a feed may be found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stable_id

ITEM = "array<struct<guid:string,title:string,link:string,description:string,pubDate:string,language:string>>"


def _texts(xml: Column, path: str) -> Column:
    return F.xpath(xml, F.lit(path))


def parse_feeds(feeds: DataFrame) -> DataFrame:
    """One row per item of ``feeds`` (source, xml): items if there are any, else entries.

    Items without a link are dropped; the id is the guid, else the link; the title has its
    no-break spaces turned to spaces and a default.  Malformed documents give no rows.
    """
    body = F.regexp_replace(F.translate("xml", "﻿\u0000​", ""), r"^[^<]+", "")
    body = F.regexp_replace(F.regexp_replace(body, r"<(/?)(\w+):(\w+)", "<$1$2_$3"), r"\s(?:xmlns(?::\w+)?)=\"[^\"]*\"", "")
    rows = feeds.select("source", body.alias("x"))
    kind = F.when(F.regexp_count("x", F.lit("<item[ >]")) > 0, "item").otherwise("entry")
    rows = rows.withColumn("kind", kind)
    blocks = F.regexp_extract_all("x", F.concat(F.lit("(?s)<"), "kind", F.lit(r"[ >].*?</"), "kind", F.lit(">")), F.lit(0))
    rows = rows.select("source", F.posexplode(blocks).alias("place", "item"))
    tag = lambda name: F.nullif(F.trim(F.regexp_replace(F.regexp_replace(
        F.regexp_extract("item", rf"(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1), r"(?s)^\s*<!\[CDATA\[(.*)\]\]>\s*$", "$1"), " ", " ")), F.lit(""))
    href = F.nullif(F.regexp_extract("item", r"<link[^>]*href=\"([^\"]+)\"", 1), F.lit(""))
    link = F.coalesce(tag("link"), href)
    out = rows.select(
        "source", "place", link.alias("link"), F.coalesce(tag("guid"), tag("id"), link).alias("id"), F.coalesce(tag("title"), F.lit("(untitled)")).alias("title"),
        F.coalesce(tag("description"), tag("summary"), tag("content"), tag("content_encoded")).alias("description"),
        F.coalesce(tag("pubDate"), tag("published"), tag("updated"), tag("dc_date")).alias("raw_date"),
    )
    out = out.where("link IS NOT NULL")
    return out.select("id", "link", "title", "description", "source", parse_date(F.col("raw_date")).alias("published_at"))


def parse_date(x: Column) -> Column:
    """RFC 1123 (weekday aside), ISO with or without offset; null if none fits."""
    bare = F.regexp_replace(x, r"^[A-Za-z]{3},\s*", "")
    zoned = F.regexp_replace(F.regexp_replace(bare, r"\b(GMT|UTC?|Z)$", "+0000"), r"([+-]\d\d):(\d\d)$", "$1$2")
    formats = ("d MMM yyyy HH:mm:ss xx", "yyyy-MM-dd'T'HH:mm:ssxx", "yyyy-MM-dd'T'HH:mm:ss.SSSxx", "yyyy-MM-dd'T'HH:mm:ss")
    return F.coalesce(*[F.try_to_timestamp(zoned, F.lit(f)) for f in formats])


LOCAL = ("localhost", "127.0.0.1", "::1")


def candidate_urls(url: Column) -> Column:
    """The url itself, then its host without or with www, each with the variants of its path
    (those that feeds use in place of ``/rss``, ``/rss/``, ``/rss.xml`` and ``/feed``), https
    before http; a local host keeps its scheme and its name."""
    scheme, host = F.parse_url(url, F.lit("PROTOCOL")), F.parse_url(url, F.lit("HOST"))
    path = F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit(""))
    local = F.lower(host).isin(*LOCAL)
    twin = F.when(host.startswith("www."), F.substring(host, 5, 1000)).otherwise(F.concat(F.lit("www."), host))
    hosts = F.when(local, F.array(host)).otherwise(F.array(host, twin))
    less = lambda n: F.left(path, F.length(path) - n)
    made = lambda *xs: F.array(path, *xs)
    paths = (
        F.when(path.endswith("/rss"), made(F.concat(path, F.lit(".xml")), F.concat(path, F.lit("/index.xml"))))
        .when(path.endswith("/rss/"), made(F.concat(path, F.lit("index.xml")), F.concat(less(1), F.lit(".xml"))))
        .when(path.endswith("/rss.xml"), made(less(4), F.concat(less(4), F.lit("/index.xml"))))
        .when(path.endswith("/feed"), made(F.concat(path, F.lit(".xml"))))
        .otherwise(made())
    )
    schemes = F.when(local, F.array(scheme)).otherwise(F.array(F.lit("https"), F.lit("http")))
    one = lambda h, p: F.transform(schemes, lambda s: F.concat(s, F.lit("://"), h, p))
    every = F.flatten(F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: one(h, p)))))
    return F.array_distinct(F.concat(F.array(url), F.coalesce(every, F.array().cast("array<string>"))))


def search_urls(url: Column, language: Column) -> Column:
    """News searches that stand in for a feed that gives nothing: by site, by name, by the name in quotes."""
    host = F.parse_url(url, F.lit("HOST"))
    site = F.when(host.startswith("www."), F.substring(host, 5, 1000)).otherwise(host)
    locale = F.when(F.lower(language) == "ru", "hl=ru&gl=RU&ceid=RU:ru").otherwise("hl=en-US&gl=US&ceid=US:en")
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    asked = F.array(F.concat(F.lit("site:"), site), site, quoted(site))
    asked = F.when(site != host, F.concat(asked, F.array(host, quoted(host)))).otherwise(asked)
    made = F.transform(asked, lambda q: F.concat(F.lit("https://news.google.com/rss/search?q="), F.url_encode(q), F.lit("&"), locale))
    return F.when(host.isNull() | host.contains("news.google."), F.array().cast("array<string>")).otherwise(made)


def preferred_link(link: Column, description: Column) -> Column:
    """A link of a news search gives way to the first other link in the description."""
    searched = lambda u: F.coalesce(F.lower(F.try_parse_url(u, F.lit("HOST"))).contains("news.google."), F.lit(False))
    links = F.regexp_extract_all(F.coalesce(description, F.lit("")), F.lit(r"<a\s[^>]*href=[\"']([^\"']+)"), F.lit(1))
    other = F.get(F.filter(links, lambda u: (F.trim(u) != "") & ~searched(u)), F.lit(0))
    return F.trim(F.when(searched(link), F.coalesce(other, link)).otherwise(link))


def unwrapped(url: Column) -> Column:
    """The address that a search engine's redirect leads to (``url``, ``q`` or ``continue``)."""
    plain = F.try_url_decode(url)
    inner = lambda k: F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(k)))
    found = F.coalesce(*[F.when(inner(k).rlike("^https?://"), inner(k)) for k in ("url", "q", "continue")])
    redirect = F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))).contains("google."), F.lit(False))
    return F.when(redirect, F.coalesce(found, plain)).otherwise(plain)


def first_answer(answers: DataFrame) -> DataFrame:
    """``answers`` (feed, place, items, ok): of each feed the items of the first try that gave any."""
    good = answers.where(F.col("ok") & (F.size("items") > 0))
    return good.groupBy("feed").agg(F.min_by("items", "place").alias("items"), F.min("place").alias("place"))


def item_id(media: Column, title: Column, at: Column, description: Column) -> Column:
    return stable_id(media, title, at, description)


def dispatch(news: DataFrame, known: dict[str, tuple[tuple[str, int], ...]], general: tuple[str, int]) -> DataFrame:
    """Each item with the processor of the highest priority that takes its medium, else the general one."""
    best = {medium: max(own, key=lambda p: p[1]) for medium, own in known.items()}
    name, priority = F.lit(general[0]), F.lit(general[1])
    for medium, (n, p) in best.items():
        if p > general[1]:
            name, priority = F.when(F.col("media") == medium, n).otherwise(name), F.when(F.col("media") == medium, p).otherwise(priority)
    return news.withColumns({"name": name, "priority": priority})
