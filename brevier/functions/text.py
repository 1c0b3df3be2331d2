"""Column functions for article text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import MAJOR_MEDIA

# Topic keywords, importance keywords, tone lists.
TOPIC_KEYWORDS = {
    "world": ("world", "global", "международ", "миров"),
    "russia": ("росси", "russia", "рф", "москв", "кремл"),
    "economy": ("economy", "economic", "эконом", "инфляц", "ставк", "ввп", "рынок"),
    "business": ("business", "компан", "корпорац", "рынок", "инвест", "акци"),
    "technology": ("technology", "tech", "ai", "ии", "технолог", "цифров"),
    "science": ("science", "research", "наук", "исследован", "учен"),
    "politics": ("politic", "government", "policy", "полит", "правительств", "госдум", "парламент"),
    "society": ("society", "общест", "жител", "социальн", "медицина", "образован"),
    "sports": ("sport", "match", "football", "хокке", "спорт", "матч", "лига", "турнир"),
    "culture": ("culture", "movie", "music", "театр", "культур", "фильм", "книг", "музык"),
}
MUST_EN = ("breaking", "war", "attack", "sanction", "election", "earthquake", "fire", "inflation", "interest rate", "killed", "tariff")
MUST_RU = ("срочн", "удар", "войн", "санкц", "выбор", "землетряс", "пожар", "инфляц", "ставк", "курс", "атак", "погиб", "тариф")
HIGH_EN = ("central bank", "fed", "treasury", "government", "budget", "tax", "tariff", "oil", "gas", "regulator")
HIGH_RU = ("цб", "банк россии", "минфин", "правительств", "бюджет", "налог", "тариф", "нефт", "газ", "регулятор")
HYPE_EN = ("shocking", "sensational", "scandal", "panic", "hyster", "horror", "exclusive", "urgent", "you won't believe", "mind-blowing")
HYPE_RU = ("шок", "сенсац", "скандал", "паник", "истерик", "ужас", "кошмар", "эксклюзив", "срочн", "взорвал")
CLICKBAIT_EN = ("you won't believe", "broke the internet", "nobody expected")
CLICKBAIT_RU = ("вы не поверите", "это взорвало интернет", "никто не ожидал")
WHY_DEFAULT, NEXT_DEFAULT = "Worth following.", "More details are expected."


def clean(x: Column) -> Column:
    """Null to empty, every run of white space to one space, ends stripped."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "), r"^\s+|\s+$", "")


def dedup_key(x: Column) -> Column:
    kept = F.regexp_replace(F.lower(clean(x)), r"[^\p{L}\p{Nd} ]", "")
    return F.trim(F.regexp_replace(kept, " +", " "))


def limit_length(x: Column, n: int) -> Column:
    return F.when(F.length(x) > n, F.concat(F.rtrim(F.substring(x, 1, n - 1)), F.lit("…"))).otherwise(x)


def sentence(x: Column, i: int, default: Column) -> Column:
    """Sentence ``i`` (from 0) of a cleaned text, at most 280 characters."""
    part = F.trim(F.get(F.split(clean(x), r"(?<=[.!?])\s+"), F.lit(i)))
    return limit_length(F.when(F.coalesce(part, F.lit("")) == "", default).otherwise(part), 280)


def language(x: Column) -> Column:
    return F.when(F.lower(F.trim(F.coalesce(x, F.lit("")))).startswith("en"), "en").otherwise("ru")


def bound(x: Column, then: Callable[[Column], Column]) -> Column:
    """``then(x)`` with ``x`` computed once for the row, however often ``then`` uses it."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def any_of(x: Column, words) -> Column:
    """Whether a lower-cased text holds any of the words, anywhere."""
    return reduce(or_, [F.contains(x, F.lit(w)) for w in words])


def count_of(x: Column, words) -> Column:
    """How many of the words a lower-cased text holds."""
    return reduce(add, [F.contains(x, F.lit(w)).cast("int") for w in words])


def matches_topics(x: Column, topics) -> Column:
    known = [w for t in topics for w in TOPIC_KEYWORDS.get(t, ())]
    return bound(F.lower(x), lambda low: any_of(low, known)) if known else F.lit(True)


def importance_score(
    title: Column, summary: Column, why: Column, nxt: Column, media: Column, at: Column, reference: Column, lang: Column | None = None
) -> Column:
    """``lang`` is ``ru`` or ``en`` and chooses the keyword lists; without it they are English."""
    low = F.lower(F.concat_ws(" ", clean(title), clean(summary), clean(why)))
    flag = lambda c, n: F.when(c, n).otherwise(0)
    hours = lambda h: reference - F.expr(f"INTERVAL '{h}' HOUR")
    words = lambda must, high: lambda x: flag(any_of(x, must), 3) + flag(any_of(x, high), 2)
    english = bound(low, words(MUST_EN, HIGH_EN))
    keywords = english if lang is None else F.when(lang == "ru", bound(low, words(MUST_RU, HIGH_RU))).otherwise(english)
    return (
        keywords
        + flag(F.upper(F.trim(media)).isin(*MAJOR_MEDIA), 1)
        + F.when(at > hours(4), 2).when(at > hours(12), 1).otherwise(0)
        + flag((clean(why) != WHY_DEFAULT) | (clean(nxt) != NEXT_DEFAULT), 1)
        + flag(F.length(why) + F.length(nxt) > 180, 1)
    )


def importance(score: Column) -> Column:
    return F.when(score >= 4, "MUST_KNOW").otherwise("GOOD_TO_KNOW")


def fingerprint(*parts: Column) -> Column:
    words = F.split(dedup_key(F.concat_ws(" ", *parts)), " ")
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) >= 4), lambda w: F.substring(w, 1, 6)))


def overlap_ratio(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))


def calm(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(clean(x), "!{2,}", "!"), r"\?{2,}", "?")


#: An ASCII word boundary, whatever the regex engine's own idea of one.
EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def tone_score(x: Column, lang: Column | None = None) -> Column:
    """``lang`` is ``ru`` or ``en`` and chooses the word lists; without it they are English."""
    hits = lambda hype, bait: lambda low: F.least(F.lit(3), count_of(low, hype)) + F.least(F.lit(4), 2 * count_of(low, bait))
    english, russian = hits(HYPE_EN, CLICKBAIT_EN), hits(HYPE_RU, CLICKBAIT_RU)

    def score(text: Column) -> Column:
        words = bound(F.lower(text), english)
        if lang is not None:
            words = F.when(lang == "ru", bound(F.lower(text), russian)).otherwise(words)
        return words + text.rlike(r"[!?]{2,}").cast("int") + text.rlike(EDGE + r"\p{Lu}{4,}" + EDGE).cast("int")

    return bound(x, score)


def percent(n: Column, d: Column) -> Column:
    """One decimal, half up, not capped; 0 where nothing is counted."""
    return F.when(d > 0, F.floor(n * F.lit(1000.0) / d + F.lit(0.5)) / F.lit(10.0)).otherwise(F.lit(0.0))


def fallback_summary(title: Column, text: Column) -> Column:
    first = F.trim(F.substring(F.regexp_extract(clean(text), r"^[^.!?]*[.!?]?", 0), 1, 220))
    alone = (first == "") | (F.lower(first) == F.lower(clean(title)))
    return F.when(alone, clean(title)).otherwise(F.concat(clean(title), F.lit(". "), first))


def stable_id(*parts: Column) -> Column:
    """A name-based UUID (version 3) of the joined parts."""
    h = F.md5(F.concat_ws("|", *parts))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    pieces = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)),
              F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat_ws("-", *pieces)


def code(x: Column, prefix: str) -> Column:
    """``prefix|kind|value`` call-back data, at most 64 characters; null fields otherwise."""
    parts = F.split(x, r"\|", 3)
    good = (F.length(x) <= 64) & (F.get(parts, F.lit(0)) == prefix) & (F.size(parts) >= 2)
    field = lambda i: F.when(good, F.nullif(F.trim(F.get(parts, F.lit(i))), F.lit("")))
    return F.struct(field(1).alias("kind"), field(2).alias("value"))


def segment_slug(x: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9_-]", "_"), "_+", "_")
    return F.substring(s, 1, 24)


def summary_language(x: Column) -> Column:
    """The language of a summary: ru, en or es by prefix, else ru."""
    low = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    return F.when(low.startswith("en"), "en").when(low.startswith("es"), "es").otherwise("ru")


def first_non_blank(*xs: Column) -> Column:
    """The first text that is more than blanks, trimmed; empty if there is none."""
    return F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in xs], F.lit(""))


def summary_or(summary: Column, title: Column, default: str) -> Column:
    return F.coalesce(*[F.nullif(clean(x), F.lit("")) for x in (summary, title)], F.lit(default))


def gauge(x: Column, percent: bool) -> Column:
    """NaN, infinite and null as 0; a share kept within 0 to 100, a count at 0 or more."""
    sound = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
    return F.least(F.greatest(sound, F.lit(0.0)), F.lit(100.0)) if percent else F.greatest(sound, F.lit(0.0))


def age_minutes(at: Column, now: Column) -> Column:
    """Whole minutes, not below 0; a day where the time is not known."""
    return F.coalesce(F.greatest(F.floor(F.timestamp_diff("SECOND", at, now) / 60), F.lit(0)), F.lit(24 * 60)).cast("long")


def freshness(at: Column, now: Column) -> Column:
    return F.lit(360) - F.least(age_minutes(at, now), F.lit(360))


def duration_text(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60.0 + F.lit(0.5)).cast("long")
    return F.when(seconds.isNull() | (seconds < 60), "< 1 мин").otherwise(F.concat(F.lit("~"), minutes.cast("string"), F.lit(" мин")))


def last_url_line(x: Column) -> Column:
    lines = F.transform(F.split(x, r"\r\n|[\n\r]"), lambda line: F.trim(line))
    return F.try_element_at(F.filter(lines, lambda line: line.rlike("^https?://")), F.lit(-1))


def shortened(x: Column, most: int) -> Column:
    """At most ``most`` characters, the last one an ellipsis where something is cut."""
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.trim(F.left(x, F.lit(most - 1))), F.lit("…")))


def valid_topics(xs: Column, known) -> Column:
    """At most eight different topics, each a known one of small letters, digits and dashes."""
    fits = F.forall(xs, lambda x: x.rlike("^[a-z][a-z0-9_-]{1,31}$") & x.isin(*known))
    return (F.size(xs) <= 8) & (F.size(F.array_distinct(xs)) == F.size(xs)) & fits


def toggled(xs: Column, x: Column) -> Column:
    """``xs`` with ``x`` added, or taken out unless it is the only one; sorted."""
    without = F.array_remove(xs, x)
    return F.array_sort(F.when(~F.array_contains(xs, x), F.array_append(xs, x)).when(F.size(without) == 0, xs).otherwise(without))
