"""Messages as text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_non_blank

# The words of a digest and the instructions by language.
LABELS = ("Важность: ", "Что случилось: ", "Почему важно: ", "Что дальше: ", "Источник: ")
NO_TIME = "время н/д"
PROMPTS = {"ru": "Кратко изложи новость.", "en": "Summarise the news in brief.", "es": "Resume la noticia en breve."}


def card(place: Column, title: Column, importance: Column, at: Column, what: Column, why: Column, nxt: Column, media: Column, url: Column) -> Column:
    """One item of a digest."""
    label = F.when(importance == "MUST_KNOW", "must know").otherwise("good to know")
    time = F.coalesce(F.date_format(at, "HH:mm"), F.lit(NO_TIME))
    lines = [
        F.concat(place.cast("string"), F.lit(". "), title), F.concat(F.lit(LABELS[0]), label, F.lit(" • "), time),
        *[F.concat(F.lit(name), x) for name, x in zip(LABELS[1:], (what, why, nxt, media), strict=True)], url,
    ]
    return F.concat_ws("\n", *lines)


def header(name: str, at: Column) -> Column:
    return F.concat(F.lit(f"{name}\nОбновлено: "), F.date_format(at, "dd.MM.yyyy HH:mm"))


def segment_line(segment: Column, pct: Column, users: Column, delivered: Column, events: Column) -> Column:
    return F.format_string("- %s: %.1f%% (%d/%d users, %d events)", segment, pct, users, delivered, events)


def prompt(lang: Column, title: Column, body: Column, most: int = 12_000) -> Column:
    """The instruction of the language, then the title and as much of the text as is let in."""
    said: Column = F.lit(PROMPTS["ru"])
    for k in ("en", "es"):
        said = F.when(lang == k, PROMPTS[k]).otherwise(said)
    return F.concat_ws("\n", said, title, F.left(first_non_blank(body, title), F.lit(most)))
