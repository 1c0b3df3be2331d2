"""JSON bodies: chat updates, feedback requests, embedding and language-model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_non_blank

CHAT = "chat:struct<id:string>"
UPDATE = (
    f"struct<message:struct<{CHAT},text:string,caption:string>,"
    f"callback_query:struct<message:struct<{CHAT}>,data:string>>"
)
#: What a command does, by its first word; anything else is help.
COMMANDS = {
    "/start": "start", "/topics": "topics", "/frequency": "frequency", "/profile": "profile",
    "/unsubscribe": "unsubscribe", "/stop": "unsubscribe", "/premium": "premium",
}
#: Which part handles a pressed button, by its prefix.
PREFIXES = {"ob": "onboarding", "pi": "premium", "fb": "feedback"}


def whole_number(x: Column) -> Column:
    """A JSON scalar as a long; null where it is none."""
    return F.trim(x).try_cast("bigint")


def arguments(text: Column) -> Column:
    """What follows a command, split at commas and blanks."""
    return F.filter(F.split(F.regexp_replace(text, r"^\S+", ""), r"[,\s]+"), lambda w: w != "")


def command(text: Column) -> Column:
    out: Column = F.lit("help")
    for word, action in reversed(COMMANDS.items()):
        out = F.when(text.startswith(word), action).otherwise(out)
    return out


def update(bodies: DataFrame) -> DataFrame:
    """``bodies`` (.., body) with chat, text (the caption where there is none), data, action, handler, arguments."""
    b = F.from_json("body", UPDATE)
    rows = bodies.withColumn("u", b)
    text = F.coalesce("u.message.text", "u.message.caption")
    data = F.col("u.callback_query.data")
    handler: Column = F.lit("unknown")
    for prefix, name in PREFIXES.items():
        handler = F.when(F.split(data, r"\|")[0] == prefix, name).otherwise(handler)
    return rows.withColumns({
        "chat": whole_number(F.coalesce("u.message.chat.id", "u.callback_query.message.chat.id")), "text": text, "data": data,
        "action": F.when(data.isNotNull(), "callback").otherwise(command(F.coalesce(text, F.lit("")))),
        "handler": F.when(data.isNotNull(), handler), "arguments": arguments(F.coalesce(text, F.lit(""))),
    }).drop("u", "body")


def feedback_request(bodies: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """``bodies`` with status (ok, invalid_request, invalid_event_type), chat, kind."""
    r = F.from_json("body", "struct<chatId:string,eventType:string,newsId:string,eventValue:string>")
    rows = bodies.withColumn("r", r)
    chat = whole_number(F.col("r.chatId"))
    kind = F.lower(F.trim("r.eventType"))
    status = F.when(chat.isNull(), "invalid_request").when(~F.coalesce(kind.isin(*kinds), F.lit(False)), "invalid_event_type").otherwise("ok")
    return rows.withColumns({"status": status, "chat": chat, "kind": kind}).drop("r", "body")


def embedding_answer(bodies: DataFrame) -> DataFrame:
    """A row for each vector of an answer, with its place; a body of another form gives none."""
    vectors = F.from_json("body", "struct<embeddings:array<array<float>>>")["embeddings"]
    return bodies.select(*[c for c in bodies.columns if c != "body"], F.posexplode(vectors).alias("place", "vector"))


def llm_answer(body: Column) -> Column:
    """The text of a chat answer: a choice's content as text or as parts, a candidate's parts,
    or a message's content; empty if there is none."""
    plain = F.get_json_object(body, "$.choices[0].message.content")
    parts = F.from_json(plain, "array<struct<text:string>>")
    joined = lambda xs: F.array_join(F.transform(xs, lambda p: p["text"]), " ")
    choice = F.when(plain.startswith("[{"), joined(parts)).otherwise(plain)
    candidate = joined(F.from_json(F.get_json_object(body, "$.candidates[0].content.parts"), "array<struct<text:string>>"))
    return first_non_blank(choice, candidate, F.get_json_object(body, "$.message.content"))
