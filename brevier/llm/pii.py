"""Personal data: patterns propose spans, checks confirm them, context adjusts the score.

Base kinds (always reported when their check holds, leftmost and non-overlapping per kind,
failing matches dropped without another try): email; ip, parts at most 255; card, 14 to 19
digits passing Luhn; phone, ``+`` and 10 to 15 digits.

Added kinds, kept when their score reaches ``MIN_SCORE`` and they overlap no base span:
iban (mod-97 holds), key (private key heads and the prefixed keys of large services),
password (an assignment), and ssn, tel and secret (a long run of letters and digits), whose
pattern alone scores too little.  Each kind has a first score; a context word of its kind
among the ``CONTEXT`` characters before a span raises it by ``GAIN``, a word of samples and
reference numbers lowers it by ``LOSS``.  Scores are whole percent; base spans stay whatever
their score.

Places are found without a UDF: ``split`` gives the text between matches and
``regexp_extract_all`` the matches, in step, so running lengths are the offsets.  The scan
patterns are the base ones with possessive loops and a look-behind that only skips starts
inside a run that has already failed, which keeps long runs linear.

Defined cases: a null text counts as empty; whole texts are scanned whatever their length;
repeated rows give repeated results; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hof import bind, prefix_sums, total

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "tel", "secret", "key", "password")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "tel": r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
    "secret": r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+",
    "key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----|AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}",
    "password": r"(?i)(?:password|passwd|pwd|passwort|contrase\x{F1}a)[\x20]*[:=][\x20]*[^\x20\x09-\x0D]{4,}",
}
SCORES = {"email": 80, "ip": 80, "card": 80, "phone": 80, "iban": 90, "ssn": 40, "tel": 40, "secret": 40, "key": 100, "password": 80}
RAISING = {
    "email": "(?i)(?:mail|contact|kontakt|correo)", "ip": "(?i)(?:ip|host|server|address)", "card": "(?i)(?:card|visa|credit|karte|carte|tarjeta)",
    "phone": "(?i)(?:phone|tel|call|mobile|fax)", "iban": "(?i)(?:iban|account|konto|compte|cuenta)", "ssn": "(?i)(?:ssn|social security)",
    "tel": "(?i)(?:phone|tel|call|mobile|fax)", "secret": "(?i)(?:token|secret|password|credential|bearer|api.?key|access.?key)",
    "key": "(?i)(?:key|secret)", "password": "(?i)(?:login|user|account)",
}
LOWERING = "(?i)(?:sample|example|placeholder|invoice|order no|isbn)"
CONTEXT, GAIN, LOSS, MIN_SCORE = 40, 40, 30, 60
SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string,score:int>>"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    def check(d: Column) -> Column:
        n = F.length(d)

        def term(i: Column) -> Column:
            x = (F.ascii(F.substr(d, n - i, F.lit(1))) - 48) * F.when(i % 2 == 1, 2).otherwise(1)
            return F.when(x > 9, x - 9).otherwise(x).cast("long")

        places = F.sequence(F.lit(0), n - 1)
        return F.when(n.between(14, 19), total(F.transform(places, term)) % 10 == 0).otherwise(F.lit(False))

    return bind(_digits(hit), check)


def _octets(hit: Column) -> Column:
    small = lambda p: F.regexp_replace(p, "^0+", "")
    value = lambda p: F.coalesce(small(p).try_cast("int"), F.lit(0))
    return F.forall(F.split(hit, "[.]"), lambda p: (F.length(small(p)) <= 3) & (value(p) <= 255))


def _mod97(hit: Column) -> Column:
    def check(s: Column) -> Column:
        turned = F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4)))

        def step(rest: Column, c: Column) -> Column:
            place = F.instr(F.lit(LETTERS), c)
            return F.when(place > 0, (rest * 100 + place + 9) % 97).otherwise((rest * 10 + F.ascii(c) - 48) % 97)

        rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)
        return F.length(s).between(15, 34) & (rest == 1)

    return bind(F.replace(hit, F.lit(" "), F.lit("")), check)


def proposals(text: Column, pattern: str) -> Column:
    """Structs (start, end, hit) of all matches; offsets in code points, end exclusive."""

    def place(m: Column) -> Column:
        steps = F.transform(m["hits"], lambda h, i: (F.length(F.get(m["gaps"], i)) + F.length(h)).cast("long"))
        return bind(
            prefix_sums(steps),
            lambda ends: F.transform(
                m["hits"],
                lambda h, i: F.struct(
                    (F.get(ends, i) - F.length(h)).alias("start"), F.get(ends, i).alias("end"), h.alias("hit")
                ),
            ),
        )

    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return bind(F.struct(gaps.alias("gaps"), hits.alias("hits")), place)


def _tagged(spans: Column, kind: str, score) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"),
            F.lit(kind).alias("kind"), score(s).cast("int").alias("score"),
        ),
    )


def _score(text: Column, kind: str):
    """The score of a span of ``kind`` by the characters before it."""

    def score(s: Column) -> Column:
        before = F.substr(text, F.greatest(s["start"] - CONTEXT, F.lit(0)).cast("int") + 1, F.least(s["start"], F.lit(CONTEXT)).cast("int"))
        found = lambda words, by: F.when(before.rlike(words), by).otherwise(0)
        return F.least(F.greatest(F.lit(SCORES[kind]) + found(RAISING[kind], GAIN) - found(LOWERING, LOSS), F.lit(0)), F.lit(100))

    return score


def _base(text: Column) -> Column:
    confirmed = {
        "email": (F.contains(text, F.lit("@")), lambda h: F.lit(True)),
        "ip": (F.contains(text, F.lit(".")) & text.rlike("[0-9]"), _octets),
        "card": (text.rlike("[0-9]"), _luhn),
        "phone": (F.contains(text, F.lit("+")), lambda h: F.length(_digits(h)).between(10, 15)),
    }

    def part(kind: str) -> Column:
        may, holds = confirmed[kind]
        hits = F.filter(proposals(text, PATTERNS[kind]), lambda s: holds(s["hit"]))
        return F.when(may, _tagged(hits, kind, _score(text, kind))).otherwise(F.array().cast(SPANS))

    return F.array_sort(F.concat(*[part(k) for k in confirmed]))


def _added(text: Column, base: Column) -> Column:
    mixed = lambda h: h.rlike("[0-9]") & h.rlike("[A-Za-z]")
    holds = {"iban": _mod97, "secret": mixed}
    free = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    passes = lambda s: (s["score"] >= MIN_SCORE) & free(s)

    def part(kind: str) -> Column:
        hits = proposals(text, PATTERNS[kind])
        if kind in holds:
            hits = F.filter(hits, lambda s: holds[kind](s["hit"]))
        return F.filter(_tagged(hits, kind, _score(text, kind)), passes)

    may = text.rlike("[0-9]{2}|PRIVATE KEY|[A-Za-z0-9_/+-]{20}|(?i)(?:password|passwd|pwd|passwort|contrase\\x{F1}a)[\\x20]*[:=]")
    return F.when(may, F.concat(*[part(k) for k in KINDS[4:]])).otherwise(F.array().cast(SPANS))


def find_pii(docs: DataFrame) -> DataFrame:
    """All of ``docs`` in ``doc``, with ``base_spans`` and ``spans`` (start, rank, end, kind, score)."""
    d = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    d = d.withColumn("base_spans", _base(F.col("t")))
    d = d.withColumn("spans", F.array_sort(F.concat("base_spans", _added(F.col("t"), F.col("base_spans")))))
    return d.select("doc", "base_spans", "spans")


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scores(spans: Column) -> Column:
    """The spans' scores in percent, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: s["score"].cast("string")), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span's text replaced by its kind in brackets; overlaps merge into the first."""

    def cut(row: Column) -> Column:
        keep = F.aggregate(
            row["spans"],
            F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
            lambda a, s: F.when(s["start"] < a["at"], a).otherwise(
                F.struct(
                    F.concat(a["out"], F.substr(row["t"], (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]")).alias("out"),
                    s["end"].alias("at"),
                )
            ),
        )
        return bind(keep, lambda k: F.concat(k["out"], F.substr(row["t"], (k["at"] + 1).cast("int"), F.length(row["t"]))))

    found = find_pii(docs)
    text = F.when(F.size("spans") > 0, bind(F.struct(F.col("doc.text").alias("t"), "spans"), cut)).otherwise(F.col("doc.text"))
    return found.select(*[text.alias(c) if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])
