"""License notices, exact and with small errors.

Texts are reduced to their words (ASCII letters and digits, and everything beyond ASCII)
joined by single spaces.  Each notice may be found with up to one edit for every
``CHARS_PER_EDIT`` characters: cut into one more seed than edits, an occurrence keeps at
least one seed whole, so an automaton over all seeds locates every candidate; the regex
library's bounded-error matching then verifies the window around it and reports span and
edits.  The words that tell a notice from its rivals must stand there without edits.  Of
matches that overlap the one with the fewest edits counts, and the stretches before and
after it are searched again.  Base phrases are found exactly and always count.

Defined cases: a null text is empty; very long texts are searched whole; places of a
phrase may overlap; among equal matches of a notice the first counts; repeated rows are
scanned each; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .token_store import text_steps

#: Base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Notices of the method, their labels, and the words that tell them from their rivals.
RULES = (
    ("licensed under the apache license version 2 0", "apache-2", "2"),
    ("released under the mit license", "mit", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", ""),
    ("under the gnu general public license", "gpl", ""),
    ("gnu lesser general public license", "lgpl", ""),
    ("mozilla public license version 2 0", "mpl-2", "2"),
    ("mozilla public license version 1 1", "mpl-1-1", "1 1"),
    ("redistribution and use in source and binary forms", "bsd", ""),
    ("licensed under cc by 4 0", "cc-by", "by"),
    ("licensed under cc by nc 4 0", "cc-by-nc", "nc"),
    ("licensed under cc by nd 4 0", "cc-by-nd", "nd"),
    ("licensed under cc by sa 4 0", "cc-by-sa", "sa"),
    ("licensed under cc by nc nd 4 0", "cc-by-nc-nd", "nc nd"),
    ("licensed under cc by nc sa 4 0", "cc-by-nc-sa", "nc sa"),
    ("creative commons attribution noncommercial", "cc-by-nc", ""),
    ("creative commons attribution share alike", "cc-by-sa", ""),
)
NOTICES = tuple((phrase, label) for phrase, label, _ in RULES)
CHARS_PER_EDIT = 12
_WORD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
FOUND = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long,"
    " base_labels string, labels string, score double, spans string"
)


def seeds(phrase: str) -> list[tuple[str, int]]:
    """(seed, place) pairs: one more than the edits allowed, of nearly equal length."""
    cuts = np.linspace(0, len(phrase), len(phrase) // CHARS_PER_EDIT + 2).astype(int).tolist()
    return [(phrase[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _pattern(phrase: str, words: str) -> str:
    """Regex of a notice; ``words`` must follow its start as far as in the notice, give or take the edits."""
    edits = len(phrase) // CHARS_PER_EDIT
    at = f" {phrase} ".find(f" {words} ") - 1 if words else 0
    exact = rf"(?=.{{{max(at - edits, 0)},{at + edits}}} {words} )" if words else ""
    return rf"(?b)(?<= ){exact}(?:{phrase}){{e<={edits}}}(?= )"


@lru_cache(1)
def _machine():
    """The automaton over all seeds and, for each notice, its bounded-error pattern."""
    import ahocorasick
    import regex

    owners: dict[str, list[tuple[int, int]]] = {}
    for k, (phrase, _) in enumerate(NOTICES):
        for seed, place in seeds(phrase):
            owners.setdefault(seed, []).append((k, place))
    automaton = ahocorasick.Automaton()
    for seed, who in owners.items():
        automaton.add_word(seed, (len(seed), who))
    automaton.make_automaton()
    patterns = [regex.compile(_pattern(phrase, words), regex.DOTALL) for phrase, _, words in RULES]
    return automaton, patterns


def words_line(text: bytes | str) -> tuple[str, int]:
    """The text's words between single spaces, one character per byte, and their number."""
    blob = text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")
    words = blob.translate(_WORD).split(b" ")
    words = [w for w in words if w]
    return " " + b" ".join(words).decode("latin-1") + " " if words else "", len(words)


def near_notices(line: str) -> list[tuple[int, int, int, int]]:
    """(notice, start, end, edits) of the bounded-error matches in a words line."""
    automaton, patterns = _machine()
    windows: dict[int, list[list[int]]] = {}
    for end, (size, owners) in automaton.iter(line):
        for k, place in owners:
            phrase = NOTICES[k][0]
            edits = len(phrase) // CHARS_PER_EDIT
            start = end + 1 - size - place
            lo, hi = max(0, start - 2 * edits - 1), start + len(phrase) + 2 * edits + 1
            mine = windows.setdefault(k, [])
            if mine and lo <= mine[-1][1]:
                mine[-1] = [min(lo, mine[-1][0]), max(hi, mine[-1][1])]
            else:
                mine.append([lo, hi])
    found = []
    for k, spans in windows.items():
        least = len(NOTICES[k][0]) - len(NOTICES[k][0]) // CHARS_PER_EDIT
        while spans:
            lo, hi = spans.pop()
            m = patterns[k].search(line, lo, hi) if hi - lo >= least else None
            if m:
                found.append((k, m.start(), m.end(), sum(m.fuzzy_counts)))
                spans += (lo, m.start()), (m.end(), hi)
    return found


def scan(text: bytes | str) -> tuple:
    """The columns of ``FOUND`` after doc_id for one text."""
    line, n = words_line(text)
    spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    before = lambda ats: np.searchsorted(spaces, ats).tolist()  # spaces before each place
    found, base = [], set()
    for phrase, label in BASE:
        at = line.find(f" {phrase} ")
        while at >= 0:
            found.append(at)
            base.add(label)
            at = line.find(f" {phrase} ", at + 1)
    places = before(found)
    near = near_notices(line)
    labels = base | {NOTICES[k][1] for k, *_ in near}
    score = max([1.0] * bool(places) + [1 - e / len(NOTICES[k][0]) for k, _, _, e in near], default=0.0)
    firsts, lasts = before([x[1] for x in near]), before([x[2] for x in near])
    spans = sorted((a - 1, b - 1, NOTICES[k][1], e) for (k, _, _, e), a, b in zip(near, firsts, lasts, strict=True))
    return (
        n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
        ",".join(sorted(labels)), score, ",".join(f"{label}:{a}:{b}:{e}" for a, b, label, e in spans),
    )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``; spans are label:first word:last word:edits."""

    def run(batches):
        schema = pa.schema(
            [(c, pa.float64() if c == "score" else pa.string() if c in ("base_labels", "labels", "spans") else pa.int64())
             for c in (x.split()[0] for x in FOUND.split(", "))]
        )
        for ids, texts in text_steps(batches):
            rows = [(d, *scan(t)) for d, t in zip(ids, texts, strict=True)]
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, FOUND)
