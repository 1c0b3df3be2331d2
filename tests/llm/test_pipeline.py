"""The pipeline, stage by stage, against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow.parquet as pq
from brevier.llm import queries, scratch
from brevier.llm.tokens import encoder

from . import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
KIND = "doc_id long, text string, lang string, source string, n_chars long"
BOILERPLATE = "click here|read more|sign up|log in|subscribe now|weiterlesen|lire la suite|leer m\u00e1s"
SENTENCE_END = r"[.!?:;\u2026\u3002\uff01\uff1f\"\u201d\u00bb)]\s*$"


def planted(first):
    rng = random.Random(8)
    vocab = [f"v{rng.randrange(10**6)}" for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    texts = [f"{prose(20)}.\nThe same line ends each of these texts by writer{chr(97 + i)} today.\n{prose(15)}" for i in range(14)]
    texts += [f"{prose(30)}.\nhome | about | news | shop\n{prose(30)}", prose(5), f"{'again and again ' * 9}", prose(9000)]
    base = prose(120).split()
    texts += [" ".join([*base[:i], "changed", *base[i + 1 :]]) for i in (3, 50, 100)] + [" ".join(base)]
    return [(first + i, t, "en", f"p{i % 3}", len(t)) for i, t in enumerate(texts)]


def with_text(row, text):
    return (*row[:1], text, *row[2:4], len(text))


def quality(rows):
    def fails(line):
        w = brute.words(line)
        n, bars = len(w), line.count("|")
        return (
            len(re.findall(r"[#*$%&|<>]", line)) > 0.1 * len("".join(w))
            or len(re.findall("!{2,}", line)) > 0.3 * n
            or (bars >= 2 and bars > 0.2 * n)
            or (n >= 10 and len(set(w)) < 0.3 * n)
            or (n <= 12 and re.search(BOILERPLATE, line.lower()) is not None)
            or (n <= 8 and re.search(SENTENCE_END, line) is None)
        )

    for row in rows:
        n, chars, _, _, repeated = brute.quality(row[1])
        clean = "\n".join(x for x in row[1].split("\n") if brute.words(x) and not fails(x))
        left = len("".join(brute.words(clean)))
        if n >= 10 and 100 * repeated <= 20 * n and left >= (1 - 0.3) * chars:
            yield with_text(row, clean if left < chars else row[1])


def line_dedup(rows):
    mask = lambda w: "<*>" if re.search("[0-9@]|://", w) else w
    lines, texts = [], {r[0]: r[1] for r in rows}
    for d, text in texts.items():
        lines += [(d, i, line.strip(" \t\x0b\x0c\r"), brute.words(line)) for i, line in enumerate(text.split("\n")) if brute.words(line)]

    def different(found):
        return len({texts[d] for d, *_ in found})

    def ways(w):
        a, b, c = map(mask, w[:3])
        return [(len(w), a, b, c), (len(w), a, b, None), (len(w), a, None, c), (len(w), None, b, c)]

    reached = defaultdict(list)
    for line in lines:
        if len(line[3]) >= 4:
            for way in ways(line[3]):
                reached[way].append(line)
    hot = {way for way, found in reached.items() if different(found) >= 10}
    leaf = {line[:2]: next((way for way in ways(line[3]) if way in hot), None) for line in lines if len(line[3]) >= 4}
    counts = Counter((leaf.get(line[:2]), k, mask(t)) for line in lines for k, t in enumerate(line[3]) if mask(t) != "<*>")
    keys = defaultdict(list)
    for d, i, line, w in lines:
        keys[line, 2 if len(w) >= 50 else 10].append((d, i))
        at = leaf.get((d, i))
        if at:
            fixed = [(k, t) for k, t in enumerate(map(mask, w)) if t != "<*>" and counts[at, k, t] >= 10]
            if len(fixed) >= 0.6 * len(w) and sum(k >= 3 for k, _ in fixed) >= 0.6 * (len(w) - 3):
                keys[(at, *fixed), 10].append((d, i))
    gone = set()
    for (_, need), found in keys.items():
        if different(found) >= need:
            first = min(d for d, _ in found)
            gone |= {x for x in found if x[0] != first}
    for row in rows:
        left = "\n".join(x for i, x in enumerate(row[1].split("\n")) if (row[0], i) not in gone)
        if left == row[1] or brute.words(left):
            yield with_text(row, left)


def one_of_each(rows):
    _, low = brute.similar([(r[0], r[1]) for r in rows], 5, 80)
    return [r for r in rows if low[r[0]] == r[0]]


def mixing(rows):
    size, sources = {r[0]: len(brute.words(r[1])) for r in rows}, defaultdict(list)
    for r in rows:
        sources[r[3]].append(r)
    totals = {s: sum(size[r[0]] for r in own) for s, own in sources.items()}
    for s, target in brute.targets(totals).items():
        epochs, before = int(target // totals[s]), 0
        due = math.floor(target - epochs * totals[s])
        for r in sorted(sources[s], key=lambda r: hashlib.md5(f"mix-1:{r[0]}".encode()).hexdigest()):
            part = max(min(due - before, size[r[0]]), 0)
            before += size[r[0]]
            yield from [r] * epochs
            if part == size[r[0]]:
                yield r
            elif part:
                ends = [m.end() for m in re.finditer(f"[^{brute.BLANK}]+", r[1])]
                yield with_text(r, r[1][: ends[part - 1]])


def pieces(rows):
    lib = encoder(queries.vocabulary("word_bpe_49k.json"), True).lib
    for r in rows:
        ids = np.array([*lib.encode(r[1], add_special_tokens=False).ids, 1], "<u4")
        for i, at in enumerate(range(0, len(ids), 4096)):
            one = ids[at : at + 4096]
            yield r[0], i, at, len(one), zlib.crc32(one.tobytes())


def test_pipeline_against_brute_force(spark, tmp_path, monkeypatch):
    known = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=COLUMNS).to_pylist()
    rows = [tuple(r[c] for c in COLUMNS) for r in known]
    rows += planted(1 + max(r[0] for r in rows))
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")

    seen = {}

    def recorded(name, stage):
        def run(spark, docs, sf_dir):
            out = scratch.save(stage(spark, docs, sf_dir), "recorded")
            seen[name] = out.collect()
            return out

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [recorded(*s) for s in corpus_pipeline.STAGES])
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()

    versions = [quality, line_dedup, one_of_each, mixing]
    assert len(seen) == len(versions) + 1
    for (name, got), version in zip(seen.items(), versions, strict=False):
        before, rows = rows, list(version(rows))
        assert Counter(rows) == Counter(tuple(r[c] for c in COLUMNS) for r in got), name
        assert rows != before, name  # the stage had something to do

    got = seen["best-fit packing"]
    kept = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert Counter(tuple(r[c] for c in kept) for r in got) == Counter(pieces(rows))
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096 and sorted(ends) == list(range(len(ends)))
    assert Counter(last) == Counter(got)


def test_stages_on_odd_tables(spark):
    """Nulls in any column, repeated rows, an empty table and clashing extra columns go through the chain."""
    more = KIND + ", h string, lines string, n long, size long, words string, copies long, quality string, line_key string"
    text = "A clean line of plain words that ends as it should, with nothing odd in it."
    rows = [(1, text, "en", "s", 9), (1, text, "en", "s", 9), (None, text + " More of it.", None, None, None), (2, None, "en", "s", 0), (3, "", "en", None, 0)]
    rows = [(*r, "x", "y", 1, 2, "z", 3, "q", "k") for r in rows]
    for table in (rows, []):
        docs = spark.createDataFrame(table, more)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = scratch.save(stage(spark, docs, ""), "odd")
            assert docs.columns == [c.split()[0] for c in more.split(", ")], name
        last = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
        assert len(last) == docs.count() == 0 if not table else len(last) > 0
