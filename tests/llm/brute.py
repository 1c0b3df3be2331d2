"""Plain Python versions of the corpus operators."""

from __future__ import annotations

import re
from collections import defaultdict

BLANK = "\x20\x09-\x0d"
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(f"[^{BLANK}]+", text or "")


def luhn(digits):
    odd, even = digits[::-1][0::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(d)))) for d in even)) % 10 == 0


def pii(text):
    """Base spans (start, kind number, end)."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def shingles(text, k):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def roots(ids, links):
    """Smallest id reachable for each node."""
    low = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            m = min(low[a], low[b])
            moved |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def similar(texts, k, percent):
    """Component of each (key, text) by all pairs."""
    sets = {i: shingles(t, k) for i, t in texts}
    keys = list(sets)
    links = [
        (a, b) for n, a in enumerate(keys) for b in keys[n + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return sets, roots(keys, links)


def quality(text):
    text = text or ""
    w, lines = words(text), [x for x in text.split("\n") if words(x)]
    places = defaultdict(list)
    for i in range(len(w) - 4):
        places[tuple(w[i : i + 5])].append(i)
    covered = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def targets(sizes, weights=(5, 2, 1), most=3):
    """Water filling by repeated sharing; ``sizes`` by source, None last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed: dict = {}
    while True:
        left = sum(sizes.values()) - sum(fixed.values())
        free = [s for s in order if s not in fixed]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in above}
