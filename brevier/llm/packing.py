"""Best-fit packing by length patterns.

Lengths are whole numbers up to the capacity, so pieces of one length are interchangeable
and the problem is a histogram of at most ``capacity`` counts.  Patterns of up to
``DOCS_PER_PATTERN`` lengths (in classes of ``CLASS`` tokens) that fill a sequence are
enumerated, their repeat counts fitted to the histogram by non-negative least squares and
rounded down; the last place of a pattern takes the longest length that the room left by
the others holds.  The pieces that remain, short ones above all, go into the room left by
best fit, longest first.  Where best fit alone needs fewer sequences, its plan is used.  The driver only sees the histogram and the patterns; both are bounded
by the capacity.  Pieces find their places by rank within their length: a local rank from
the writing task plus the counts of earlier tasks, so no task sees all pieces of a length.

Defined cases: a null text is empty and one piece of one id; a text longer than the
capacity is cut into full pieces and a rest; a null doc_id stays null; repeated rows are
packed each; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .token_store import _arrow, text_steps

CAPACITY, CLASS, DOCS_PER_PATTERN, SHORT = 4096, 128, 4, 512
PIECES = "part int, local long, doc_id bigint, piece int, start long, length long, ids_crc32 long"
PLACED = "doc_id bigint, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """min |a x - b| over x >= 0 by an active set."""
    x, on = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[on] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        on[best] = True
        while True:
            z = np.zeros_like(x)
            z[on] = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if (z[on] > 0).all():
                x = z
                break
            low = on & (z <= 0)
            step = (x[low] / np.maximum(x[low] - z[low], 1e-300)).min()
            x = x + step * (z - x)
            on &= x > 1e-12
            x[~on] = 0
            if not on.any():
                break
    return x


def patterns(total: int, parts: int, least: int) -> list[tuple[int, ...]]:
    """Descending tuples of up to ``parts`` classes of at least ``least`` with sum ``total``."""

    def go(left: int, parts: int, most: int):
        if left == 0:
            yield ()
        elif parts:
            for c in range(min(left, most), least - 1, -1):
                for rest in go(left - c, parts - 1, c):
                    yield (c, *rest)

    return list(go(total, parts, total))


class Plan:
    """Groups of equal sequences: (repeats, free room, [(length, times)])."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: list[list[list]] = [[] for _ in range(capacity + 1)]

    def add(self, repeats: int, content: list[tuple[int, int]]) -> None:
        room = self.capacity - sum(k * m for k, m in content)
        self.by_room[room].append([repeats, content])

    def best_fit(self, left: dict[int, int]) -> None:
        """Place ``left`` (length: count), longest first, each into the least room that holds it."""
        for length in sorted(left, reverse=True):
            n = left[length]
            room = length
            while n:
                while room <= self.capacity and not self.by_room[room]:
                    room += 1
                if room > self.capacity:
                    fits = self.capacity // length
                    if n >= fits:
                        self.add(n // fits, [(length, fits)])
                    if n % fits:
                        self.add(1, [(length, n % fits)])
                    break
                repeats, content = self.by_room[room].pop()
                times = max(1, min(room // length, n // repeats))
                if repeats * times > n:  # only some of these sequences get one
                    self.add(repeats - n, content)
                    repeats, times = n, 1
                self.add(repeats, [*content, (length, times)])
                n -= repeats * times

    def groups(self) -> list[list]:
        return [g for groups in self.by_room for g in groups]

    def sequences(self) -> int:
        return sum(r for r, _ in self.groups())


def _repeats(ways: list[tuple[int, ...]], wanted: np.ndarray) -> np.ndarray:
    """How often each pattern is used, so that no class is used up."""
    a = np.zeros((len(wanted), len(ways)))
    for j, way in enumerate(ways):
        for c in way:
            a[c, j] += 1
    return np.floor(nnls(a, wanted) + 1e-6).astype(np.int64)


def _longest(left: dict[int, int], used: dict[int, int], stock: list[list[int]], top: int, low: int, room: int) -> int | None:
    """The longest length at hand of at most ``room``, looked for in the classes from ``top`` down to ``low``."""
    for c in range(top, low - 1, -1):
        own = stock[c]
        while own and not left[own[0]]:
            own.pop(0)
        for k in own:
            if k <= room and left[k] > used.get(k, 0):
                return k
    return None


def fit(counts: dict[int, int], capacity: int = CAPACITY, width: int = CLASS) -> Plan:
    """Pack a histogram: fitted patterns first, then best fit for the rest; or best fit alone where that is better."""
    alone = Plan(capacity)
    alone.best_fit(dict(counts))
    plan, left = Plan(capacity), dict(counts)
    if left.get(capacity):
        plan.add(left.pop(capacity), [(capacity, 1)])
    classes = capacity // width
    least = SHORT // width + 1
    ways = [p for total in range(classes, classes - 2, -1) for p in patterns(total, DOCS_PER_PATTERN, least)]
    if classes < 2 or not ways:
        return alone
    stock: list[list[int]] = [[] for _ in range(classes + 1)]
    wanted = np.zeros(classes + 1)
    for k, n in left.items():
        c = -(-k // width)
        if c >= least:
            stock[c].append(k)
            wanted[c] += n
    for own in stock:
        own.sort(reverse=True)
    repeats = _repeats(ways, wanted)
    for j in np.argsort(-repeats, kind="stable"):
        way, due = ways[j], int(repeats[j])
        while due > 0:
            used: dict[int, int] = {}
            room = capacity
            for i, c in enumerate(way):
                top = min(room // width + 1, classes) if i == len(way) - 1 else c
                k = _longest(left, used, stock, top, c if i < len(way) - 1 else least, room)
                if k is None:
                    break
                used[k] = used.get(k, 0) + 1
                room -= k
            if sum(used.values()) < len(way):
                break
            take = min(due, *(left[k] // m for k, m in used.items()))
            for k, m in used.items():
                left[k] -= take * m
            plan.add(take, list(used.items()))
            due -= take
    plan.best_fit({k: n for k, n in left.items() if n})
    return plan if plan.sequences() <= alone.sequences() else alone


def slots(plan: Plan) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset, times) sorted by length and rank."""
    rows, seen, sequence = [], {}, 0
    for repeats, content in plan.groups():
        at = 0
        for length, times in content:
            rows.append((length, seen.get(length, 0), sequence, at, times))
            seen[length] = seen.get(length, 0) + repeats * times
            at += length * times
        sequence += repeats
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Encode ``docs``; a written row per piece with its rank among the task's equal lengths."""

    def pieces(batches):
        from .tokens import encoder

        lib, part, seen = encoder(tokenizer, True), TaskContext.get().partitionId(), {}
        schema = _arrow(PIECES)
        for doc_ids, texts in text_steps(batches):
            rows = []
            for d, ids in zip(doc_ids, lib.encode(texts), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for i, at in enumerate(range(0, len(ids), capacity)):
                    one = ids[at : at + capacity]
                    local = seen.get(len(one), 0)
                    seen[len(one)] = local + 1
                    rows.append((part, local, d, i, at, len(one), zlib.crc32(one)))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return scratch.save(docs.select("doc_id", "text").mapInArrow(pieces, PIECES), "pack-pieces", scratch.TEXT_BATCH)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    found = cut_pieces(docs, tokenizer, end_id, capacity)
    counts = found.groupBy("part", "length").count()
    counts = scratch.save(counts, "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    table = slots(fit(histogram, capacity))

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))

    def place(batches):
        shift = np.int64(1) << np.int64(44)
        keys = table[:, 0] * shift + table[:, 1]
        schema = _arrow(PLACED)
        for b in batches:
            length, rank = np.asarray(b.column("length")), np.asarray(b.column("rank"))
            at = np.searchsorted(keys, length * shift + rank, side="right") - 1
            nth = rank - table[at, 1]
            sequence = table[at, 2] + nth // table[at, 4]
            offset = table[at, 3] + nth % table[at, 4] * length
            kept = [b.column(f.name) for f in schema if f.name in b.schema.names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], schema=schema)

    # the table grows with the parts, so it is never sent to all tasks
    ranked = found.join(starts.hint("merge"), ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("local") + F.col("before")).alias("rank")
    )
    return ranked.mapInArrow(place, PLACED)
