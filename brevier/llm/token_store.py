"""Token ids in files: Simple-8b words in blocks, in ascending doc_id order.

A store is a Parquet table (so that Spark's commit protocol covers lost tasks) with one row
per run of whole documents:

* ``part``, ``first`` - range partition, and ids before this row within it
* ``doc_ids``, ``lengths`` - the documents and their numbers of ids, end id included
* ``words`` - little-endian 64-bit words: a 4-bit selector over 60 payload bits, lowest id
  first; a word never crosses a block of ``BLOCK`` ids, so blocks decode independently
* ``block_words``, ``block_escapes`` - where each block begins in ``words`` and ``escapes``
* ``escapes`` - 32-bit ids of ``ESCAPE`` or more, which the words hold as ``ESCAPE``

Selectors pack 240 or 120 zeros, or 60 .. 1 ids of 1 .. 60 bits.  Packing runs over all
blocks of a row in step, decoding over all words that share a selector, both in numpy.

Defined cases: a null text is empty (its only id is the end id); a null doc_id sorts first;
rows that repeat a doc_id follow each other by text; a text of any length is one document
in one row; no rows give an empty store; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

#: Selector table of the format, by selector number: (bits of an id, ids in a word).
SELECTORS = (
    (0, 240), (0, 120), (1, 60), (2, 30), (3, 20), (4, 15), (5, 12), (6, 10),
    (7, 8), (8, 7), (10, 6), (12, 5), (15, 4), (20, 3), (30, 2), (60, 1),
)
BLOCK, ESCAPE = 4096, (1 << 15) - 1
PAD = 256  # room after a block for the longest word
_WIDTHS = np.ceil(np.log2(np.arange(ESCAPE + 1) + 1)).astype(np.uint8)  # bits of a code
ROW_IDS, STEP_BYTES = 1 << 20, 1 << 20
STORE = (
    "part int, first long, doc_ids array<bigint>, lengths array<bigint>, words binary,"
    " block_words array<int>, block_escapes array<int>, escapes binary"
)


def pack(ids: np.ndarray) -> tuple[bytes, list[int], list[int], bytes]:
    """words, block_words, block_escapes, escapes of one row."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    escaped = ids >= ESCAPE
    codes = np.zeros((blocks, BLOCK + PAD), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = np.where(escaped, ESCAPE, ids)
    codes[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    bits = _WIDTHS[codes.astype(np.int64)]

    widest = {1: bits}  # of the next 1, 2, 4, .. ids
    choice = np.full(bits.shape, len(SELECTORS) - 1, np.uint8)
    for s in range(len(SELECTORS) - 2, -1, -1):
        width, count = SELECTORS[s]
        k = 1 << (count.bit_length() - 1)
        if k not in widest:
            half = widest[k // 2]
            widest[k] = half.copy()
            np.maximum(half[:, : -(k // 2)], half[:, k // 2 :], out=widest[k][:, : -(k // 2)])
        fits = widest[k] <= width
        if not fits.any():
            continue
        if count > k:
            fits[:, : k - count] &= widest[k][:, count - k :] <= width
        choice[fits] = s

    counts = np.array([c for _, c in SELECTORS])
    lengths = np.full(blocks, BLOCK)
    lengths[-1:] = n - BLOCK * (blocks - 1)
    at, every, steps = np.zeros(blocks, np.int64), np.arange(blocks), []
    while (live := at < lengths).any():
        steps.append(np.where(live, at, -1))
        at = np.where(live, at + counts[choice[every, at]], at)
    if not steps:
        return b"", [], [], b""
    place = np.stack(steps, axis=1)
    row, step = np.nonzero(place >= 0)
    place = place[row, step]
    chosen = choice[row, place]
    words = chosen.astype(np.uint64) << np.uint64(60)
    start = row * (BLOCK + PAD) + place
    codes = codes.reshape(-1)
    for s, (width, count) in enumerate(SELECTORS):
        mine = np.flatnonzero(chosen == s)
        if width and len(mine):
            for j in range(count):
                words[mine] |= codes[start[mine] + j] << np.uint64(width * j)
    block_words = np.searchsorted(row, np.arange(blocks))
    block_escapes = np.concatenate([[0], np.cumsum(escaped)])[np.minimum(np.arange(blocks) * BLOCK, n)]
    return words.astype("<u8").tobytes(), block_words.tolist(), block_escapes.tolist(), ids[escaped].astype("<u4").tobytes()


def unpack(words: bytes, block_words: list[int], escapes: bytes, n: int) -> np.ndarray:
    """The ids of one row."""
    w = np.frombuffer(words, "<u8")
    if not len(w):
        return np.zeros(0, np.uint32)
    blocks = len(block_words)
    selector = (w >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for _, c in SELECTORS])[selector]
    ends = np.cumsum(counts)
    begin = ends - counts
    firsts = np.asarray(block_words)
    block = np.searchsorted(firsts, np.arange(len(w)), side="right") - 1
    start = begin - begin[firsts][block] + block * (BLOCK + PAD)
    out = np.zeros(blocks * (BLOCK + PAD), np.uint32)
    for s, (width, count) in enumerate(SELECTORS):
        mine = np.flatnonzero(selector == s)
        if width and len(mine):
            mask = np.uint64((1 << width) - 1)
            for j in range(count):
                out[start[mine] + j] = (w[mine] >> np.uint64(width * j)) & mask
    ids = out.reshape(blocks, BLOCK + PAD)[:, :BLOCK].reshape(-1)[:n].copy()
    ids[ids == ESCAPE] = np.frombuffer(escapes, "<u4")
    return ids


def text_steps(batches: Iterator[pa.RecordBatch], limit: int = STEP_BYTES):
    """(doc_ids, texts as bytes) of about ``limit`` bytes of text at a time, whatever the batches hold."""
    for batch in batches:
        column = batch.column("text").cast(pa.binary())
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), np.int64)
        step = np.cumsum(sizes + 64) // limit
        for k in np.unique(step):
            lo, hi = np.searchsorted(step, [k, k + 1])
            yield (
                batch.column("doc_id").slice(lo, hi - lo).to_pylist(),
                [t or b"" for t in column.slice(lo, hi - lo).to_pylist()],
            )


def write_store(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Encode ``docs`` and return the written store as read back."""

    def encode(batches):
        from .tokens import encoder

        lib, part, first = encoder(tokenizer, False), TaskContext.get().partitionId(), 0
        held: list[tuple[int, np.ndarray]] = []
        n = 0

        def row():
            nonlocal first, held, n
            ids = np.concatenate([x for _, x in held])
            words, block_words, block_escapes, escapes = pack(ids)
            out = {
                "part": part, "first": first, "doc_ids": [d for d, _ in held], "lengths": [len(x) for _, x in held],
                "words": words, "block_words": block_words, "block_escapes": block_escapes, "escapes": escapes,
            }
            first, held, n = first + len(ids), [], 0
            return pa.RecordBatch.from_pylist([out], schema=_arrow(STORE))

        for doc_ids, texts in text_steps(batches):
            for d, ids in zip(doc_ids, lib.encode(texts), strict=True):
                held.append((d, np.append(ids, np.uint32(end_id))))
                n += len(ids) + 1
                if n >= ROW_IDS:
                    yield row()
        if held:
            yield row()

    sorted_docs = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return scratch.save(sorted_docs.mapInArrow(encode, STORE), "token-store", compression="zstd")


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64()}
    fields = []
    for part in ddl.split(","):
        name, kind = part.split()
        inner = kind.removeprefix("array<").removesuffix(">")
        fields.append(pa.field(name, pa.list_(kinds[inner]) if kind.startswith("array") else kinds[kind]))
    return pa.schema(fields)


SPANS = "part int, doc_id bigint, within long, n_tokens long, ids_crc32 long"


def read_spans(store: DataFrame) -> DataFrame:
    """Decode every row of a store: doc_id, start, n_tokens, ids_crc32 per document."""

    def decode(batches):
        for batch in batches:
            for r in batch.to_pylist():
                lengths = np.asarray(r["lengths"], np.int64)
                ids = unpack(r["words"], r["block_words"], r["escapes"], int(lengths.sum())).astype("<u4")
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[e - k : e]) for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = [
                    pa.array([r["part"]] * len(crcs), pa.int32()), pa.array(r["doc_ids"], pa.int64()),
                    pa.array(r["first"] + ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=_arrow(SPANS))

    sizes = store.select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))  # one row per file: small by nature
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    spans = store.mapInArrow(decode, SPANS).join(parts, "part")
    return spans.select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
