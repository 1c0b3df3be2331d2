"""Word shingle sets as sorted 64-bit hashes, for many texts at once in numpy.

Words are runs outside the six ASCII blanks after lower-casing A-Z.  A word's hash is a
polynomial over table-mixed bytes, a shingle's a mix of its words' hashes in order; both
are 64 bits wide, so within a set, and between the sets of one candidate pair, two
different shingles share a hash with a probability of about 1e-13 for a thousand words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_lower = np.arange(256)
_lower[65:91] += 32
#: A number for each byte, and the same with A-Z as a-z.
EXACT = mix(np.arange(256).astype(np.uint64) * _ODD + np.uint64(1))
FOLDED = EXACT[_lower]
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


#: Bytes hashed at once; a longer text is cut at blanks.
CHUNK = 1 << 18
BLANK_RUN = re.compile(rb"[\x20\x09-\x0D]")


@lru_cache(8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, times nothing else."""
    out = []
    for base in (_STEP, _BACK):
        x = np.full(n, base, np.uint64)
        x[:1] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


def span_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span of ``data`` (uint8), as ``table`` numbers them."""
    step, back = _powers(max(2 * CHUNK, 1 << max(len(data) - 1, 0).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * step[: len(data)], dtype=np.uint64, out=sums[1:])
    return mix((sums[stop] - sums[start]) * back[start] + (stop - start).astype(np.uint64) * _ODD)


def chunks(blobs: Iterable[bytes], cut: re.Pattern = BLANK_RUN, size: int = CHUNK) -> Iterator[list[tuple[int, int, bytes]]]:
    """(blob number, 1 where it ends, bytes) in lists of about ``size`` bytes; a longer blob is
    cut before a match of ``cut`` and goes on in the next list."""
    held, n = [], 0
    for i, blob in enumerate(blobs):
        at = 0
        while len(blob) - at > size and (m := cut.search(blob, at + size)):
            yield [*held, (i, 0, blob[at : m.start()])]
            held, n, at = [], 0, m.start()
        held.append((i, 1, blob[at:] if at else blob))
        n += len(blob) - at
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def word_hashes(texts: list[bytes | str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text the index after its last word."""
    found, ends, before = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64), 0
    for held in chunks(t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in texts):
        data = np.frombuffer(b" ".join([x[2] for x in held]) + b" ", np.uint8)
        blank = _BLANK[data]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if not blank[0]:
            edge = np.concatenate([[0], edge])
        start, stop = edge[0::2], edge[1::2]
        found.append(span_hashes(data, start, stop, FOLDED))
        last = np.searchsorted(start, np.cumsum([len(x[2]) + 1 for x in held]))
        for (i, over, _), n in zip(held, last.tolist(), strict=True):
            if over:
                ends[i] = before + n
        before += len(start)
    return np.concatenate(found), ends


def shingle_sets(texts: list[bytes | str], width: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingle hashes, ascending.  A text of fewer than ``width``
    words has one shingle of all its words; a text without words has none."""
    words, ends = word_hashes(texts)
    whole = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        whole = mix(whole * _ODD + words[k : len(words) - width + 1 + k]) if len(whole) else whole
    begin = 0
    for end in ends.tolist():
        n = end - begin
        if n >= width:
            yield np.unique(whole[begin : end - width + 1])
        elif n:
            few = np.zeros(1, np.uint64)
            for w in words[begin:end]:
                few = mix(few * _ODD + w)
            yield mix(few + np.uint64(n))
        else:
            yield np.zeros(0, np.uint64)
        begin = end


def set_id(shingles: np.ndarray) -> int:
    """A signed 64-bit fingerprint of a set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)
