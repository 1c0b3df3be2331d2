"""Whole-text token ids from a public tokenizer file, with a memo of encoded words.

Both vocabularies used here cut a text before every white-space character that no other one
follows, and between a letter and a full stop or comma that ends a word.  So a text without
two white-space characters in a row is the concatenation of such pieces, each with the white
space before it.  Pieces are hashed in numpy; unknown ones are joined to one text, which the
tokenizers library encodes in one call, and the ids are dealt to the pieces by their bytes
(byte-level vocabulary) or by a mark set between them (the other).  A text that doesn't meet
the condition is given to the library whole.  Tests hold the result against whole-text
encoding.

The memo has ``2 * SLOTS`` places of fixed size, about 70 MB a worker and file; a piece has
two places it may take, and an older piece gives way.  A place holds a piece's 64-bit hash,
its length and first seven bytes, and its ids; a piece of over ``MOST_IDS`` ids isn't kept.
"""

from __future__ import annotations

import os
import re

import numpy as np

from . import shingles

SLOTS, MOST_IDS = 1 << 19, 10
#: Set between pieces that are encoded together where the vocabulary drops white space.
MARK = "\x01"
SPACE = re.compile(rb"[ \n]")
_encoders: dict[tuple[str, bool], Encoder] = {}


def _flags(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


_WHITE, _LETTER, _END = _flags((32, 32), (10, 10)), _flags((65, 90), (97, 122)), _flags((44, 44), (46, 46))
#: Other ASCII white space and the mark; first bytes of longer white space, of I with a dot and of capital sigma.
_ODD, _FIRST = _flags((1, 1), (9, 9), (11, 13), (28, 31)), _flags((0xC2, 0xC2), (0xC4, 0xC4), (0xCE, 0xCE), (0xE1, 0xE3))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[10] = 32


def _unsafe(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes at which cutting at white space may not be what the library does."""
    white = _WHITE[data]
    bad = _ODD[data]
    bad[:-1] |= white[:-1] & white[1:] | (data[:-1] == 60) & (data[1:] == 124)
    far = np.flatnonzero(_FIRST[data])
    more = np.concatenate([data, np.zeros(2, np.uint8)])
    a, b, c = data[far], more[far + 1], more[far + 2]
    odd = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xC4) & (b == 0xB0) | (a == 0xCE) & (b == 0xA3)
    odd |= (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80) | (a == 0xE2) & (b == 0x81) & (c == 0x9F)
    odd |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    return np.concatenate([np.flatnonzero(bad), far[odd]])


def _gather(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices start[0], start[0] + 1, .. of count[0] elements, then those of the next."""
    ends = np.cumsum(count)
    return np.repeat(start - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    def __init__(self, path: str, drops_space: bool):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.lib = Tokenizer.from_file(path)
        self.drops_space = drops_space
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(1 + max(vocab.values()), np.int64)
        for token, i in vocab.items():  # byte-level tokens have a letter for each byte
            self.bytes_of[i] = len(token)
        self.mark = self._ids(MARK)
        self.single = {ord(c): self._ids(c) for c in " \n.,"}
        self.keys = np.zeros(2 * SLOTS, np.uint64)
        self.checks = np.zeros(2 * SLOTS, np.uint64)
        self.sizes = np.zeros(2 * SLOTS, np.uint8)
        self.kept = np.zeros((2 * SLOTS, MOST_IDS), np.uint32)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces (of two bytes or more), one after the other, and their numbers."""
        if not self.drops_space:
            ids = self._ids(data[_gather(start, size)].tobytes().decode())
            cuts = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(size)) + 1
            return ids, np.diff(cuts, prepend=0)
        after = np.frombuffer(f" {MARK}".encode(), np.uint8)
        room = np.zeros(int(size.sum()) + 2 * len(size), np.uint8)
        ends = np.cumsum(size + 2)
        room[_gather(ends - size - 2, size)] = data[_gather(start, size)]
        room[ends - 2], room[ends - 1] = after
        ids = self._ids(room.tobytes().decode())
        cuts = np.flatnonzero(ids == self.mark[0]) if len(self.mark) == 1 else []
        if len(cuts) != len(size):
            each = [self._ids(data[a : a + n].tobytes().decode()) for a, n in zip(start.tolist(), size.tolist(), strict=True)]
            return np.concatenate(each), np.array([len(x) for x in each])
        return np.delete(ids, cuts), np.diff(cuts, prepend=-1) - 1

    def _known(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different pieces, one after the other, and their numbers; from the memo, or learned and kept."""
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        head = np.ndarray(len(data), "<u8", padded, strides=(1,))[start]
        head &= (np.uint64(1) << (8 * np.minimum(size, 7)).astype(np.uint64)) - np.uint64(1)
        check = head | np.minimum(size, 255).astype(np.uint64) << np.uint64(56)
        places = [(key >> np.uint64(44)).astype(np.int64) % SLOTS, (key >> np.uint64(20)).astype(np.int64) % SLOTS + SLOTS]
        place = np.full(len(key), -1)
        for p in places:
            place = np.where((self.keys[p] == key) & (self.checks[p] == check), p, place)
        counts = np.where(place >= 0, self.sizes[place], 0).astype(np.int64)
        new, alone = np.flatnonzero((place < 0) & (size > 1)), np.flatnonzero(size == 1)
        taught, numbers = self._learn(data, start[new], size[new]) if len(new) else (np.zeros(0, np.uint32), np.zeros(0, int))
        counts[new] = numbers
        counts[alone] = [len(self.single[c]) for c in data[start[alone]].tolist()]
        begin = np.cumsum(counts) - counts
        out = np.zeros(counts.sum(), np.uint32)
        hit = np.flatnonzero((place >= 0) & (size > 1))
        out[_gather(begin[hit], counts[hit])] = self.kept[place[hit]].reshape(-1)[_gather(np.arange(len(hit)) * MOST_IDS, counts[hit])]
        out[_gather(begin[new], numbers)] = taught
        for i, c in zip(alone.tolist(), data[start[alone]].tolist(), strict=True):
            out[begin[i] : begin[i] + counts[i]] = self.single[c]
        self._keep(new[numbers <= MOST_IDS], places, key, check, counts, begin, out)
        return out, counts

    def _keep(self, new, places, key, check, counts, begin, ids) -> None:
        free = (self.keys[places[0][new]] == 0) | (key[new] % 2 == 0)
        at = np.where(free, places[0][new], places[1][new])
        at, first = np.unique(at, return_index=True)
        new = new[first]
        self.keys[at], self.checks[at], self.sizes[at] = key[new], check[new], counts[new]
        rows = np.zeros((len(new), MOST_IDS), np.uint32)
        rows.reshape(-1)[_gather(np.arange(len(new)) * MOST_IDS, counts[new])] = ids[_gather(begin[new], counts[new])]
        self.kept[at] = rows

    def _spell(self, blobs: list[bytes]) -> list[np.ndarray]:
        """Ids of each blob; every blob begins with white space."""
        data = np.frombuffer(b"".join(blobs), np.uint8)
        if self.drops_space:
            data = _FOLD[data]
        white = _WHITE[data]
        last = np.append(white[1:], True)
        begins = white.copy()
        begins[1:] |= _END[data[1:]] & last[1:] & _LETTER[data[:-1]]
        start = np.flatnonzero(begins)
        stop = np.append(start[1:], len(data))
        key, first, which = np.unique(shingles.span_hashes(data, start, stop, shingles.EXACT), return_index=True, return_inverse=True)
        ids, counts = self._known(data, start[first], (stop - start)[first], key)
        number = counts[which]
        out = ids[_gather((np.cumsum(counts) - counts)[which], number)]
        ends = np.append(0, np.cumsum(number))[np.searchsorted(start, np.cumsum([len(b) for b in blobs]))]
        return np.split(out, ends[:-1])

    def encode(self, texts: list[bytes | str]) -> list[np.ndarray]:
        """The ids of each text, as the library gives them for the whole text."""
        blobs = [t if isinstance(t, bytes) else t.encode() for t in texts]
        out: list[list | None] = [[] for _ in blobs]
        for held in shingles.chunks(blobs, SPACE):
            ends = np.cumsum([len(b) + 1 for _, _, b in held])
            bad = _unsafe(np.frombuffer(b"\0".join([b for _, _, b in held]), np.uint8))
            for k in np.unique(np.searchsorted(ends, bad, side="right")).tolist():
                out[held[k][0]] = None
            safe = [(i, b) for i, _, b in held if out[i] is not None]
            if safe:  # a line break stands before each text, and its id goes
                spelt = self._spell([b if out[i] else b"\n" + b for i, b in safe])
                for (i, _), ids in zip(safe, spelt, strict=True):
                    out[i].append(ids if self.drops_space or out[i] else ids[1:])
        whole = [i for i, x in enumerate(out) if x is None]
        ids = self.lib.encode_batch_fast([blobs[i].decode() for i in whole], add_special_tokens=False)
        for i, e in zip(whole, ids, strict=True):
            out[i] = [np.array(e.ids, np.uint32)]
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]


def encoder(path: str, drops_space: bool) -> Encoder:
    """The worker's encoder for a file; kept between tasks."""
    if (path, drops_space) not in _encoders:
        _encoders[path, drops_space] = Encoder(path, drops_space)
    return _encoders[path, drops_space]
