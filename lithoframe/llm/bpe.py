"""Byte-level BPE ids by the tokenizers library, each distinct pre-token encoded once.

The pre-tokens of a byte-level BPE are encoded independently of each other, so the ids of a text are the
ids of its pre-tokens in a row. Chunks of documents are split into pre-tokens with array operations and
only pre-tokens that the worker has not met are handed to the library. Documents with apostrophes before
letters, characters from U+0250 on, or the text of one of the library's added tokens go to it whole.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .flat import chunks, segment_hash

LETTER, DIGIT, WHITE, OTHER = 1, 2, 3, 4
#: Bytes of the known pre-tokens' arrays beyond which a worker starts afresh, and of text encoded at a time.
CACHE = 64 << 20
CHUNK = 1 << 20


def _kind(c: int) -> int:
    ch = chr(c)
    cat = unicodedata.category(ch)[0]
    white = ch.isspace() and not 0x1C <= c <= 0x1F
    return WHITE if white else LETTER if cat == "L" else DIGIT if cat == "N" else OTHER


_KIND = np.array([_kind(c) for c in range(0x250)], np.uint8)


class Encoder:
    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        # in a byte-level vocabulary each character of a token stands for one byte
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.bytes_of = np.ones(max(vocab.values()) + 1, np.int64)
        self.bytes_of[list(vocab.values())] = [len(t) for t in vocab]
        self._fresh()

    def _fresh(self) -> None:
        """No known pre-tokens: sorted hashes and their slots; ids of a slot are flat[starts[slot]:][:lengths[slot]]."""
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.starts, self.lengths, self.n = np.zeros(1024, np.int64), np.zeros(1024, np.int32), 0
        self.flat, self.used = np.zeros(4096, np.uint32), 0

    def _size(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.slots, self.starts, self.lengths, self.flat))

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pre-tokens. Words are strung together, which the library reads as the same pre-tokens, and cut apart by the bytes that each id stands for."""
        strung = [(b if b[:1] == b" " else b"\n" + b, i) for i, b in enumerate(pieces) if (k := b.removeprefix(b" ")) and (k[0] > 0xC2 or k.isalpha()) and k.decode().isalpha()]
        out: list = [None] * len(pieces)
        groups = [strung[i : i + 500] for i in range(0, len(strung), 500)]
        for group, ids in zip(groups, self.whole(["".join(b.decode() for b, _ in g) for g in groups]), strict=True):
            at = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum([len(b) for b, _ in group]))
            lo = 0
            for (b, i), hi in zip(group, (at + 1).tolist(), strict=True):
                out[i] = ids[lo + (b[0] == 10) : hi]
                lo = hi
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self.whole([pieces[i].decode() for i in rest]), strict=True):
            out[i] = x
        return out

    def _learn(self, hashes: np.ndarray, texts: list[bytes]) -> np.ndarray:
        """Slots of new pre-tokens; hashes ascend."""
        ids = self._encoded(texts)
        n = np.array([len(x) for x in ids], np.int32)
        slots = np.arange(self.n, self.n + len(n), dtype=np.int32)
        total = int(n.sum())
        while self.n + len(n) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.starts[slots], self.lengths[slots] = self.used + np.cumsum(n) - n, n
        self.flat[self.used : self.used + total] = np.concatenate(ids)
        self.n, self.used = self.n + len(n), self.used + total
        at = np.searchsorted(self.keys, hashes)
        self.keys, self.slots = np.insert(self.keys, at, hashes), np.insert(self.slots, at, slots)
        return slots

    def encode(self, column: pa.Array):
        """Yields (row, ids) of each text in order."""
        for lo, hi, data, off in chunks(column, CHUNK):
            yield from enumerate(self._chunk(column[lo:hi], data, off), lo)

    def _chunk(self, texts: pa.Array, data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        n, docs = len(data), len(off) - 1
        odd = np.zeros(docs, bool)
        if not n:
            return [np.zeros(0, np.uint32)] * docs
        doc_of = lambda at: np.searchsorted(off[:-1], at, "right") - 1
        kind = _KIND[np.minimum(data, 127)]
        multi = np.flatnonzero(data >= 0xC2)
        if len(multi):
            high = multi[data[multi] > 0xC8]
            odd[doc_of(high)] = True
            multi = multi[data[multi] <= 0xC8]
            cp = ((data[multi].astype(np.int64) & 31) << 6) | (data[multi + 1] & 63)
            kind[multi] = _KIND[cp]
            kind[multi + 1] = _KIND[cp]
        apostrophe = np.flatnonzero(data[:-1] == 39)
        if len(apostrophe):
            odd[doc_of(apostrophe[kind[apostrophe + 1] == LETTER])] = True
        raw = data.tobytes()
        for added in self.added:
            place = raw.find(added)
            while place >= 0:
                odd[doc_of(place)] = True
                place = raw.find(added, place + 1)
        lead = (data & 0xC0) != 0x80
        start = np.empty(n, bool)
        start[0] = True
        start[1:] = (kind[1:] != kind[:-1]) & lead[1:]
        ends = off[1:][off[:-1] < off[1:]]
        start[off[:-1][off[:-1] < off[1:]]] = True
        # a white run that is followed by something gives its last character away: alone, or before it if a space
        last = np.flatnonzero((kind[:-1] == WHITE) & (kind[1:] != WHITE))
        last = last[~np.isin(last, ends - 1)]
        while len(back := last[~lead[last]]):
            last = np.concatenate([last[lead[last]], back - 1])
        start[last] = True
        spaces = last[data[last] == 32]
        start[spaces + 1] = False
        at = np.flatnonzero(start)
        doc = doc_of(at)
        h = segment_hash(data, at)
        u, first, inv = np.unique(h, return_index=True, return_inverse=True)
        if self._size() > CACHE:
            self._fresh()
        slot = np.full(len(u), -1, np.int64)
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, u), len(self.keys) - 1)
            slot = np.where(self.keys[place] == u, self.slots[place], slot)
        new = np.flatnonzero(slot < 0)
        if len(new):
            new = new[~odd[doc[first[new]]]] if odd.any() else new
            stop = np.append(at[1:], n)
            if len(new):
                slot[new] = self._learn(u[new], [raw[a:b] for a, b in zip(at[first[new]].tolist(), stop[first[new]].tolist(), strict=True)])
            rest = np.flatnonzero(slot < 0)  # only met first in a document that goes to the library whole
            if len(rest):
                miss = np.isin(inv, rest) & ~odd[doc]
                odd[np.unique(doc[miss])] = True
        slot = slot[inv]
        size = np.where(slot >= 0, self.lengths[np.maximum(slot, 0)], 0)
        total = np.cumsum(size)
        src = np.repeat(np.where(slot >= 0, self.starts[np.maximum(slot, 0)], 0) - (total - size), size)
        ids = self.flat[src + np.arange(int(total[-1]))]
        tokens = np.bincount(doc, weights=size, minlength=docs).astype(np.int64)
        cut = np.concatenate(([0], np.cumsum(tokens)))
        out = [ids[cut[i] : cut[i + 1]] for i in range(docs)]
        rows = np.flatnonzero(odd)
        if len(rows):
            for i, x in zip(rows.tolist(), self.whole([texts[i].as_py() or "" for i in rows.tolist()]), strict=True):
                out[i] = x
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker and vocabulary."""
    return Encoder(path)
