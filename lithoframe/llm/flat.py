"""Columnar text kernels: an Arrow string column as one byte buffer, words as index arrays.

A batch is cut into chunks of whole documents (about CHUNK bytes; a longer document is a chunk of its
own), so memory follows the chunk and not the batch, and no text is ever cut short.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20

#: White space of the word contracts, bytes 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240607))
_ZOBRIST = _rng.integers(0, 2**64, size=256 * 256, dtype=np.uint64)
_ODD = _rng.integers(0, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def tidied(run: Callable) -> Callable:
    """run, a function of mapInArrow, which gives the memory that it has freed back to the system at its end: allocators keep it, and a worker lives on through later stages."""

    @wraps(run)
    def whole(*args):
        yield from run(*args)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return whole


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole documents."""
    data, offsets = buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def segment_hash(data: np.ndarray, start: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
    """A hash of each run of bytes from one start to the next; bytes outside keep count as nothing."""
    if not len(start):
        return np.zeros(0, np.uint64)
    lead = int(start[0])
    pos = np.arange(len(data) - lead, dtype=np.int64) - np.repeat(start - lead, np.diff(np.append(start, len(data))))
    v = _ZOBRIST[((pos & 255) << 8) | data[lead:]]
    if len(pos) and (pos > 255).any():
        v = v * ((pos >> 8).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    if keep is not None:
        v[~keep[lead:]] = 0
    return mix64(np.add.reduceat(v, start - lead))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, document and hash of every word (white space as SPACE, A-Z lower-cased for the hash)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    inside = ~SPACE[data]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    prev = np.empty(n, bool)
    prev[0], prev[1:] = False, inside[:-1]
    prev[first] = False
    start = np.flatnonzero(inside & ~prev)
    nxt = np.empty(n, bool)
    nxt[-1], nxt[:-1] = False, inside[1:]
    nxt[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = False
    end = np.flatnonzero(inside & ~nxt) + 1
    doc = np.searchsorted(offsets[:-1], start, "right") - 1
    return start, end, doc, segment_hash(LOWER[data], start, inside)


def shingles(doc: np.ndarray, word: np.ndarray, n_docs: int, k: int) -> list[np.ndarray]:
    """Per document, the sorted distinct hashes of its k-word shingles; with 1 to k-1 words the whole sequence is one."""
    count = np.bincount(doc, minlength=n_docs)
    first = np.concatenate(([0], np.cumsum(count)))
    m = len(word)
    full = np.zeros(max(m - k + 1, 0), np.uint64)
    for i in range(k):
        full += word[i : m - k + 1 + i] * _ODD[i] if m >= k else full
    full = mix64(full)
    out = []
    for d in range(n_docs):
        c, f = int(count[d]), int(first[d])
        if c >= k:
            out.append(np.unique(full[f : f + c - k + 1]))
        elif c:
            short = np.uint64(c) * _ODD[32]
            with np.errstate(over="ignore"):
                for i in range(c):
                    short = short + word[f + i] * _ODD[33 + i]
            out.append(mix64(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def utf8_lengths(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points of each document."""
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return heads[offsets[1:]] - heads[offsets[:-1]]
