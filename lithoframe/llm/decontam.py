"""Operator 5: benchmark decontamination by template canonicalisation.

Words are runs of letters and digits, lower-cased. Numbers, names (capitalised words inside a sentence,
runs of them as one) and units after a number become typed placeholders, so a question whose values were
exchanged has the same template. Two further readings find what that one misses: one takes capitalised words
that open a sentence as names too (a name there is exchanged like any other), one keeps every word and number
as it is (copies in other case). A pair is given by the first reading that finds it. Windows of WINDOW template tokens with enough literal words are hash-joined
with the benchmark's windows. Matches on one diagonal are merged, and their slots are checked: over
an item, a benchmark value must always stand for one value of the document and the other way round; else
only the part of the run up to the contradiction counts. A document is contaminated by an item if a
consistent run covers at least LONG tokens, or half of the item and a whole window; runs on diagonals at most
NEAR apart that follow each other in both texts are one run. Items of fewer than
WINDOW tokens are one window of their own length, if they have MIN_LITERAL literal words.

The benchmark becomes a table of windows; a bitmap of their hashes, of SIEVE bits whatever its size, goes to the
workers, so that only windows that may match leave the scan of the documents. They meet the benchmark's windows in
one hash join, by broadcast only if those are at most WINDOW_ROWS rows. A matched pair of document and item is
then one row, no larger than the two texts. Neither table is gathered on the driver.

Edge cases: null or empty texts on either side match nothing; repeated documents and items give a row for
each id pair (the longest cover of the repeated ones); empty tables give an empty result; extra columns
are ignored; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, stored, table
from .flat import _ODD, LOWER, chunks, mix64, segment_hash, tidied

WINDOW, LONG, MIN_LITERAL = 8, 13, 4
#: Words put in or left out between two matched runs that are read as one.
NEAR = 4
#: Bits of the bitmap of window hashes; benchmark windows (about 150 bytes each) that may be broadcast.
SIEVE, WINDOW_ROWS = 1 << 25, 200_000
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC13FA9A902A6328F))
#: Units of measure and currency that follow a number.
UNITS = "km m cm mm mi mile miles ft feet foot inch inches yd yards kg g mg lb lbs oz pounds ton tons l ml litre litres liter liters gallon gallons s sec seconds min minutes minute h hr hour hours day days week weeks month months year years percent usd eur dollars dollar euros euro cents degrees celsius fahrenheit mph kmh watts volts".split()

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def _hash_of(word: str) -> np.uint64:
    data = np.frombuffer(word.encode(), np.uint8)
    return segment_hash(data, np.array([0]))[0]


_UNITS = np.sort(np.array([_hash_of(u) for u in UNITS], np.uint64))


def templates(data: np.ndarray, off: np.ndarray):
    """doc, template hash and value hash of each template token; placeholders keep the value they stand for."""
    return readings(data, off)[0]


def readings(data: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """templates(), the same with words that open a sentence as names, and all words as they are."""
    n = len(data)
    z = np.zeros(0, np.uint64)
    none = [(np.zeros(0, np.int64), z, z)] * 3
    if not n:
        return none
    inside = _WORD[data]
    prev = np.empty(n, bool)
    prev[0], prev[1:] = False, inside[:-1]
    prev[off[:-1][off[:-1] < off[1:]]] = False
    start = np.flatnonzero(inside & ~prev)
    if not len(start):
        return none
    doc = np.searchsorted(off[:-1], start, "right") - 1
    value = segment_hash(LOWER[data], start, inside)
    length = np.add.reduceat(inside.astype(np.int64), start)
    end = start + length
    first = data[start]
    digits = np.concatenate(([0], np.cumsum((data >= 48) & (data < 58))))
    number = digits[end] - digits[start] == length
    # what lies between a word and the one before it, in its document
    stops = np.isin(data, np.frombuffer(b'.!?:;\n"', np.uint8))
    stop = np.concatenate(([0], np.cumsum(stops)))
    same = np.zeros(len(start), bool)
    same[1:] = doc[1:] == doc[:-1]
    gap = np.zeros(len(start), np.int64)
    gap[1:] = start[1:] - end[:-1]
    opens = ~same
    opens[1:] |= stop[start[1:]] != stop[end[:-1]]
    second = data[np.minimum(start + 1, n - 1)]
    upper = ((first >= 65) & (first < 91)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    after = np.zeros(len(start), bool)
    after[1:] = number[:-1] & same[1:]
    unit = after & np.isin(value, _UNITS)
    glued = after & number & (gap == 1) & np.isin(data[np.maximum(start - 1, 0)], np.frombuffer(b".,:/-", np.uint8))
    out = []
    for name in (upper & ~opens & ~number, upper & ~number):
        chained = np.zeros(len(start), bool)
        chained[1:] = name[1:] & name[:-1] & same[1:] & ~opens[1:]
        head = np.flatnonzero(~(glued | chained))
        token = np.where(number, NUMBER, np.where(name, NAME, np.where(unit, UNIT, value)))[head]
        whole = np.add.reduceat(value, head) if len(head) else z
        out.append((doc[head], token, whole))
    return [*out, (doc, value, value)]


def _windows(token: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of w tokens, and which have enough literal words."""
    m = max(len(token) - w + 1, 0)
    h = np.zeros(m, np.uint64)
    for i in range(w if m else 0):
        h += token[i : m + i] * _ODD[i + w % 7]
    literal = np.concatenate(([0], np.cumsum((token != NUMBER) & (token != NAME) & (token != UNIT))))
    return mix64(h + np.uint64(w)), (literal[w:] - literal[:-w] >= min(MIN_LITERAL, w)) if m else np.zeros(0, bool)


def _lists(x: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(x.view(np.int64)))


def _spans(x: np.ndarray, start: np.ndarray, w: int) -> np.ndarray:
    return x[(start[:, None] + np.arange(w)).ravel()] if len(start) else x[:0]


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(reading, h, w, item_id, item_key, n_item, j, token, value): the windows of every item that can be matched."""
    schema = "reading int, h long, w int, item_id long, item_key long, n_item int, j int, token array<long>, value array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, off in chunks(batch.column(2)):
                for reading, (doc, token, value) in enumerate(readings(data, off)):
                    for d in np.unique(doc).tolist():
                        a, b = np.searchsorted(doc, [d, d + 1])
                        n, t = int(b - a), token[a:b]
                        w = min(WINDOW, n)
                        if w < WINDOW and ((t != NUMBER) & (t != NAME) & (t != UNIT)).sum() < MIN_LITERAL:
                            continue
                        h, ok = _windows(t, w)
                        at = np.flatnonzero(ok)
                        k, own = len(at), pa.array([lo + d])
                        same = lambda x, kind, k=k: pa.array([x] * k, kind)
                        item, key = (batch.column(i).take(own)[0].as_py() for i in (0, 1))
                        size = np.full(k, w)
                        cols = [same(reading, pa.int32()), pa.array(h[at].view(np.int64)), same(w, pa.int32()), same(item, pa.int64()), same(key, pa.int64()), same(n, pa.int32()), pa.array(at.astype(np.int32))]
                        yield pa.RecordBatch.from_arrays([*cols, _lists(_spans(t, at, w), size), _lists(_spans(value[a:b], at, w), size)], ["reading", "h", "w", "item_id", "item_key", "n_item", "j", "token", "value"])

    rows = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("item_key"), "text")
    return rows.mapInArrow(run, schema)


def sieve_of(windows: DataFrame, bits: int = SIEVE) -> np.ndarray:
    """Which values of a hash modulo bits the windows have, as packed bits; bits / 8 bytes, made by the executors."""
    at = F.pmod("h", F.lit(bits)) + 1
    out = np.zeros((-(-bits // 32768), 4096), np.uint8)
    for r in windows.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m")).collect():
        out[r["b"] - 1] = np.frombuffer(r["m"], np.uint8)
    return out.ravel()


def document_windows(docs: DataFrame, sieve: np.ndarray, sizes: list[int]) -> DataFrame:
    """(reading, h, doc_id, doc_key, i, dv): the documents' windows whose hash the sieve has, with the values of their tokens."""
    bits = np.uint64(len(sieve) * 8)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, off in chunks(batch.column(2)):
                for reading, (doc, token, value) in enumerate(readings(data, off)):
                    for w in sizes:
                        h, ok = _windows(token, w)
                        if not len(h):
                            continue
                        low = (h % bits).astype(np.int64)
                        at = np.flatnonzero((sieve[low >> 3] >> (low & 7).astype(np.uint8)) & ok & (doc[: len(h)] == doc[w - 1 :]))
                        if len(at):
                            own = pa.array(lo + doc[at])
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(at), reading, np.int32)), pa.array(h[at].view(np.int64)), batch.column(0).take(own), batch.column(1).take(own), pa.array(at - np.searchsorted(doc, doc[at])), _lists(_spans(value, at, w), np.full(len(at), w))],
                                ["reading", "h", "doc_id", "doc_key", "i", "dv"],
                            )

    rows = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("doc_key"), "text")
    return rows.mapInArrow(run, "reading int, h long, doc_id long, doc_key long, i long, dv array<long>")


def cover(n_item: int, hits: list[tuple[int, int, list[int], list[int], list[int]]]) -> tuple[int, int]:
    """Tokens of the longest consistent run among matched windows (i, j, token, value, dv) of a document and an item, and its slots."""
    it, iv, diagonals, there = np.zeros(n_item, np.int64), np.zeros(n_item, np.int64), {}, {}
    for i, j, token, value, dv in hits:
        diagonals.setdefault(i - j, set()).add((j, len(token)))
        it[j : j + len(token)], iv[j : j + len(token)] = token, value
        there.update(zip(range(i, i + len(dv)), dv, strict=True))
    it, iv, best = it.view(np.uint64), iv.view(np.uint64), (0, 0)
    for at, to in chained_runs({k: list(v) for k, v in diagonals.items()}):
        found = consistent(it[at], iv[at], it[at], np.array([there[x] for x in to.tolist()], np.int64).view(np.uint64))
        best = max(best, found, key=lambda x: x[0])
    return best


def chained_runs(diagonals: dict[int, list[tuple[int, int]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in item and document of every run of windows, and of the longest chain of runs that ends in it."""
    runs: dict[int, list[list[int]]] = {}
    for shift, spans in diagonals.items():
        own = runs[shift] = []
        for j, w in sorted(spans):
            if own and j <= own[-1][1]:
                own[-1][1] = max(own[-1][1], j + w)
            else:
                own.append([j, j + w])
    # (end, shift) of a run: tokens of its best chain, the run before it there, and where it starts then
    best: dict[tuple[int, int], tuple[int, tuple[int, int] | None, int]] = {}
    for b, shift, a in sorted((b, shift, a) for shift, own in runs.items() for a, b in own):
        best[b, shift] = (b - a, None, a)
        for near in range(shift - NEAR, shift + NEAR + 1):
            for _, e in runs.get(near, ()) if near != shift else ():
                start = max(a, e, e + near - shift)
                if e < b and start < b and (e, near) in best and best[e, near][0] + b - start > best[b, shift][0]:
                    best[b, shift] = (best[e, near][0] + b - start, (e, near), start)
    for shift, own in runs.items():
        for a, b in own:
            at = np.arange(a, b)
            yield at, at + shift
            parts, key = [], (b, shift)
            while key:
                _, before, start = best[key]
                parts.append((np.arange(start, key[0]), key[1]))
                key = before
            if len(parts) > 1:
                yield np.concatenate([p for p, _ in parts[::-1]]), np.concatenate([p + k for p, k in parts[::-1]])


def consistent(it: np.ndarray, iv: np.ndarray, dt: np.ndarray, dv: np.ndarray) -> tuple[int, int]:
    """Longest part of a matched run whose slots map values one to one, and its slots."""
    slots = np.flatnonzero((it == NUMBER) | (it == NAME) | (it == UNIT)).tolist()
    best, since, there, back, used = (0, 0), 0, {}, {}, 0
    for s in slots:
        key, got = (int(it[s]), int(iv[s])), (int(dt[s]), int(dv[s]))
        if there.get(key, got) != got or back.get(got, key) != key:
            best = max(best, (s - since, used))
            since, there, back, used = s, {}, {}, 0
        there[key], back[got] = got, key
        used += 1
    return max(best, (len(it) - since, used))


@tidied
def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of matched pairs that are contaminated, with tokens covered, share of the item and slots; one pair at a time is made into Python objects."""
    for batch in batches:
        rows = []
        for row, (n, hits) in enumerate(zip(batch.column("n_item").to_pylist(), batch.column("hits"), strict=True)):
            best, slots = cover(n, [(x["i"], x["j"], x["token"], x["value"], x["dv"]) for x in hits.as_py()])
            if best >= min(LONG, n) or (best >= WINDOW and 2 * best >= n):
                rows.append((row, best, best / n, slots))
        own = pa.array([r[0] for r in rows], pa.int64())
        cols = [pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(own) for c in ("doc_id", "doc_key", "item_id", "reading")), *cols], ["doc_id", "doc_key", "item_id", "reading", "n_tokens", "share", "n_slots"])


def contaminated(docs: DataFrame, benchmark: DataFrame, most: int = WINDOW_ROWS) -> DataFrame:
    """(doc_id, item_id, n_tokens, share, n_slots) of every contaminated pair; most: benchmark windows that may be broadcast."""
    windows = stored(benchmark_windows(benchmark))
    sizes = [r["w"] for r in windows.select("w").distinct().collect()]  # at most WINDOW of them
    met = document_windows(docs, sieve_of(windows), sorted(sizes)).join(small(windows, most), ["reading", "h"]).where(F.size("dv") == F.col("w"))
    pairs = met.groupBy("doc_id", "doc_key", "item_id", "item_key", "n_item", "reading").agg(F.collect_list(F.struct("i", "j", "token", "value", "dv")).alias("hits"))
    found = pairs.mapInArrow(_judged, "doc_id long, doc_key long, item_id long, reading int, n_tokens long, share double, n_slots long")
    # of a text, the first reading that finds the item, and there the longest cover; of texts under one id the longest
    first = found.groupBy("doc_id", "doc_key", "item_id").agg(F.min(F.struct("reading", -F.col("n_tokens"), -F.col("share"), -F.col("n_slots")).cast("struct<reading:int,n_tokens:long,share:double,n_slots:long>")).alias("f"))
    best = F.max(F.struct((-F.col("f.n_tokens")).alias("n_tokens"), (-F.col("f.share")).alias("share"), (-F.col("f.n_slots")).alias("n_slots"))).alias("m")
    return first.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.n_tokens", "m.share", "m.n_slots")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
