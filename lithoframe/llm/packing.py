"""Operator 1: best-fit decreasing packing of documents into sequences.

Best-fit decreasing places a document by its length alone, so the whole run is planned on the histogram
of piece lengths (no more entries than the capacity, whatever the corpus): a segment tree over remaining
capacities finds the tightest open bin in logarithmic time, and equal lengths are placed as runs. The
plan gives for each length the sequences of ranks [lo, hi); its rows are bounded by the capacity, not by
the corpus, and go to the workers with the function. Ranks within a length are dealt per partition and
offset by the counts of the partitions before, so no length, however frequent, meets in one task.

Edge cases: a null or empty text is one piece that holds only the end id; repeated rows and ids are
packed as often as they occur; an empty table gives an empty result; extra columns are ignored; texts of
any length are cut into pieces, of which only the first may be shorter than the capacity.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import encoder
from .common import stored, table
from .flat import tidied

CAPACITY = 1024
END_ID = 2
#: Pieces that a task of the result has at least, on average: a file of a few rows costs its executor more than the rows.
TASK_ROWS = 10_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class CapacityTree:
    """Segment tree over remaining capacities: which of them have open bins."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)

    def set(self, capacity: int, is_open: bool) -> None:
        i = capacity + self.leaves
        self.open[i] = int(is_open)
        while i > 1:
            i >>= 1
            self.open[i] = self.open[2 * i] | self.open[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The least capacity with an open bin that is at least need."""
        i = need + self.leaves
        if self.open[i]:
            return need
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, sequence, per_bin, offset): ranks lo to hi of that length go per_bin to a sequence, from that sequence and offset on.

    The same bins as placing the documents one by one: a bin that has just taken one is the tightest for
    the next of the same length as long as that fits.
    """
    tree, bins, rows, made = CapacityTree(capacity), [deque() for _ in range(capacity + 1)], [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            bins[room].append((first, n))
            tree.set(room, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, per = capacity, capacity // length
                first, n = made, -(-left // per)
                made += n
            else:
                first, n = bins[room].popleft()
                per = room // length
            full = min(n, left // per)
            if full:
                rows.append((length, rank, rank + full * per, first, per, capacity - room))
                rank, left = rank + full * per, left - full * per
                put(room - per * length, first, full)
            if left and full < n:
                rows.append((length, rank, rank + left, first + full, left, capacity - room))
                put(room - left * length, first + full, 1)
                full, left = full + 1, 0
            if room < capacity:
                if n > full:
                    bins[room].appendleft((first + full, n - full))
                tree.set(room, bool(bins[room]))
    return rows


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece; part and nth number the pieces of a length within a partition."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            for row, x in enc.encode(b.column(1)):
                x = np.append(x, np.uint32(end_id)).astype("<u4")
                k = -(-len(x) // capacity)
                first = len(x) - capacity * (k - 1)
                for p in range(k):
                    lo, hi = (0, first) if not p else (first + (p - 1) * capacity, first + p * capacity)
                    out.append((ids[row], p, lo, hi - lo, zlib.crc32(x[lo:hi]), part, int(seen[hi - lo])))
                    seen[hi - lo] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "nth")
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    cut = stored(pieces(docs, tokenizer, capacity, end_id))
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    rows = np.array(plan(histogram, capacity), np.int64).reshape(-1, 6)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length).tolist():
                own = np.flatnonzero(length == n)
                lo = np.searchsorted(-rows[:, 0], -n)
                hi = np.searchsorted(-rows[:, 0], -n, "right")
                at = rows[lo:hi][np.searchsorted(rows[lo:hi, 1], rank[own], "right") - 1]
                k = rank[own] - at[:, 1]
                seq[own], offset[own] = at[:, 3] + k // at[:, 4], at[:, 5] + (k % at[:, 4]) * n
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(base, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    tasks = max(1, sum(histogram.values()) // TASK_ROWS)
    return ranked.coalesce(tasks).mapInArrow(place, PACKED)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
