"""Operator 2: licence scan by the Dice coefficient over word bigrams.

Texts are normalised to runs of letters and digits, lower-cased. Word bigrams that occur in a template mark
candidate regions of a document; a region's bigrams are compared with the template's as multisets. A Dice
coefficient of at least LEAST needs sizes within LEAST / (2 - LEAST) of each other, so templates and
regions outside these bounds are never compared. Regions of a template are all spans within the bounds that
begin and end with one of its bigrams, whatever lies between; the best one begins and ends so.

Edge cases: null and empty texts match nothing; repeated rows give one row for each template found; ties go
to the earliest region; extra columns are ignored; texts are read whole; empty tables give empty results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontam import _WORD
from .flat import _ODD, LOWER, chunks, mix64, segment_hash
from .license_texts import TEMPLATES

LEAST = 0.8


def normal_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = _WORD[data]
    prev = np.empty(n, bool)
    prev[0], prev[1:] = False, inside[:-1]
    prev[off[:-1][off[:-1] < off[1:]]] = False
    start = np.flatnonzero(inside & ~prev)
    return np.searchsorted(off[:-1], start, "right") - 1, segment_hash(LOWER[data], start, inside)


def bigrams(h: np.ndarray) -> np.ndarray:
    return mix64(h[:-1] * _ODD[0] + h[1:] * _ODD[1])


class Templates:
    def __init__(self, templates: dict[str, str] = TEMPLATES, least: float = LEAST):
        self.least, self.names, self.bags, self.where = least, [], [], {}
        for name, text in templates.items():
            raw = np.frombuffer(text.encode(), np.uint8)
            bag = Counter(bigrams(normal_words(raw, np.array([0, len(raw)]))[1]).tolist())
            if bag:
                for h in bag:
                    self.where.setdefault(h, []).append(len(self.names))
                self.names.append(name)
                self.bags.append(bag)
        self.sizes = [sum(b.values()) for b in self.bags]
        self.keys = np.sort(np.array(list(self.where), np.uint64))
        self.sieve = np.zeros(1 << 18, bool)
        self.sieve[(self.keys >> np.uint64(46)).astype(np.int64)] = True

    def found(self, doc: np.ndarray, words: np.ndarray) -> list[tuple[int, str, float, int, int]]:
        """(doc, template, dice, first word, words) of each template's best region in each document."""
        if len(words) < 2:
            return []
        h = bigrams(words)
        same = doc[1:] == doc[:-1]
        maybe = np.flatnonzero(same & self.sieve[(h >> np.uint64(46)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        maybe = maybe[self.keys[at] == h[maybe]]
        hits: dict[tuple[int, int], list[int]] = {}
        for i, d, x in zip(maybe.tolist(), doc[maybe].tolist(), h[maybe].tolist(), strict=True):
            for t in self.where[x]:
                hits.setdefault((d, t), []).append(i)
        first = np.searchsorted(doc, np.arange(int(doc[-1]) + 1))
        bound, out = self.least / (2 - self.least), []
        for (d, t), places in hits.items():
            n, best = self.sizes[t], (0.0, 0, 0)
            bag, keys = self.bags[t], h[places].tolist()
            # a span of L bigrams with c in common has 2 c >= least (L + n) and L >= c, so c >= bound n
            reach = np.searchsorted(places, np.array(places) + n / bound, "right")
            for i, p in enumerate(places):
                if reach[i] - i < bound * n - 1e-9:
                    continue
                left, common = dict(bag), 0
                for j in range(i, reach[i]):
                    if not left[keys[j]]:
                        continue  # only a bigram that counts makes a longer span better
                    left[keys[j]] -= 1
                    common += 1
                    size = places[j] + 1 - p
                    dice = 2 * common / (size + n)
                    if dice >= self.least and dice > best[0]:
                        best = (dice, p - int(first[d]), size + 1)
            if best[0]:
                out.append((d, self.names[t], *best))
        return out


def scanned(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(doc_id, license, dice, first_word, n_words) of the templates found."""
    kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, least)
        for b in batches:
            rows = [(lo + d, *rest) for lo, _, data, off in chunks(b.column(1)) for d, *rest in known.found(*normal_words(data, off))]
            ids = b.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[i + 1] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", "license", "dice", "first_word", "n_words"])

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, license string, dice double, first_word long, n_words long")
    best = F.max(F.struct("dice", (-F.col("first_word")).alias("at"), "n_words")).alias("m")
    return found.groupBy("doc_id", "license").agg(best).select("doc_id", "license", "m.dice", (-F.col("m.at")).alias("first_word"), "m.n_words")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))
