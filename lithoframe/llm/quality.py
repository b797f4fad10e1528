"""Operator 7: quality scores by a generalised additive model with pairwise interactions.

Features describe a text's surface only: length, word lengths, shares of upper case, digits, symbols and
bars, repetition of words, line shape. They come from whole texts with array operations. The model is
fitted on the driver to SAMPLE labelled rows at most, chosen by a hash of the id among the rows that may be
learnt from; every document is then scored where it lies.

Edge cases: null and empty texts have all features 0 and get a score like any other; repeated rows get
equal scores; without labels, or with labels of one kind, the score is the smoothed share of label 1; null
labels are not learnt from, several labels of a document count by their mean; a row without doc_id is
scored and not held out; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .flat import chunks, mix64, tidied, utf8_lengths, words
from .gam import AdditiveModel

#: Labelled rows that a model is fitted to, at most.
SAMPLE = 20_000
FEATURES = 18


def _share(flag: np.ndarray, off: np.ndarray, total: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
    return (c[off[1:]] - c[off[:-1]]) / np.maximum(total, 1)


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    n = len(off) - 1
    chars = utf8_lengths(data, off)
    start, end, doc, h = words(data, off)
    count = np.bincount(doc, minlength=n)
    per = np.maximum(count, 1)
    length = (end - start).astype(float)
    mean = np.bincount(doc, length, n) / per
    spread = np.sqrt(np.maximum(np.bincount(doc, length**2, n) / per - mean**2, 0))
    letters = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 0x80)
    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    symbol = np.isin(data, np.frombuffer(b"#$%&*@^~<>{}[]\\/_=+", np.uint8))
    _, first = np.unique(mix64(h + mix64(doc.astype(np.uint64) + np.uint64(1))), return_index=True)
    distinct = np.bincount(doc[first], minlength=n) / per
    again = np.zeros(len(h))
    if len(h) > 1:
        again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    last = data[end - 1] if len(end) else np.zeros(0, np.uint8)
    odd_end = np.isin(last, np.frombuffer(b"#$%&*!|", np.uint8)).astype(float)
    stop_end = np.isin(last, np.frombuffer(b".?", np.uint8)).astype(float)
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    rows = _share(data == 10, off, np.ones(n)) + 1
    return np.column_stack([
        np.log1p(chars), np.log1p(count), mean, spread, np.log1p(longest),
        _share(upper, off, chars), _share(letters, off, chars), _share(digit, off, chars), _share(symbol, off, chars),
        _share(data == 124, off, per), _share(data == 33, off, per), distinct, np.bincount(doc, again, n) / per,
        np.bincount(doc, odd_end, n) / per, np.bincount(doc, stop_end, n) / per, np.log1p(chars / rows), np.log1p(rows), _share(data == 44, off, per),
    ])


def remainder(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def sample(labels: DataFrame, label: str, learn: Column, rows: int = SAMPLE) -> DataFrame:
    """(doc_id, y): at most so many labelled documents that may be learnt from, by a hash of the id."""
    one = labels.where(learn & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def _featured(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(d, o) for _, _, d, o in chunks(b.column(2))]
            x = np.concatenate(x) if x else np.zeros((0, FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x[:, i]) for i in range(FEATURES))], ["doc_id", "y", *(f"x{i}" for i in range(FEATURES))])

    return docs.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, " + ", ".join(f"x{i} double" for i in range(FEATURES)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> AdditiveModel:
    chosen = F.broadcast(sample(labels, "quality", learn))  # SAMPLE rows of two numbers at most
    rows = _featured(docs.select("doc_id", "text").join(chosen, "doc_id")).dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas()
    x = rows.iloc[:, 2:].to_numpy(float).reshape(-1, FEATURES)
    return AdditiveModel().fit(x, rows["y"].to_numpy(float))


def score(docs: DataFrame, model: AdditiveModel, *keep: str, into: str = "score") -> DataFrame:
    """The columns keep of docs with the score added as column `into`, which must not be among them."""
    kept = docs.select(*keep, "text") if "text" not in keep else docs.select(*keep)
    at = kept.columns.index("text")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [model.score(features(d, o)) for _, _, d, o in chunks(b.column(at))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(np.concatenate(s) if s else np.zeros(0))], [*keep, into])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[: len(keep)])
    return kept.mapInArrow(run, f"{fields}, `{into}` double")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    model = fit(docs, table(spark, sf_dir, "labels"), ~out)
    return score(docs, model, "doc_id").select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
