"""A corpus pipeline: quality filter, line dedup, near-duplicate removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written and read again as the next
stage's docs. All but the last return the columns of documents.

Edge cases, in every stage: null and empty texts are documents like others (the classifier scores them; no
other stage drops them; packing makes one piece of each); only the classifier can reject a row without doc_id;
repeated rows of an id are one document, kept or dropped together; very long texts are read whole; ties go to the smallest doc_id; further columns are passed on as they
are, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.llm import decontam, line_dedup, near_join, packing, quality
from lithoframe.llm.common import small, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    out = F.coalesce(quality.remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~out)
    return quality.score(docs, model, *docs.columns, into="__score").where("__score >= 0.5").select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that it lost; n_chars follows the text."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    kept = line_dedup.dedup_lines(docs.select("doc_id", "text", F.struct(*rest).alias("rest")))
    columns = {c: F.col(f"rest.`{c}`") for c in rest} | {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)}
    return kept.select(*(columns[c].alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the document of the smallest id."""
    found = near_join.near_components(docs, k=5, num=80, den=100)
    away = found.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(small(stored(away)), "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(small(stored(found)), "doc_id", "left_anti").select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: SQL can express neither the classifier nor the packing; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
