"""Numbers of violations without a global order: counts by rule and range of ids, then ranks within a range.

An error's number in its rule is the count of the ranges before it and its rank in its own; its number in the file
adds the counts of the rules before. A range holds BUCKET ids at most, so no task gets a whole rule or file. Window
queries filter and cut first and number only the rows that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.compiler import run, view
from .pruned import S
from .sqlset import Q

BUCKET = 65_536
#: Rows that number() takes: a page, not a table.
PAGE = 10_000
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

view(
    "drc_numbered",
    f"""SELECT e.event_id, e.rule, e.kind, e.x0, e.y0, e.w, e.h, e.x0 + e.w AS x1, e.y0 + e.h AS y1, e.status, CAST(f.off + b.off + e.rn AS BIGINT) AS gnum, CAST(b.off + e.rn AS BIGINT) AS lnum
  FROM (SELECT event_id, rule, kind, x0, y0, w, h, status, event_id DIV {BUCKET} AS bucket, row_number() OVER (PARTITION BY rule, event_id DIV {BUCKET} ORDER BY event_id) AS rn FROM drc_raw) e
  JOIN (SELECT rule, bucket, coalesce(sum(n) OVER (PARTITION BY rule ORDER BY bucket {_BEFORE}), 0) AS off FROM (SELECT rule, event_id DIV {BUCKET} AS bucket, count(*) AS n FROM drc_raw GROUP BY rule, event_id DIV {BUCKET}) c) b ON b.rule = e.rule AND b.bucket = e.bucket
  JOIN (SELECT rule, coalesce(sum(n) OVER (ORDER BY rule {_BEFORE}), 0) AS off FROM (SELECT rule, count(*) AS n FROM drc_raw GROUP BY rule) t) f ON f.rule = e.rule""",
)
for _name in ("drc_numbers", "drc_block_bbox", "drc_page", "drc_rank", "drc_step", "drc_error_spec"):
    S[_name] = Q[_name].replace("drc_error", "drc_numbered")


def number(hits: DataFrame, errors: DataFrame) -> DataFrame:
    """hits (rule, event_id, ...; PAGE rows at most) with lnum and gnum among errors (rule, event_id)."""
    bucket = F.floor(F.col("event_id") / BUCKET).cast("long")
    counts = errors.groupBy("rule", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    rules = counts.groupBy("rule").agg(F.sum("n").alias("n"))  # a row for each rule of the deck
    first = rules.select("rule", F.coalesce(F.sum("n").over(Window.orderBy("rule").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    own = F.broadcast(hits.limit(PAGE).select("rule", "event_id", bucket.alias("bucket")))
    ahead = counts.join(own.withColumnRenamed("bucket", "b"), "rule").where("bucket < b").groupBy("rule", "event_id").agg(F.sum("n").alias("ahead"))
    inside = errors.select("rule", F.col("event_id").alias("e"), bucket.alias("bucket")).join(own, ["rule", "bucket"]).where("e <= event_id").groupBy("rule", "event_id").agg(F.count("*").alias("rank"))
    at = inside.join(ahead, ["rule", "event_id"], "left").join(first, "rule").withColumn("lnum", F.coalesce("ahead", F.lit(0)) + F.col("rank"))
    return hits.join(at.select("rule", "event_id", "lnum", (F.col("first") + F.col("lnum")).alias("gnum")), ["rule", "event_id"])


def _hits(spark: SparkSession, sf_dir: str, where: str, order: list[Column], offset: int, most: int) -> DataFrame:
    errors = run(spark, sf_dir, "SELECT * FROM drc_raw")
    return number(errors.where(where).orderBy(*order).offset(offset).limit(most), errors.select("rule", "event_id"))


def q_drc_query_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 open errors that meet a window, by rule and number."""
    where = "status = 0 AND x0 <= 500000 AND x0 + w >= 200000 AND y0 <= 500000 AND y0 + h >= 200000"
    return _hits(spark, sf_dir, where, [F.col("rule"), F.col("event_id")], 0, 200).select("rule", "lnum", "gnum", "kind")


def q_drc_grid_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the grid: open errors of two rules from cell 50 on."""
    found = _hits(spark, sf_dir, "rule IN ('CLICK.0', 'VIEW.1') AND status = 0", [F.col("rule"), F.col("event_id")], 50, 1000)
    return found.select("gnum", (F.row_number().over(Window.orderBy("gnum")) + 49).cast("long").alias("cell"))  # a page of rows


def q_marker_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marker nearest to a place within a radius; of equal ones the first."""
    d2 = (F.col("x0") - 500000) * (F.col("x0") - 500000) + (F.col("y0") - 500000) * (F.col("y0") - 500000)
    where = "(x0 - 500000) * (x0 - 500000) + (y0 - 500000) * (y0 - 500000) <= 10000000000"
    return _hits(spark, sf_dir, where, [d2, F.col("rule"), F.col("event_id")], 0, 1).select("gnum", d2.alias("d2"))
