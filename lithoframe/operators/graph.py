"""Operators over graphs: derivation closure, cell heights, recursive folds of the placement hierarchy.

Each is a loop of joins over a frontier; a step's result is written to the shared checkpoint folder, so a
lost executor repeats one step. Rounds are bounded by the height of the graph, and cycles are an error
where the reference semantics say so.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.compiler import run


def checkpointed(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="graph-")
        spark.conf.set("spark.checkpoint.dir", at)
    path = f"{at.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stacked(parts: list[DataFrame]) -> DataFrame:
    """The rows of all parts, each of which is stored once."""
    return reduce(DataFrame.unionByName, parts)


def closure(roots: DataFrame, edges: DataFrame, most: int = 100) -> DataFrame:
    """(root, name): everything reachable from (root, name) along edges (name, operand); cycles are harmless."""
    steps = edges.select("name", F.col("operand").alias("nxt"))
    found = [checkpointed(roots.select("root", "name").distinct())]
    for _ in range(most):
        step = found[-1].join(steps, "name").select("root", F.col("nxt").alias("name")).distinct()
        front = checkpointed(step.join(stacked(found), ["root", "name"], "left_anti"))
        if not front.limit(1).count():
            return stacked(found)
        found.append(front)
    raise ValueError("the derivation is deeper than the limit")


def heights(places: DataFrame, most: int = 64) -> DataFrame:
    """(cell, height): leaves have 0; a cycle is an error.

    A round keeps the cells that are one level higher at least (parents of the last round's) and the edges to them, so
    edges are read whole once and then only shrink. A round that loses no cell has a cycle.
    """
    edges = places.select("parent", "child")
    front = checkpointed(edges.select(F.col("parent").alias("cell")).distinct())
    kids = checkpointed(edges.select(F.col("child").alias("cell")).distinct().join(front.withColumn("inner", F.lit(1)), "cell", "left"))
    known = [kids.where("inner IS NULL").select("cell", F.lit(0).alias("height"))]
    inner = kids.where("inner = 1").select(F.col("cell").alias("child"))
    held = front.count()
    for height in range(1, most + 1):
        edges = checkpointed(edges.join(inner, "child", "left_semi").select("parent", "child"))
        higher = checkpointed(edges.select(F.col("parent").alias("cell")).distinct())
        left = higher.count()
        if not left:
            return stacked([*known, front.select("cell", F.lit(height).alias("height"))])
        if left == held:
            raise ValueError("the hierarchy has a cycle")
        known.append(checkpointed(front.join(higher, "cell", "left_anti").select("cell", F.lit(height).alias("height"))))
        front, held, inner = higher, left, higher.withColumnRenamed("cell", "child")
    raise ValueError("the hierarchy has a cycle or is deeper than the limit")


def folded(places: DataFrame, own: DataFrame, tall: DataFrame, placed: Callable[[DataFrame, DataFrame], DataFrame], total: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Values (cell, ...) of every cell: its own rows and those of its children as placed, bottom up.

    own has a row or more for cells that have values of their own; placed(places, values) gives the rows (cell, ...) that
    children's values add to their parents; total() makes the values of cells of such rows. A level's values are sent
    to all its parents at once, stored with the parents' heights, so a placement is joined in one round only.
    """
    top = tall.agg(F.max("height")).first()[0] or 0
    names = own.columns
    own = checkpointed(total(own).join(tall, "cell").select(*names, "height"))
    sent, found = [own], []
    above = places.join(tall.where("height > 0").withColumnRenamed("cell", "child"), "child").select(*places.columns, F.col("height").alias("of"))
    above = checkpointed(above) if top > 1 else above
    for h in range(top + 1):
        rows = stacked([s.where(F.col("height") == h).select(*names) for s in sent])
        found.append(checkpointed(total(rows)) if h else rows)
        if h < top:
            at = above.where(F.col("of") == h).select(*places.columns) if h else places
            new = total(placed(at, found[-1])).join(tall.where(F.col("height") > h), "cell")
            sent.append(checkpointed(new.select(*names, "height")))
    return stacked(found)


def recursive_members(places: DataFrame, own: DataFrame, tall: DataFrame) -> DataFrame:
    """(cell, members): own (cell, members) plus repetitions times those of the children, bottom up."""
    reps = places.select("parent", "child", (F.col("na") * F.col("nb")).alias("k"))
    every = tall.select("cell").join(own, "cell", "left").select("cell", F.coalesce("members", F.lit(0)).cast("long").alias("members"))

    def placed(at: DataFrame, values: DataFrame) -> DataFrame:
        return at.join(values.where("members > 0").withColumnRenamed("cell", "child"), "child").select(F.col("parent").alias("cell"), (F.col("k") * F.col("members")).alias("members"))

    return folded(reps, every, tall, placed, lambda rows: rows.groupBy("cell").agg(F.sum("members").cast("long").alias("members")))


def q_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check with the source layers that its operands derive from, and names that lead nowhere."""
    roots = run(spark, sf_dir, "SELECT check_name AS root, operand AS name FROM deck_check_operands")
    edges = run(spark, sf_dir, "SELECT name, operand FROM deck_derived")
    layers = run(spark, sf_dir, "SELECT name, spec FROM deck_layers")
    found = closure(roots, edges)
    ends = found.join(edges.select("name").distinct(), "name", "left_anti")
    return ends.join(layers, "name", "left").select("root", "name", F.coalesce(F.col("spec"), F.lit(-1).cast("long")).alias("spec"))


CLOSURE_SQL = """WITH RECURSIVE walk(root, name) AS (SELECT check_name, operand FROM deck_check_operands UNION SELECT w.root, d.operand FROM walk w JOIN deck_derived d ON d.name = w.name)
SELECT w.root, w.name, coalesce(l.spec, CAST(-1 AS BIGINT)) AS spec FROM walk w LEFT JOIN deck_layers l ON l.name = w.name WHERE w.name NOT IN (SELECT name FROM deck_derived)"""


def q_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    tall = heights(run(spark, sf_dir, "SELECT parent, child FROM deep_place"))
    return tall.groupBy("height").agg(F.count("*").alias("cells"))


HEIGHTS_SQL = """WITH RECURSIVE up(cell, h) AS (SELECT DISTINCT child, 0 FROM deep_place WHERE child NOT IN (SELECT parent FROM deep_place) UNION SELECT d.parent, u.h + 1 FROM up u JOIN deep_place d ON d.child = u.cell)
SELECT height, count(*) AS cells FROM (SELECT cell, max(h) AS height FROM up GROUP BY cell) q GROUP BY height"""


def q_recursive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of every cell."""
    places = run(spark, sf_dir, "SELECT parent, child, na, nb FROM deep_place")
    own = run(spark, sf_dir, "SELECT cell, count(*) AS members FROM deep_rect GROUP BY cell")
    return recursive_members(places, own, heights(places)).select("cell", "members")


_L = 100_000_000_000


def _level(n: int, below: str) -> str:
    return f"SELECT d.parent AS cell, sum(d.na * d.nb * b.members) AS members FROM deep_place d JOIN ({below}) b ON b.cell = d.child WHERE d.parent >= {n * _L} AND d.parent < {(n + 1) * _L} GROUP BY d.parent"


_NAMES = ("parts", "orders_", "customers_", "nations_", "regions_", "root_")
_STEPS = ["parts AS (SELECT c.child AS cell, count(r.cell) AS members FROM (SELECT DISTINCT child FROM deep_place) c LEFT JOIN deep_rect r ON r.cell = c.child WHERE c.child NOT IN (SELECT parent FROM deep_place) GROUP BY c.child)"]
_STEPS += [f"{_NAMES[i]} AS ({_level(5 - i, f'SELECT cell, members FROM {_NAMES[i - 1]}')})" for i in range(1, 6)]
#: Leaves on the way up (a customer without orders) have no members of their own or below.
MEMBERS_SQL = "WITH " + ", ".join(_STEPS) + " SELECT cell, CAST(sum(members) AS BIGINT) AS members FROM (" + " UNION ALL ".join(f"SELECT cell, members FROM {n}" for n in _NAMES) + ") q GROUP BY cell"
