"""Connected components by alternating large and small stars, as joins; nothing is gathered on the driver.

Between the joins every task contracts the edges that it reads by itself (union-find over at most CHUNK edges at a
time): that keeps what is connected, shortens paths and needs no shuffle, so few rounds of joins remain.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Edges that a task contracts at a time.
CHUNK = 100_000


def _contract(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Stars to the least node of what the edges of a chunk connect."""
    up: dict[int, int] = {}
    held = 0

    def find(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(y, y)
        return x

    def stars() -> pa.RecordBatch:
        u = [x for x in up if find(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array([find(x) for x in u], pa.int64())], ["u", "v"])

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            up[max(x, y)] = min(x, y)
        held += batch.num_rows
        if held >= chunk:
            yield stars()
            up.clear()
            held = 0
    if up:
        yield stars()


def _contracted(edges: DataFrame, chunk: int) -> DataFrame:
    """Stored edges, contracted by tasks of about so many edges each."""
    return edges.coalesce(max(1, -(-edges.count() // chunk))).mapInArrow(lambda it: _contract(it, chunk), "u long, v long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u > v. Large: neighbours above a node go to its least neighbour; small: those below do."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.where("u > v").groupBy("u", "v").agg(F.lit(1).alias("one")).select("u", "v")
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u > v").groupBy("u", "v").agg(F.lit(1).alias("one")).select("u", "v")


def _stars_only(edges: DataFrame) -> bool:
    """Whether every node below another has no other neighbour (edges may repeat): then all are leaves of roots."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    node = both.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return not node.where("low < u AND high <> low").limit(1).count()


def components(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(node, component): the least node of each component, for every node of edges (u, v)."""
    now = stored(_contracted(stored(edges.where("u <> v").select("u", "v")), chunk))
    while not _stars_only(now):
        now = stored(_contracted(stored(_star(_star(now, True), False)), chunk))
    leaves = now.groupBy("u", "v").agg(F.lit(1).alias("one")).select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
