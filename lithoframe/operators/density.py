"""Density of the placement hierarchy by depth, and Z-order keys.

Levels are walked top down by a loop of joins. A level holds one row per distinct cell with its multiplicity, so
repeated placements never expand. Each level is written to the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.compiler import run
from .graph import checkpointed

#: Deeper levels count here.
FOLD = 12


def levels(places: DataFrame, root: int, most: int = 64) -> DataFrame:
    """(cell, depth, mult): how often each cell is met at each depth below root; deeper than `most` is an error."""
    reps = checkpointed(places.groupBy("parent", "child").agg(F.sum(F.col("na") * F.col("nb")).alias("k")))
    front = places.sparkSession.createDataFrame([(root, 0, 1)], "cell long, depth int, mult long")
    found = [front]
    for depth in range(1, most + 1):
        below = front.select(F.col("cell").alias("parent"), "mult").join(reps, "parent")
        front = checkpointed(below.groupBy(F.col("child").alias("cell")).agg(F.lit(depth).alias("depth"), F.sum(F.col("mult") * F.col("k")).cast("long").alias("mult")))
        if not front.limit(1).count():
            return reduce(DataFrame.unionByName, found)
        found.append(front)
    raise ValueError("the hierarchy has a cycle or is deeper than the limit")


def density(met: DataFrame, own: DataFrame) -> DataFrame:
    """(layer, depth, members): members of a layer down to each depth, from levels() and own (cell, layer, members)."""
    by = met.join(own, "cell").groupBy("layer", F.least("depth", F.lit(FOLD)).alias("depth")).agg(F.sum(F.col("mult") * F.col("members")).alias("n"))
    return by.select("layer", "depth", F.sum("n").over(Window.partitionBy("layer").orderBy("depth")).cast("long").alias("members"))


def q_density_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = run(spark, sf_dir, "SELECT cell, layer, count(*) AS members FROM deep_rect GROUP BY cell, layer")
    return density(levels(run(spark, sf_dir, "SELECT parent, child, na, nb FROM deep_place"), 0), own)


def q_density_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = levels(run(spark, sf_dir, "SELECT parent, child, na, nb FROM deep_place"), 0)
    return met.groupBy(F.least("depth", F.lit(FOLD)).alias("depth")).agg(F.count_distinct("cell").alias("cells"), F.sum("mult").cast("long").alias("instances"))


_WALK = "WITH RECURSIVE walk(cell, depth, mult) AS (SELECT CAST(0 AS BIGINT), 0, CAST(1 AS BIGINT) UNION ALL SELECT d.child, w.depth + 1, CAST(w.mult * d.na * d.nb AS BIGINT) FROM walk w JOIN deep_place d ON d.parent = w.cell)\n"
MEMBERS_SQL = _WALK + f"""SELECT layer, depth, CAST(sum(n) OVER (PARTITION BY layer ORDER BY depth) AS BIGINT) AS members
FROM (SELECT r.layer, least(w.depth, {FOLD}) AS depth, sum(w.mult) AS n FROM walk w JOIN deep_rect r ON r.cell = w.cell GROUP BY r.layer, least(w.depth, {FOLD})) q"""
INSTANCES_SQL = _WALK + f"SELECT least(depth, {FOLD}) AS depth, count(DISTINCT cell) AS cells, CAST(sum(mult) AS BIGINT) AS instances FROM walk GROUP BY least(depth, {FOLD})"


def _spread(rows: str) -> str:
    """rows with the bits of x and y (below 2^32) moved apart, a step for each power of two."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        rows = f"SELECT event_id, ((x | (x << {shift})) & {mask}) AS x, ((y | (y << {shift})) & {mask}) AS y FROM ({rows}) s{shift}"
    return rows


_KEYS = f"SELECT event_id, (x | (y << 1)) AS zkey FROM ({_spread('SELECT event_id, CAST(x0 AS BIGINT) AS x, CAST(y0 AS BIGINT) AS y FROM drc_raw')}) z"
Q = {
    "morton_key": _KEYS,
    # tiles are the leading bits of the key; counts combine before the shuffle
    "morton_tiles": f"SELECT (zkey >> 24) AS tile, count(*) AS n, min(zkey) AS first_key, max(zkey) AS last_key FROM ({_KEYS}) k GROUP BY (zkey >> 24)",
}
