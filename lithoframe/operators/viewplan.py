"""The plan of a view: which cells are drawn, through which local windows, down to a depth; and flattening by it.

The sweep goes down the hierarchy a level at a time. A level's rows are (cell, remaining depth, window in the cell's
own frame, instances): placements whose box misses the window are pruned before members are made, the others by
exact index ranges, and a child's window is the parent's turned into its frame and cut to its box. Instances that
see the same part of a cell are one row with a count, so a cell that is seen whole is one row however often it is
placed. Where no depth remains a child is a frame. Rounds are bounded by the depth; each is written to the shared
folder.

A view that misses the root's box has no rows; a cell without shapes below it has no box and is never seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.compiler import run
from .folds import BOXES_SQL, q_recursive_boxes
from .graph import checkpointed

BOX = ("x0", "y0", "x1", "y1")
#: The view of the queries: a window in the root's frame, and depths at which frames and shapes end.
VIEW, DEPTH, FULL = (0, 0, 2_500_000, 300_000), 3, 5

_STEP = """SELECT child AS cell, remaining - 1 AS remaining, greatest(cx0, least(lx0, lx1)) AS x0, greatest(cy0, least(ly0, ly1)) AS y0, least(cx1, greatest(lx0, lx1)) AS x1, least(cy1, greatest(ly0, ly1)) AS y1, k
FROM (SELECT m.*, co * (wx0 - ox) + si * (wy0 - oy) AS lx0, ff * (co * (wy0 - oy) - si * (wx0 - ox)) AS ly0, co * (wx1 - ox) + si * (wy1 - oy) AS lx1, ff * (co * (wy1 - oy) - si * (wx1 - ox)) AS ly1
  FROM (SELECT r.*, i, j, px + i * vax AS ox, py + j * vby AS oy
    FROM (SELECT * FROM (SELECT b.*, CASE WHEN na > 1 AND vax > 0 THEN greatest(CAST(0 AS BIGINT), ceil_((wx0 - bx1), vax)) ELSE CAST(0 AS BIGINT) END AS i0, CASE WHEN na > 1 AND vax > 0 THEN least(na - 1, floor_((wx1 - bx0), vax)) ELSE na - 1 END AS i1,
                 CASE WHEN nb > 1 AND vby > 0 THEN greatest(CAST(0 AS BIGINT), ceil_((wy0 - by1), vby)) ELSE CAST(0 AS BIGINT) END AS j0, CASE WHEN nb > 1 AND vby > 0 THEN least(nb - 1, floor_((wy1 - by0), vby)) ELSE nb - 1 END AS j1
          FROM (SELECT t.*, px + least(ax, bx) AS bx0, px + greatest(ax, bx) AS bx1, py + least(ay, b_y) AS by0, py + greatest(ay, b_y) AS by1
            FROM (SELECT d.*, c.x0 AS cx0, c.y0 AS cy0, c.x1 AS cx1, c.y1 AS cy1, co * c.x0 - si * ff * c.y0 AS ax, si * c.x0 + co * ff * c.y0 AS ay, co * c.x1 - si * ff * c.y1 AS bx, si * c.x1 + co * ff * c.y1 AS b_y
              FROM (SELECT *, CASE rot WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS co, CASE rot WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS si, CASE flip WHEN 1 THEN -1 ELSE 1 END AS ff FROM {m}) d JOIN {c} c ON c.cell = d.child) t) b
          WHERE bx0 <= wx1 AND by0 <= wy1 AND bx1 + greatest(CAST(0 AS BIGINT), (na - 1) * vax) >= wx0 AND by1 + greatest(CAST(0 AS BIGINT), (nb - 1) * vby) >= wy0) s WHERE i0 <= i1 AND j0 <= j1) r
      LATERAL VIEW explode(sequence(i0, i1)) gi AS i LATERAL VIEW explode(sequence(j0, j1)) gj AS j) m
  WHERE bx0 + i * vax <= wx1 AND bx1 + i * vax >= wx0 AND by0 + j * vby <= wy1 AND by1 + j * vby >= wy0) l"""


def _integer_division(text: str) -> str:
    """floor_((a), b) and ceil_((a), b) for positive b, exact on 64 bits."""
    import re

    text = re.sub(r"floor_\(\(([^()]*)\), (\w+)\)", r"(((\1) - pmod((\1), \2)) DIV \2)", text)
    return re.sub(r"ceil_\(\(([^()]*)\), (\w+)\)", r"(((\1) + pmod(-(\1), \2)) DIV \2)", text)


def view_plan(places: DataFrame, boxes: DataFrame, root: int, window: tuple[int, int, int, int], depth: int) -> DataFrame:
    """(cell, remaining, x0, y0, x1, y1, instances); remaining -1: a frame of the child's box at the depth's end."""
    spark = places.sparkSession
    step = _integer_division(_STEP)
    here = [f(F.lit(v).cast("long"), F.col(c)).alias(c) for f, v, c in zip((F.greatest, F.greatest, F.least, F.least), window, BOX, strict=True)]
    level = boxes.where(F.col("cell") == root).select("cell", F.lit(depth).alias("remaining"), *here, F.lit(1).cast("long").alias("k")).where("x0 <= x1 AND y0 <= y1")
    level = out = checkpointed(level)
    for _ in range(depth + 1):
        # stored by itself, so that few placements meet the boxes by broadcast
        placed = checkpointed(level.select(F.col("cell").alias("parent"), "remaining", *(F.col(c).alias(f"w{c}") for c in BOX), "k").join(places, "parent"))
        below = spark.sql(step, m=placed, c=boxes)
        level = checkpointed(below.groupBy("cell", "remaining", *BOX).agg(F.sum("k").cast("long").alias("k")))
        if not level.limit(1).count():
            break
        out = out.unionByName(level)
    return out.withColumnRenamed("k", "instances")


def flattened(plan: DataFrame, shapes: DataFrame) -> DataFrame:
    """(layer, members, area) of shapes (cell, layer, x, y, w, h) that meet a plan's windows; repetitions stay counts."""
    met = plan.where("remaining >= 0").withColumnRenamed("cell", "at").join(shapes, F.col("at") == F.col("cell"))
    met = met.where("x <= x1 AND x + w >= x0 AND y <= y1 AND y + h >= y0")
    return met.groupBy("layer").agg(F.sum("instances").cast("long").alias("members"), F.sum(F.col("instances") * F.col("w") * F.col("h")).cast("long").alias("area"))


def _plan(spark: SparkSession, sf_dir: str, depth: int) -> tuple[DataFrame, DataFrame]:
    """The plan, and the boxes that it was made by."""
    places = run(spark, sf_dir, "SELECT parent, child, px, py, rot, flip, na, nb, vax, vby FROM deep_place")
    boxes = q_recursive_boxes(spark, sf_dir)
    return view_plan(places, boxes, 0, VIEW, depth), boxes


def q_view_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells and windows of the view, and frames where its depth ends."""
    return _plan(spark, sf_dir, DEPTH)[0]


def q_view_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan's counters by remaining depth: windows, cells, instances, and how many see their cell whole."""
    plan, boxes = _plan(spark, sf_dir, DEPTH)
    seen = plan.join(boxes.select("cell", F.struct(*BOX).alias("whole")), "cell")
    whole = F.sum(F.when(F.struct(*BOX) == F.col("whole"), F.col("instances")).otherwise(0)).cast("long").alias("whole")
    return seen.groupBy("remaining").agg(F.count("*").alias("windows"), F.count_distinct("cell").alias("cells"), F.sum("instances").cast("long").alias("instances"), whole)


def q_flat_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members and area by layer in the view through every level."""
    return flattened(_plan(spark, sf_dir, FULL)[0], run(spark, sf_dir, "SELECT cell, layer, x, y, w, h FROM deep_rect"))


_CO, _SI, _FF = "CASE a.rot WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END", "CASE a.rot WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END", "CASE a.flip WHEN 1 THEN -1 ELSE 1 END"


def walk(depth: int) -> str:
    """Every instance of the view by its own transform in the root's frame, for the checking engine; names boxes, walk and seen."""
    x0, y0, x1, y1 = VIEW
    corner = lambda n, x, y: f"a.ox + ({_CO}) * {x} - ({_SI}) * ({_FF}) * {y} AS {n}x, a.oy + ({_SI}) * {x} + ({_CO}) * ({_FF}) * {y} AS {n}y"
    local = lambda n, x, y: f"({_CO}) * ({x} - a.ox) + ({_SI}) * ({y} - a.oy) AS {n}x, ({_FF}) * (({_CO}) * ({y} - a.oy) - ({_SI}) * ({x} - a.ox)) AS {n}y"
    move = f"a.ox + ({_CO}) * (d.px + gi.i * d.vax) - ({_SI}) * ({_FF}) * (d.py + gj.j * d.vby) AS ox, a.oy + ({_SI}) * (d.px + gi.i * d.vax) + ({_CO}) * ({_FF}) * (d.py + gj.j * d.vby) AS oy"
    meets = f"least(px, qx) <= {x1} AND greatest(px, qx) >= {x0} AND least(py, qy) <= {y1} AND greatest(py, qy) >= {y0}"
    boxed = lambda rows: f"SELECT * FROM (SELECT a.*, c.x0, c.y0, c.x1, c.y1, {corner('p', 'c.x0', 'c.y0')}, {corner('q', 'c.x1', 'c.y1')} FROM ({rows}) a JOIN boxes c ON c.cell = a.cell) b WHERE {meets}"
    below = f"SELECT d.child AS cell, a.remaining - 1 AS remaining, {move}, (a.rot + CASE a.flip WHEN 1 THEN 4 - d.rot ELSE d.rot END) % 4 AS rot, (a.flip + d.flip) % 2 AS flip FROM walk a JOIN deep_place d ON d.parent = a.cell, @series(gi, i, d.na), @series(gj, j, d.nb) WHERE a.remaining >= 0"
    start = f"SELECT CAST(0 AS BIGINT) AS cell, {depth} AS remaining, CAST(0 AS BIGINT) AS ox, CAST(0 AS BIGINT) AS oy, 0 AS rot, 0 AS flip"
    keep = "cell, remaining, ox, oy, rot, flip"
    return f"""WITH RECURSIVE boxes AS ({BOXES_SQL}), walk AS (SELECT {keep} FROM ({boxed(start)}) s UNION ALL SELECT {keep} FROM ({boxed(below)}) t),
seen AS (SELECT cell, remaining, greatest(x0, least(ux, vx)) AS x0, greatest(y0, least(uy, vy)) AS y0, least(x1, greatest(ux, vx)) AS x1, least(y1, greatest(uy, vy)) AS y1
  FROM (SELECT a.cell, a.remaining, c.x0, c.y0, c.x1, c.y1, {local('u', x0, y0)}, {local('v', x1, y1)} FROM walk a JOIN boxes c ON c.cell = a.cell) l)"""


PLAN_SQL = walk(DEPTH) + " SELECT cell, remaining, x0, y0, x1, y1, count(*) AS instances FROM seen GROUP BY cell, remaining, x0, y0, x1, y1"
COUNTERS_SQL = walk(DEPTH) + """ SELECT remaining, count(DISTINCT (s.cell, s.x0, s.y0, s.x1, s.y1)) AS windows, count(DISTINCT s.cell) AS cells, count(*) AS instances,
 CAST(sum(CASE WHEN s.x0 = b.x0 AND s.y0 = b.y0 AND s.x1 = b.x1 AND s.y1 = b.y1 THEN 1 ELSE 0 END) AS BIGINT) AS whole FROM seen s JOIN boxes b ON b.cell = s.cell GROUP BY remaining"""
FLAT_SQL = walk(FULL) + """ SELECT r.layer, count(*) AS members, CAST(sum(r.w * r.h) AS BIGINT) AS area FROM seen s JOIN deep_rect r ON r.cell = s.cell AND r.x <= s.x1 AND r.x + r.w >= s.x0 AND r.y <= s.y1 AND r.y + r.h >= s.y0
 WHERE s.remaining >= 0 GROUP BY r.layer"""
