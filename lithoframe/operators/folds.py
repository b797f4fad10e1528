"""Bottom-up folds of the placement hierarchy (boxes, areas), the depth cut, and grids found in point sets.

Folds go up by height, one join a level, each level written to the shared folder; a cell is folded once however
often it is placed. Cells without shapes below them have no row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.compiler import run
from .density import levels
from .graph import _L, folded, heights

#: Members of distinct cells that levels may hold before the depth cut.
LOD_MEMBERS = 50_000
#: A grid of fewer members stays points.
LEAST_GRID = 8

_TURNED = """SELECT {parent} AS cell, least(ax, bx) + least(CAST(0 AS BIGINT), (na - 1) * vax) AS x0, least(ay, b_y) + least(CAST(0 AS BIGINT), (nb - 1) * vby) AS y0,
       greatest(ax, bx) + greatest(CAST(0 AS BIGINT), (na - 1) * vax) AS x1, greatest(ay, b_y) + greatest(CAST(0 AS BIGINT), (nb - 1) * vby) AS y1
FROM (SELECT t.*, px + co * x0 - si * ff * y0 AS ax, py + si * x0 + co * ff * y0 AS ay, px + co * x1 - si * ff * y1 AS bx, py + si * x1 + co * ff * y1 AS b_y
      FROM (SELECT d.*, b.x0, b.y0, b.x1, b.y1, CASE rot WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS co, CASE rot WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS si, CASE flip WHEN 1 THEN -1 ELSE 1 END AS ff
            FROM {places} d JOIN {boxes} b ON b.cell = d.child) t) u"""


def recursive_boxes(places: DataFrame, own: DataFrame, tall: DataFrame) -> DataFrame:
    """(cell, x0, y0, x1, y1): own boxes (cell, x0, y0, x1, y1) and those of children, placed and repeated."""
    spark, box = places.sparkSession, [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]

    def placed(at: DataFrame, values: DataFrame) -> DataFrame:
        return spark.sql(_TURNED.format(parent="parent", places="{p}", boxes="{b}"), p=at, b=values)

    return folded(places, own.select("cell", "x0", "y0", "x1", "y1"), tall, placed, lambda rows: rows.groupBy("cell").agg(*box))


def recursive_area(places: DataFrame, own: DataFrame, tall: DataFrame) -> DataFrame:
    """(cell, layer, area): own (cell, layer, area) and repetitions times those of the children; overlaps count twice."""
    reps = places.select("parent", "child", (F.col("na") * F.col("nb")).alias("k"))

    def placed(at: DataFrame, values: DataFrame) -> DataFrame:
        return at.join(values.withColumnRenamed("cell", "child"), "child").select(F.col("parent").alias("cell"), "layer", (F.col("k") * F.col("area")).alias("area"))

    areas = own.select("cell", "layer", F.col("area").cast("double").alias("area"))
    return folded(reps, areas, tall, placed, lambda rows: rows.groupBy("cell", "layer").agg(F.sum("area").alias("area")))


def lod_cut(met: DataFrame, own: DataFrame, limit: int = LOD_MEMBERS) -> DataFrame:
    """(depth, members, running, kept): levels() by each cell's least depth; kept while all members so far fit the limit."""
    first = met.groupBy("cell").agg(F.min("depth").alias("depth"))
    level = first.join(own, "cell", "left").groupBy("depth").agg(F.coalesce(F.sum("members"), F.lit(0)).cast("long").alias("members"))
    # a row for each depth, at most 64
    running = F.sum("members").over(Window.orderBy("depth")).cast("long")
    return level.withColumn("running", running).withColumn("kept", (F.col("running") <= limit).cast("int"))


def runs_of(values: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(first, pitch, count, times) of sorted different values with how often each is met, from left to right.

    A run takes all that follow at its pitch. A value that its equal follows is a run of its own: of a value that is met
    n times the first can end a run, the last can begin one, and those between stand alone. Nothing is held but a run.
    """
    first = last = pitch = n = 0
    for v, times in values:
        if n and (n == 1 or v - last == pitch):
            pitch = v - last
            last, n, times = v, n + 1, times - 1
        if times:
            if n:
                yield first, pitch, n, 1
            if times > 1:
                yield v, 0, 1, times - 1
            first, last, pitch, n = v, v, 0, 1
    if n:
        yield first, pitch, n, 1


def pitch_runs(values: list[int]) -> list[tuple[int, int, int]]:
    """(first, pitch, count) of sorted values."""
    return [run[:3] for run in runs_of((v, len(list(same))) for v, same in groupby(values)) for _ in range(run[3])]


#: Rows of a batch that a pass of find_grids puts out.
OUT = 10_000


def find_grids(points: DataFrame, *keys: str) -> DataFrame:
    """keys, x0, y0, dx, nx, dy, ny: grids among the points (keys, x, y), and the rest as grids of one member.

    Columns of one x are cut to runs of constant pitch, then equal runs at a constant pitch of x are one grid. Equal
    points are counted before they are dealt, unless points come counted (times). Each pass deals rows by more than the keys (a column; a run's shape),
    sorts its partitions and reads them once; a task holds a run and a batch, whatever its group has. Repeated points
    stay points of their own.
    """
    import pyarrow as pa

    types = {f.name: f.dataType for f in points.schema}
    head = "".join(f"`{k}` {types[k].simpleString()}, " for k in keys)
    k = len(keys)

    def passed(emit, n_keys: int, names: list[str]):
        """Rows (n_keys of a group, value, times), sorted: emit(group, values with times) as batches."""

        def run(batches):
            like = []

            def rows():
                for b in batches:
                    like[:] = [b.schema.field(i).type for i in range(k)]
                    yield from zip(*(b.column(i).to_pylist() for i in range(n_keys + 2)), strict=True)

            def batch(out):
                kinds = [*like, *[pa.int64()] * (len(names) - k)]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

            out = []
            for group, members in groupby(rows(), lambda r: r[:n_keys]):
                for row in emit(group, (r[n_keys:] for r in members)):
                    out.append(row)
                    if len(out) >= OUT:
                        yield batch(out)
                        out = []
            if out:
                yield batch(out)

        return run

    def column(key, ys):
        return ((*key, y0, dy, n, times) for y0, dy, n, times in runs_of(ys))

    def fused(key, xs):
        *outer, y0, dy, ny = key
        # a point that its equal follows has a row for itself and one for the others
        for x0, dx, nx, times in runs_of((x, sum(t for _, t in same)) for x, same in groupby(xs, lambda r: r[0])):
            if ny > 1 and nx * ny >= LEAST_GRID:
                yield (*outer, x0, y0, dx, nx, dy, ny)
            else:
                yield from ((*outer, x0 + i * dx, y0 + j * dy, 0, 1, 0, 1) for _ in range(times) for i in range(nx) for j in range(ny))

    met = points.where("x IS NOT NULL AND y IS NOT NULL").select(*keys, F.col("x").cast("long"), F.col("y").cast("long"), *(["times"] if "times" in points.columns else []))
    if "times" not in points.columns:
        met = met.groupBy(*keys, "x", "y").agg(F.count("*").alias("times"))
    dealt = met.repartition(*keys, "x").sortWithinPartitions(*keys, "x", "y")
    runs = dealt.mapInArrow(passed(column, k + 1, [*keys, "x", "y0", "dy", "ny", "times"]), f"{head}x long, y0 long, dy long, ny long, times long")
    shape = runs.select(*keys, "y0", "dy", "ny", "x", "times").repartition(*keys, "y0", "dy", "ny").sortWithinPartitions(*keys, "y0", "dy", "ny", "x")
    return shape.mapInArrow(passed(fused, k + 3, [*keys, "x0", "y0", "dx", "nx", "dy", "ny"]), f"{head}x0 long, y0 long, dx long, nx long, dy long, ny long")


_PLACES = "SELECT parent, child, px, py, rot, flip, na, nb, vax, vby FROM deep_place"


def q_recursive_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of every cell."""
    places = run(spark, sf_dir, _PLACES)
    own = run(spark, sf_dir, "SELECT cell, x AS x0, y AS y0, x + w AS x1, y + h AS y1 FROM deep_rect")
    return recursive_boxes(places, own, heights(places))


def q_recursive_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of every cell by layer."""
    places = run(spark, sf_dir, _PLACES)
    own = run(spark, sf_dir, "SELECT cell, layer, w * h AS area FROM deep_rect")
    return recursive_area(places, own, heights(places)).select("cell", "layer", F.col("area").cast("long").alias("area"))


def q_lod_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = run(spark, sf_dir, "SELECT cell, count(*) AS members FROM deep_rect GROUP BY cell")
    return lod_cut(levels(run(spark, sf_dir, "SELECT parent, child, na, nb FROM deep_place"), 0), own)


def q_find_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids of placement origins by the cell placed and its orientation."""
    return find_grids(run(spark, sf_dir, "SELECT DISTINCT child, rot, flip, o.ox + px AS x, o.oy + py AS y, CAST(1 AS BIGINT) AS times FROM lay_cell_origin o JOIN lay_place p ON p.parent = o.cell"), "child", "rot", "flip")


def _boxes(level: int, below: str) -> str:
    placed = _TURNED.format(parent="parent", places=f"(SELECT * FROM deep_place WHERE parent >= {level * _L} AND parent < {(level + 1) * _L})", boxes=f"({below})")
    return f"SELECT cell, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM ({placed}) v GROUP BY cell"


def _areas(level: int, below: str) -> str:
    return f"SELECT d.parent AS cell, b.layer, sum(d.na * d.nb * b.area) AS area FROM deep_place d JOIN ({below}) b ON b.cell = d.child WHERE d.parent >= {level * _L} AND d.parent < {(level + 1) * _L} GROUP BY d.parent, b.layer"


_PLACED = "WHERE cell IN (SELECT child FROM deep_place)"


def all_levels(fold, leaves: str, columns: str) -> str:
    """The rows of every level: each a fold of the one below, named once."""
    names = ["parts", *("orders_", "customers_", "nations_", "regions_", "root_")]
    steps = [f"{names[0]} AS ({leaves})"] + [f"{names[i]} AS ({fold(5 - i, f'SELECT * FROM {names[i - 1]}')})" for i in range(1, 6)]
    return "WITH " + ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT {columns} FROM {n}" for n in names)


BOXES_SQL = all_levels(_boxes, f"SELECT cell, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1 FROM deep_rect {_PLACED} GROUP BY cell", "cell, x0, y0, x1, y1")
AREA_SQL = all_levels(_areas, f"SELECT cell, layer, sum(w * h) AS area FROM deep_rect {_PLACED} GROUP BY cell, layer", "cell, layer, CAST(area AS BIGINT) AS area")
LOD_SQL = f"""WITH RECURSIVE walk(cell, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT d.child, w.depth + 1 FROM walk w JOIN deep_place d ON d.parent = w.cell)
SELECT depth, members, running, CASE WHEN running <= {LOD_MEMBERS} THEN 1 ELSE 0 END AS kept FROM (SELECT depth, members, CAST(sum(members) OVER (ORDER BY depth) AS BIGINT) AS running
FROM (SELECT f.depth, CAST(coalesce(sum(r.members), 0) AS BIGINT) AS members FROM (SELECT cell, min(depth) AS depth FROM walk GROUP BY cell) f
LEFT JOIN (SELECT cell, count(*) AS members FROM deep_rect GROUP BY cell) r ON r.cell = f.cell GROUP BY f.depth) m) v"""
