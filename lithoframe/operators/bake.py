"""Tables that an index holds: mip levels, pages and texts in Morton order, compacted repetitions, box sets, listings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.compiler import run
from .density import _spread
from .folds import find_grids
from .graph import checkpointed
from .sqlset import TEX
from .sqlset import Q as _PLAIN

#: Singles of one child and orientation in a cell from which they are searched for grids.
LEAST_SINGLES = 500
#: Boxes that a set keeps; members of a page; mip levels stop when both axes are this short.
BOXES, PAGE_MEMBERS, SHORT = 4, 64, 8


# --- mip levels


def mip_levels(texels: DataFrame, rx: int, ry: int) -> DataFrame:
    """(level, layer, cx, cy, v): texels (layer, cx, cy, covered) and means of two by two, as bytes; empty texels have no row.

    Covered areas are summed as whole numbers, level by level, and divided once, so no level rounds another's
    rounding. An odd last row or column has no place in the level above; an axis of one texel stays.
    """
    level, out, k = checkpointed(texels.where(f"cx >= 0 AND cy >= 0 AND cx < {rx} AND cy < {ry}").select("layer", "cx", "cy", F.col("covered").cast("long").alias("s"))), [], 0
    share = 1  # texels of the first level in one
    while True:
        whole = share * TEX * TEX
        v = F.least(F.lit(255), F.call_function("div", F.col("s") * 510 + whole, F.lit(2 * whole)))
        out.append(level.select(F.lit(k).alias("level"), "layer", "cx", "cy", v.cast("int").alias("v")))
        if rx <= SHORT and ry <= SHORT:
            break
        nx, ny = max(1, rx // 2), max(1, ry // 2)
        half = lambda c, n, m: F.call_function("div", F.col(c), F.lit(2)).cast("long").alias(c) if n > 1 else F.col(c)
        inside = level.where(f"cx < {2 * nx if rx > 1 else 1} AND cy < {2 * ny if ry > 1 else 1}")
        level = checkpointed(inside.groupBy("layer", half("cx", rx, nx), half("cy", ry, ny)).agg(F.sum("s").alias("s")))
        share *= (2 if rx > 1 else 1) * (2 if ry > 1 else 1)
        rx, ry, k = nx, ny, k + 1
    found = out[0]
    for o in out[1:]:
        found = found.unionByName(o)
    return found


MIP_X, MIP_Y = 75, 18


def q_coverage_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mip level of the coverage."""
    return mip_levels(run(spark, sf_dir, _PLAIN["coverage_raster"]), MIP_X, MIP_Y)


def _mip_sql() -> str:
    """Each level straight from the texels, by the block of texels that it stands for."""
    parts, rx, ry, k = [], MIP_X, MIP_Y, 0
    while True:
        n = 1 << k
        whole = n * n * TEX * TEX
        parts.append(f"SELECT {k} AS level, layer, cx DIV {n} AS cx, cy DIV {n} AS cy, CAST(least(255, floor(CAST(sum(covered) AS DOUBLE) / {whole} * 255 + 0.5)) AS INT) AS v FROM base WHERE cx >= 0 AND cy >= 0 AND cx < {rx * n} AND cy < {ry * n} GROUP BY layer, cx DIV {n}, cy DIV {n}")
        if rx <= SHORT and ry <= SHORT:
            return f"WITH base AS ({_PLAIN['coverage_raster']}) " + " UNION ALL ".join(parts)
        rx, ry, k = max(1, rx // 2), max(1, ry // 2), k + 1


MIP_SQL = _mip_sql()

# --- Morton order: pages of shapes, index of texts

_TEXT_KEYS = f"SELECT event_id AS id, (x | (y << 1)) AS zkey FROM ({_spread('SELECT cell AS event_id, x, y FROM lay_text')}) z"
Q = {
    # texts of a cell and layer in Morton order of their place, equal places by source
    "text_index": f"SELECT t.cell, t.layer, t.s, k.zkey, row_number() OVER (PARTITION BY t.cell, t.layer ORDER BY k.zkey, t.s) - 1 AS pos FROM lay_text t JOIN ({_TEXT_KEYS}) k ON k.id = t.cell",
    # pages of at most so many violations, each within one square of the leading bits, in Morton order inside it
    "page_split": f"""SELECT square, page, count(*) AS members, min(zkey) AS first_key, max(zkey) AS last_key FROM (SELECT zkey >> 32 AS square, zkey, (row_number() OVER (PARTITION BY zkey >> 32 ORDER BY zkey, event_id) - 1) DIV {PAGE_MEMBERS} AS page
  FROM (SELECT event_id, (x | (y << 1)) AS zkey FROM ({_spread('SELECT event_id, CAST(x0 AS BIGINT) AS x, CAST(y0 AS BIGINT) AS y FROM drc_raw')}) z) k) p GROUP BY square, page""",
}

# --- compaction of placements


def compacted(places: DataFrame, least: int = LEAST_SINGLES) -> DataFrame:
    """places (parent, child, px, py, rot, flip, na, nb, vax, vby) with the singles of large groups gathered in grids.

    A group is the singles of one child and orientation in a parent. Members are conserved: repetitions and small
    groups stay as they are, and points outside any grid stay singles.
    """
    group, names = ["parent", "child", "rot", "flip"], places.columns
    single = (F.col("na") == 1) & (F.col("nb") == 1)
    sized = places.where(single).groupBy(*group).count().where(F.col("count") >= least).drop("count")
    rest = places.where(~single).unionByName(places.where(single).join(sized, group, "left_anti").select(*names))
    found = find_grids(places.where(single).join(sized, group).select(*group, F.col("px").alias("x"), F.col("py").alias("y")), *group)
    grids = found.select(*group, F.col("x0").alias("px"), F.col("y0").alias("py"), F.col("nx").alias("na"), F.col("ny").alias("nb"), F.col("dx").alias("vax"), F.col("dy").alias("vby"))
    return rest.unionByName(grids.select(*names))


def q_compact_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placements of orders in customers' cells, gathered where eight or more singles of one orientation meet."""
    return compacted(run(spark, sf_dir, "SELECT 0 AS parent, child % 4 AS child, px, py, rot, flip, na, nb, vax, vby FROM deep_place WHERE na = 1 AND nb = 1"), 8)


# --- sets of at most BOXES boxes


def _area(b: tuple[int, int, int, int]) -> int:
    return (b[2] - b[0]) * (b[3] - b[1])


def _around(a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, int, int, int]:
    return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])


def box_set(boxes: list[tuple[int, int, int, int]], most: int = BOXES) -> list[tuple[int, int, int, int]]:
    """Boxes, in the order given, as at most `most` that cover them: held ones are left out, the pair that wastes least becomes one."""
    kept: list[tuple[int, int, int, int]] = []
    for new in boxes:
        if new[0] > new[2] or new[1] > new[3] or any(_around(b, new) == b for b in kept):
            continue
        kept = [b for b in kept if _around(b, new) != new] + [new]
        while len(kept) > most:
            pairs = ((_area(_around(a, b)) - _area(a) - _area(b), i, j) for j, b in enumerate(kept) for i, a in enumerate(kept[:j]))
            _, i, j = min(pairs)
            kept[i] = _around(kept[i], kept[j])
            del kept[j]
    return kept


def box_sets(rows: DataFrame, most: int = BOXES) -> DataFrame:
    """(key, ord, x0, y0, x1, y1) of rows (key, seq, x0, y0, x1, y1): one set a key. A set is small whatever its key holds, so keys are read in one sorted pass."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, []

        def rows_of() -> list[tuple]:
            return [(now, i, *b) for i, b in enumerate(kept)]

        for b in batches:
            out = []
            for key, *box in zip(*(b.column(c).to_pylist() for c in ("key", "x0", "y0", "x1", "y1")), strict=True):
                if key != now:
                    out += rows_of()
                    now, kept = key, []
                kept = box_set([*kept, tuple(box)], most)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 6)], ["key", "ord", "x0", "y0", "x1", "y1"])
        out = rows_of()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 6)], ["key", "ord", "x0", "y0", "x1", "y1"])

    dealt = rows.where("x0 <= x1 AND y0 <= y1").repartition("key").sortWithinPartitions("key", "seq")
    return dealt.mapInArrow(fold, "key long, ord long, x0 long, y0 long, x1 long, y1 long")


def q_box_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of each page's layer, as sets."""
    return box_sets(run(spark, sf_dir, "SELECT CAST(layer AS BIGINT) AS key, page AS seq, x0, y0, x1, y1 FROM pages_v"))


# --- hashes of numbers


def fnv1a(*values: Column) -> Column:
    """FNV-1a of 64 bits over the little-endian bytes of each value, as a signed number."""

    @F.pandas_udf("long")
    def run(*columns: pd.Series) -> pd.Series:
        h = np.full(len(columns[0]), 0xCBF29CE484222325, np.uint64)
        for c in columns:
            v = c.to_numpy(np.int64).view(np.uint64)
            for shift in range(0, 64, 8):
                h = (h ^ ((v >> np.uint64(shift)) & np.uint64(255))) * np.uint64(0x100000001B3)
        return pd.Series(h.view(np.int64))

    return run(*values)


def q_label_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash that orders labels of one bin, by cell, layer and place."""
    texts = run(spark, sf_dir, "SELECT cell, CAST(layer AS BIGINT) AS layer, x, y FROM lay_text")
    return texts.select("cell", fnv1a(F.col("cell"), F.col("layer"), F.col("x"), F.col("y")).alias("hash"))


_BYTES = [f"list_transform(range(8), lambda b: CAST(({c} >> (CAST(b AS INT) * 8)) & 255 AS UHUGEINT))" for c in ("cell", "layer", "x", "y")]
HASH_SQL = f"""SELECT cell, CAST(CASE WHEN h >= 9223372036854775808 THEN CAST(h AS HUGEINT) - 18446744073709551616 ELSE CAST(h AS HUGEINT) END AS BIGINT) AS hash FROM (
  SELECT cell, list_reduce(flatten([[CAST(14695981039346656037 AS UHUGEINT)], {', '.join(_BYTES)}]), lambda a, b: (xor(a, b) * 1099511628211) % 18446744073709551616) AS h FROM (SELECT cell, CAST(layer AS BIGINT) AS layer, x, y FROM lay_text) t) q"""

# --- listing of derivations


def listing(roots: DataFrame, derived: DataFrame, most: int = 6) -> DataFrame:
    """(root, pos, name, more): names that a check's operands derive from, breadth first, each once, `most` of them; more: 1 on the last line if others follow.

    roots (root, ord, name) and derived (name, ord, operand). Each round is a level; a name keeps its first place.
    """
    names = derived.select("name").distinct()
    seen = front = checkpointed(roots.join(names, "name").select("root", "name", F.array(F.col("ord").cast("int")).alias("place")).groupBy("root", "name").agg(F.min("place").alias("place")))
    for _ in range(most):  # a level has a new name at least, and `most` names are listed
        edges = derived.select("name", F.col("ord").cast("int").alias("o"), F.col("operand")).join(names.withColumnRenamed("name", "operand"), "operand")
        step = front.join(edges, "name").select("root", F.col("operand").alias("name"), F.concat("place", F.array("o")).alias("place")).groupBy("root", "name").agg(F.min("place").alias("place"))
        front = checkpointed(step.join(seen.select("root", "name"), ["root", "name"], "left_anti"))
        if not front.limit(1).count():
            break
        seen = checkpointed(seen.unionByName(front))
    from pyspark.sql.window import Window

    order = Window.partitionBy("root").orderBy(F.size("place"), "place")
    numbered = seen.select("root", "name", (F.row_number().over(order) - 1).alias("pos"), F.count("*").over(Window.partitionBy("root")).alias("n"))
    return numbered.where(F.col("pos") < most).select("root", "pos", "name", ((F.col("pos") == most - 1) & (F.col("n") > most)).cast("int").alias("more"))


LISTED = 3


def q_derivation_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(run(spark, sf_dir, "SELECT check_name AS root, ord, operand AS name FROM deck_check_operands"), run(spark, sf_dir, "SELECT name, ord, operand FROM deck_derived"), LISTED)


#: Every path of up to six steps, of which each name keeps the shortest and first.
LISTING_SQL = f"""WITH RECURSIVE walk(root, name, place) AS (SELECT check_name, operand, [ord] FROM deck_check_operands WHERE operand IN (SELECT name FROM deck_derived)
  UNION ALL SELECT w.root, d.operand, list_append(w.place, d.ord) FROM walk w JOIN deck_derived d ON d.name = w.name WHERE d.operand IN (SELECT name FROM deck_derived) AND len(w.place) < 7),
best AS (SELECT root, name, len(place) AS far, place, row_number() OVER (PARTITION BY root, name ORDER BY len(place), place) AS rn FROM walk),
lines AS (SELECT root, name, row_number() OVER (PARTITION BY root ORDER BY far, place) - 1 AS pos, count(*) OVER (PARTITION BY root) AS n FROM best WHERE rn = 1)
SELECT root, pos, name, CASE WHEN pos = {LISTED - 1} AND n > {LISTED} THEN 1 ELSE 0 END AS more FROM lines WHERE pos < {LISTED}"""
