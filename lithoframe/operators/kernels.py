"""Geometry that SQL has no operator for: polygon clips, path outlines, and index ranges of slanted repetitions.

Clips and outlines work on lists of corners in Arrow batches; index ranges are column expressions on exact decimals.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<struct<x:bigint,y:bigint>>"


def _toward_zero(a: int, b: int) -> int:
    q = abs(a) // abs(b)
    return q if (a < 0) == (b < 0) else -q


def clip_polygon(pts: list[tuple[int, int]], box: tuple[int, int, int, int]) -> list[tuple[int, int]]:
    """pts inside the box, cut at the left, bottom, right and top; crossings truncate toward zero. Fewer than 3 corners: nothing."""
    x0, y0, x1, y1 = box
    for axis, at, sign in ((0, x0, 1), (1, y0, 1), (0, x1, -1), (1, y1, -1)):
        cut: list[tuple[int, int]] = []
        for a, b in zip(pts[-1:] + pts[:-1], pts, strict=True):
            in_a, in_b = (a[axis] - at) * sign >= 0, (b[axis] - at) * sign >= 0
            if in_a != in_b:
                across = a[1 - axis] + _toward_zero((b[1 - axis] - a[1 - axis]) * (at - a[axis]), b[axis] - a[axis])
                cut.append((at, across) if axis == 0 else (across, at))
            if in_b:
                cut.append(b)
        pts = [p for i, p in enumerate(cut) if p != cut[i - 1] or len(cut) == 1]
        if len(pts) < 3:
            return []
    return pts


def outline(pts: list[tuple[int, int]], hw: int, es: int, ee: int) -> list[tuple[int, int]] | None:
    """Corners of an axis-parallel path with square joins; None if it has a slanted step, a U-turn or no length."""
    spine: list[tuple[int, int]] = []
    steps: list[tuple[int, int]] = []
    for p in pts:
        if not spine:
            spine.append(p)
            continue
        dx, dy = p[0] - spine[-1][0], p[1] - spine[-1][1]
        if not (dx or dy):
            continue
        if dx and dy:
            return None
        way = ((dx > 0) - (dx < 0), (dy > 0) - (dy < 0))
        if steps and way == steps[-1]:
            spine[-1] = p
            continue
        if steps and way == (-steps[-1][0], -steps[-1][1]):
            return None
        spine.append(p)
        steps.append(way)
    if not steps:
        return None
    (sx, sy), (tx, ty) = steps[0], steps[-1]
    spine[0] = (spine[0][0] - sx * es, spine[0][1] - sy * es)
    spine[-1] = (spine[-1][0] + tx * ee, spine[-1][1] + ty * ee)
    left, right = [], []
    for i, (x, y) in enumerate(spine):
        around = {steps[j] for j in (i - 1, i) if 0 <= j < len(steps)}
        nx, ny = sum(-d[1] for d in around), sum(d[0] for d in around)
        left.append((x + nx * hw, y + ny * hw))
        right.append((x - nx * hw, y - ny * hw))
    return left + right[::-1]


def path_box(pts: list[tuple[int, int]], hw: int, es: int, ee: int) -> tuple[int, int, int, int] | None:
    """Box of the outline; where there is none, the corners' box grown by half-width and the longer extension."""
    if not pts:
        return None
    found = outline(pts, hw, es, ee)
    grow = 0 if found else hw + max(es, ee, 0)
    xs, ys = zip(*(found or pts), strict=True)
    return min(xs) - grow, min(ys) - grow, max(xs) + grow, max(ys) + grow


def _plain(pts) -> list[tuple[int, int]]:
    return [(int(p["x"]), int(p["y"])) for p in pts]


def _struct(pts):
    return None if pts is None else [{"x": x, "y": y} for x, y in pts]


def clipped(pts: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Corners of the polygon inside the box; empty if they do not meet, null if anything is null."""

    @F.pandas_udf(POINTS)
    def run(p: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([None if q is None or any(v != v for v in box) else _struct(clip_polygon(_plain(q), tuple(int(v) for v in box))) for q, *box in zip(p, a, b, c, d, strict=True)], dtype=object)

    return run(pts, x0, y0, x1, y1)


def outlined(pts: Column, hw: Column, es: Column, ee: Column) -> Column:
    """Corners of the path's outline, null where it has none."""

    @F.pandas_udf(POINTS)
    def run(p: pd.Series, w: pd.Series, s: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([None if q is None or any(v != v for v in r) else _struct(outline(_plain(q), *(int(v) for v in r))) for q, *r in zip(p, w, s, e, strict=True)], dtype=object)

    return run(pts, hw, es, ee)


def _floor(a: Column, b: Column) -> Column:
    """Exact floor of a / b for decimals, b not zero."""
    a, b = F.when(b < 0, -a).otherwise(a), F.abs(b)
    return F.call_function("div", a - F.pmod(a, b), b)


def index_ranges(na: Column, nb: Column, vax: Column, vay: Column, vbx: Column, vby: Column, box: tuple[Column, Column, Column, Column]) -> Column:
    """Struct (i0, i1, j0, j1) of members i * va + j * vb that can lie in the closed box; i0 > i1 or j0 > j1 if none can.

    With independent vectors the box's corners are solved for i and j, so every member inside is in the ranges; with
    one index the range is exact; with parallel vectors the range is whole. Members still need the test by box.
    """
    big = [c.cast("decimal(18,0)") for c in (vax, vay, vbx, vby, *box)]
    ax, ay, bx, by, x0, y0, x1, y1 = big
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    det = ax * by - ay * bx
    safe = F.when(det == 0, F.lit(1).cast("decimal(38,0)")).otherwise(det)
    corners = [(x, y) for x in (x0, x1) for y in (y0, y1)]

    def span(values: list[Column], n: Column) -> tuple[Column, Column]:
        least = F.least(*(-_floor(-v, safe) for v in values))
        most = F.greatest(*(_floor(v, safe) for v in values))
        return F.greatest(zero, least), F.least(n.cast("long") - one, most)

    def line(dx: Column, dy: Column, n: Column) -> tuple[Column, Column]:
        """Multiples of one vector in the box."""
        lo, hi = [zero], [n.cast("long") - one]
        for d, low, high in ((dx, x0, x1), (dy, y0, y1)):
            step = F.when(d == 0, F.lit(1).cast("decimal(18,0)")).otherwise(d)
            near, far = F.when(d > 0, low).otherwise(high), F.when(d > 0, high).otherwise(low)
            inside = (low <= 0) & (high >= 0)
            lo.append(F.when(d == 0, F.when(inside, zero).otherwise(one)).otherwise(-_floor(-near, step)))
            hi.append(F.when(d == 0, F.when(inside, n.cast("long") - one).otherwise(zero)).otherwise(_floor(far, step)))
        return F.greatest(*lo), F.least(*hi)

    i, j = span([x * by - y * bx for x, y in corners], na), span([ax * y - ay * x for x, y in corners], nb)
    li, lj = line(ax, ay, na), line(bx, by, nb)

    def ranges(i0, i1, j0, j1) -> Column:
        return F.struct(i0.alias("i0"), i1.alias("i1"), j0.alias("j0"), j1.alias("j1"))

    return (
        F.when(nb == 1, ranges(*li, zero, zero))
        .when(na == 1, ranges(zero, zero, *lj))
        .when(det == 0, ranges(zero, na.cast("long") - one, zero, nb.cast("long") - one))
        .otherwise(ranges(*i, *j))
    )
