"""Clips, outlines and index ranges against brute force."""

import random

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lithoframe.operators.kernels import clip_polygon, clipped, index_ranges, outline, outlined, path_box


def area2(pts):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, pts[1:] + pts[:1], strict=True)))


@given(*[st.integers(-50, 50)] * 4, st.integers(1, 40), st.integers(1, 40), st.integers(1, 40), st.integers(1, 40))
def test_clip_of_a_rectangle_is_its_intersection(x, y, u, v, w, h, a, b):
    got = clip_polygon([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], (u, v, u + a, v + b))
    dx, dy = min(x + w, u + a) - max(x, u), min(y + h, v + b) - max(y, v)
    assert (area2(got) if got else 0) == (2 * dx * dy if dx > 0 and dy > 0 else 0)


def test_clip_truncates_toward_zero_and_keeps_what_is_inside():
    assert set(clip_polygon([(-3, -5), (4, 0), (-3, 5)], (0, -10, 10, 10))) == {(0, -3), (4, 0), (0, 2)}
    triangle = [(0, 0), (9, 1), (3, 7)]
    assert set(clip_polygon(triangle, (-9, -9, 99, 99))) == set(triangle)
    assert clip_polygon(triangle, (50, 50, 60, 60)) == []


def test_outline():
    assert set(outline([(0, 0), (10, 0)], 2, 1, 3)) == {(-1, 2), (13, 2), (13, -2), (-1, -2)}
    bend = outline([(0, 0), (4, 0), (4, 0), (10, 0), (10, 20)], 1, 0, 0)
    assert set(bend) == {(0, 1), (9, 1), (9, 20), (11, 20), (11, -1), (0, -1)}
    assert outline([(0, 0), (5, 5)], 1, 0, 0) is None and outline([(0, 0), (5, 0), (1, 0)], 1, 0, 0) is None and outline([(3, 3), (3, 3)], 1, 0, 0) is None
    assert path_box([(0, 0), (5, 5)], 2, 1, -1) == (-3, -3, 8, 8)


def test_columns(spark):
    row = spark.createDataFrame([([(0, 0), (10, 0), (10, 10), (0, 10)], 5), (None, 5)], "pts array<struct<x:bigint,y:bigint>>, c long")
    got = row.select(clipped(F.col("pts"), F.col("c"), F.col("c"), F.lit(50), F.lit(50)).alias("o"), outlined(F.col("pts"), F.lit(1), F.lit(0), F.lit(0)).alias("p")).collect()
    assert {(p.x, p.y) for p in got[0].o} == {(5, 5), (10, 5), (10, 10), (5, 10)} and got[1].o is None and len(got[0].p) == 8


def test_ranges_hold_every_member_in_the_box(spark):
    rng, rows = random.Random(3), []
    for k in range(400):
        v = [rng.randint(-9, 9) for _ in range(4)]
        x, y = rng.randint(-60, 60), rng.randint(-60, 60)
        rows.append((k, rng.choice([1, 1, 5, 8]), rng.choice([1, 4, 7]), *v, x, y, x + rng.randint(0, 40), y + rng.randint(0, 40)))
    df = spark.createDataFrame(rows, "k long, na long, nb long, vax long, vay long, vbx long, vby long, x0 long, y0 long, x1 long, y1 long")
    c = F.col
    got = {r.k: r.r for r in df.select("k", index_ranges(c("na"), c("nb"), c("vax"), c("vay"), c("vbx"), c("vby"), (c("x0"), c("y0"), c("x1"), c("y1"))).alias("r")).collect()}
    for k, na, nb, ax, ay, bx, by, x0, y0, x1, y1 in rows:
        r = got[k]
        for i in range(na):
            for j in range(nb):
                inside = x0 <= i * ax + j * bx <= x1 and y0 <= i * ay + j * by <= y1
                held = r.i0 <= i <= r.i1 and r.j0 <= j <= r.j1
                assert held or not inside
                assert inside or not held or (na > 1 and nb > 1)
