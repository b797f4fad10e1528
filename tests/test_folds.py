"""Grids found in point sets, and folds over a small hierarchy by hand."""

from collections import Counter

from hypothesis import given
from hypothesis import strategies as st

from lithoframe.operators import folds
from lithoframe.operators.graph import heights


@given(st.lists(st.integers(-20, 20), max_size=30))
def test_pitch_runs_keep_every_value(values):
    values.sort()
    runs = folds.pitch_runs(values)
    assert sorted(a + i * d for a, d, n in runs for i in range(n)) == values
    assert all((n == 1) == (d == 0) for _, d, n in runs)
    assert folds.pitch_runs([1, 1, 3, 5, 7, 8, 20]) == [(1, 0, 1), (1, 2, 4), (8, 12, 2)]


def test_find_grids(spark):
    points = [(1, 10 * i, 7 * j) for i in range(4) for j in range(5)] + [(1, 1000, 3), (2, 5, 5), (2, 5, 5), (2, 9, 1)]
    df = spark.createDataFrame([*points, (3, None, 1)], "k long, x long, y long")
    got = folds.find_grids(df, "k").collect()
    assert Counter((r.k, r.x0 + i * r.dx, r.y0 + j * r.dy) for r in got for i in range(r.nx) for j in range(r.ny)) == Counter(points)
    assert [(r.x0, r.y0, r.dx, r.nx, r.dy, r.ny) for r in got if r.nx * r.ny > 1] == [(0, 0, 10, 4, 7, 5)]
    assert folds.find_grids(df.where("k = 9"), "k").count() == 0


def test_boxes_and_areas(spark):
    places = spark.createDataFrame(
        [(1, 2, 100, 0, 1, 0, 1, 1, 0, 0), (1, 2, 0, 50, 0, 1, 3, 2, 10, -20), (2, 3, 5, 5, 0, 0, 1, 1, 0, 0), (1, 4, 0, 0, 0, 0, 1, 1, 0, 0)],
        "parent long, child long, px long, py long, rot int, flip int, na long, nb long, vax long, vby long",
    )
    own = spark.createDataFrame([(3, 1, 0, 0, 10, 4), (2, 2, 0, 0, 1, 1)], "cell long, layer int, x0 long, y0 long, x1 long, y1 long")
    tall = heights(places.select("parent", "child"))
    boxes = {r.cell: (r.x0, r.y0, r.x1, r.y1) for r in folds.recursive_boxes(places, own.drop("layer"), tall).collect()}
    # cell 2: (0, 0)-(15, 9); turned by 90 degrees at (100, 0); mirrored at (0, 50), repeated by (10, -20)
    assert boxes == {3: (0, 0, 10, 4), 2: (0, 0, 15, 9), 1: (0, 0, 100, 50)}
    areas = {(r.cell, r.layer): r.area for r in folds.recursive_area(places, own.selectExpr("cell", "layer", "(x1 - x0) * (y1 - y0) AS area"), tall).collect()}
    assert areas == {(3, 1): 40, (2, 1): 40, (2, 2): 1, (1, 1): 280, (1, 2): 7}


def test_folds_return_every_cell(spark):
    from lithoframe.plans import registry
    from lithoframe.plans.compiler import run

    sf = "/root/testdata/sf0.001"
    members, area, box = Counter(), Counter(), {}

    def grow(cell, xs, ys):
        old = box.get(cell)
        xs, ys = (xs, ys) if old is None else ([*xs, old[0], old[2]], [*ys, old[1], old[3]])
        box[cell] = (min(xs), min(ys), max(xs), max(ys))

    for r in run(spark, sf, "SELECT cell, layer, x, y, w, h FROM deep_rect").collect():
        members[r.cell] += 1
        area[r.cell, r.layer] += r.w * r.h
        grow(r.cell, (r.x, r.x + r.w), (r.y, r.y + r.h))
    cells = set(members)
    layers = {k for _, k in area}
    # a cell's number grows with its level, so the parents of the deepest cells come first
    for p in sorted(run(spark, sf, "SELECT parent, child, px, py, rot, flip, na, nb, vax, vby FROM deep_place").collect(), key=lambda p: -p.parent):
        assert p.parent < p.child
        cells |= {p.parent, p.child}
        members[p.parent] += p.na * p.nb * members[p.child]
        for k in [k for k in layers if (p.child, k) in area]:
            area[p.parent, k] += p.na * p.nb * area[p.child, k]
        if p.child in box:
            x0, y0, x1, y1 = box[p.child]
            turn = (lambda x, y: (x, y), lambda x, y: (-y, x), lambda x, y: (-x, -y), lambda x, y: (y, -x))[p.rot]
            at = [turn(x, -y if p.flip else y) for x in (x0, x1) for y in (y0, y1)]
            steps = [(i * p.vax, j * p.vby) for i in (0, p.na - 1) for j in (0, p.nb - 1)]
            grow(p.parent, [p.px + x + dx for x, _ in at for dx, _ in steps], [p.py + y + dy for _, y in at for _, dy in steps])
    got = {n: registry.QUERIES[f"recursive_{n}"](spark, sf).collect() for n in ("members", "boxes", "area")}
    assert max(cells) > 3 * 100_000_000_000
    assert sorted(tuple(r) for r in got["members"]) == sorted((c, members[c]) for c in cells)
    assert sorted(tuple(r) for r in got["boxes"]) == sorted((c, *b) for c, b in box.items())
    assert sorted(tuple(r) for r in got["area"]) == sorted((c, k, a) for (c, k), a in area.items())


def test_folds_read_placements_twice_at_any_depth(spark):
    """A chain of six levels with a placement that skips some: F4, F8."""
    rows = [(i, i + 1, 10, 0, 0, 0, 2, 1, 100, 0) for i in range(6)] + [(0, 6, 5, 5, 0, 0, 1, 1, 0, 0), (2, 6, 0, 7, 0, 0, 1, 1, 0, 0)]
    names = "parent long, child long, px long, py long, rot int, flip int, na long, nb long, vax long, vby long"
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    places = spark.createDataFrame(rows, names)
    tall = heights(places.select("parent", "child"))
    assert {r.cell: r.height for r in tall.collect()} == {i: 6 - i for i in range(7)}
    own = spark.createDataFrame([(6, 1, 0, 0, 4, 3)], "cell long, layer int, x0 long, y0 long, x1 long, y1 long")
    boxes = {r.cell: (r.x0, r.y0, r.x1, r.y1) for r in folds.recursive_boxes(places.mapInArrow(counted, names), own.drop("layer"), tall).collect()}
    assert read.value == 2 * len(rows)
    assert boxes[6] == (0, 0, 4, 3) and boxes[5] == (10, 0, 114, 3) and boxes[2] == (0, 0, 444, 10) and boxes[0] == (5, 0, 664, 10)
    areas = {r.cell: r.area for r in folds.recursive_area(places, own.selectExpr("cell", "layer", "x1 * y1 AS area"), tall).collect()}
    assert areas == {6: 12, 5: 24, 4: 48, 3: 96, 2: 204, 1: 408, 0: 828}


def test_counters_make_boxes_once(spark, monkeypatch):
    """F3."""
    from lithoframe.operators import viewplan
    from lithoframe.plans import registry  # noqa: F401  the views

    made, boxes = [], viewplan.q_recursive_boxes
    monkeypatch.setattr(viewplan, "q_recursive_boxes", lambda *a: made.append(1) or boxes(*a))
    viewplan.q_view_counters(spark, "/root/testdata/sf0.001")
    assert len(made) == 1


def _runs_by_list(values):
    """The rule by a list of steps."""
    out, start = [], 0
    steps = [b - a for a, b in zip(values, values[1:], strict=False)]
    while start < len(values):
        end = start
        if start < len(steps) and steps[start]:
            while end < len(steps) and steps[end] == steps[start]:
                end += 1
        out.append((values[start], steps[start] if end > start else 0, end - start + 1))
        start = end + 1
    return out


@given(st.lists(st.integers(-9, 9), max_size=40))
def test_runs_of_counted_values(values):
    values.sort()
    assert folds.pitch_runs(values) == _runs_by_list(values)
    # values come one at a time: a run is out before the rest is read (F7)
    seen = []
    got = folds.runs_of((seen.append(v) or (v, 1)) for v in [0, 1, 2, 7, 9, 11, 50])
    assert next(got) == (0, 1, 3, 1) and seen == [0, 1, 2, 7]
