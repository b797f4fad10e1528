"""Window queries that keep repetitions compressed: index ranges come before members.

S[name] is the text that Spark runs in place of Q[name]; the plain text of Q[name], which makes every member
first, stays as its check. A member (i, j) of a repetition lies at its first box moved by i * vax and j * vby, so
those that meet a closed window are i0 to i1 and j0 to j1 exactly.
"""

from __future__ import annotations

from ..plans.compiler import view
from .sqlset import HIT, PX, PY, Q, R, W

S: dict[str, str] = {}

_X = "(p.co * {x} - p.si * p.ff * {y})"
_Y = "(p.si * {x} + p.co * p.ff * {y})"


def _box(axis: str, origin: str) -> str:
    a, b = axis.format(x="r.x", y="r.y"), axis.format(x="(r.x + r.w)", y="(r.y + r.h)")
    return f"{origin} + least({a}, {b}) AS b{{0}}0, {origin} + greatest({a}, {b}) AS b{{0}}1"


view(
    "rep_rect",
    f"""SELECT p.parent, r.cell, r.layer, r.dt, p.na, p.nb, p.vax, p.vby, {_box(_X, 'o.ox + p.px').format('x')}, {_box(_Y, 'o.oy + p.py').format('y')}
  FROM lay_cell_origin o JOIN lay_place p ON p.parent = o.cell JOIN lay_rect r ON r.cell = p.child""",
)


def hits(x0: int, y0: int, x1: int, y1: int) -> str:
    """Repetitions with the index ranges whose members meet the closed window."""
    return f"""SELECT * FROM (SELECT parent, cell, layer, dt, vax, vby, bx0, by0, bx1, by1, greatest(CAST(0 AS BIGINT), -@floor(bx1 - {x0}, vax)) AS i0, least(na - 1, @floor({x1} - bx0, vax)) AS i1,
  greatest(CAST(0 AS BIGINT), -@floor(by1 - {y0}, vby)) AS j0, least(nb - 1, @floor({y1} - by0, vby)) AS j1
  FROM rep_rect WHERE bx0 <= {x1} AND by0 <= {y1} AND bx1 + (na - 1) * vax >= {x0} AND by1 + (nb - 1) * vby >= {y0}) h WHERE i0 <= i1 AND j0 <= j1"""


def members(x0: int, y0: int, x1: int, y1: int) -> str:
    """The members that meet the closed window, as rows of flat_rect."""
    return f"""(SELECT parent, cell, layer, dt, bx0 + (i0 + gi.i) * vax AS x0, by0 + (j0 + gj.j) * vby AS y0, bx1 + (i0 + gi.i) * vax AS x1, by1 + (j0 + gj.j) * vby AS y1
  FROM ({hits(x0, y0, x1, y1)}) hr, @series(gi, i, i1 - i0 + 1), @series(gj, j, j1 - j0 + 1))"""


def _near(r: int) -> tuple[int, int, int, int]:
    return PX - r, PY - r, PX + r, PY + r


_WINDOW = (W["x0"], W["y0"], W["x1"], W["y1"])
#: In a window whole ranges count at once: no member is made.
_N = "(i1 - i0 + 1) * (j1 - j0 + 1)"
S["flat_view"] = f"SELECT layer, dt, CAST(sum({_N}) AS BIGINT) AS members, CAST(sum({_N} * (bx1 - bx0) * (by1 - by0)) AS BIGINT) AS area, min(bx0 + i0 * vax) AS min_x0, max(by1 + j1 * vby) AS max_y1 FROM ({hits(*_WINDOW)}) q GROUP BY layer, dt"
S["global_touch"] = f"SELECT layer, CAST(sum({_N}) AS BIGINT) AS n FROM ({hits(*_WINDOW)}) q WHERE layer NOT IN (63, 8) GROUP BY layer"
S["point_in_bbox"] = f"SELECT layer, CAST(sum({_N}) AS BIGINT) AS members FROM ({hits(300400, 4100, 301500, 7500)}) q GROUP BY layer"
S["bbox_union"] = "SELECT layer, min(bx0) AS x0, min(by0) AS y0, max(bx1 + (na - 1) * vax) AS x1, max(by1 + (nb - 1) * vby) AS y1 FROM rep_rect GROUP BY layer"
for _name, _window in {"bbox_clip": _WINDOW, "pick": _near(1500), "snap_vertex": _near(R), "probe_window": _near(2000), "clip_region": _near(9000)}.items():
    S[_name] = Q[_name].replace("FROM flat_rect", f"FROM {members(*_window)} flat")

#: The nearest vertex within r, else the nearest point of any edge; r, the place and the winner's kind.
SNAP_R = 900
_PLACES = [(PX, PY), (PX + 350, PY - 1300), (PX - 30, PY + 1250), (PX + 90000, PY + 90000)]
_EDGES = "SELECT x0 AS ax, y0 AS ay, x1 AS bx, y0 AS b_y, px, py FROM {t} UNION ALL SELECT x0, y1, x1, y1, px, py FROM {t} UNION ALL SELECT x0, y0, x0, y1, px, py FROM {t} UNION ALL SELECT x1, y0, x1, y1, px, py FROM {t}"
_PLACE_ROWS = "(SELECT * FROM (VALUES " + ", ".join(f"(CAST({x} AS BIGINT), CAST({y} AS BIGINT))" for x, y in _PLACES) + ") AS t(px, py))"


def _snap(flat: str) -> str:
    """Nearest of each kind a place, over boxes (x0, y0, x1, y1, px, py) that can be within r."""
    r2 = SNAP_R * SNAP_R
    return f"""SELECT px, py, CASE WHEN min(v) <= {r2} THEN 'vertex' WHEN min(e) <= {r2} THEN 'edge' ELSE '' END AS kind, CASE WHEN min(v) <= {r2} THEN min(v) WHEN min(e) <= {r2} THEN min(e) END AS d2 FROM (
  SELECT px, py, least((px - ax) * (px - ax) + (py - ay) * (py - ay), (px - bx) * (px - bx) + (py - b_y) * (py - b_y)) AS v,
         (px - least(greatest(px, ax), bx)) * (px - least(greatest(px, ax), bx)) + (py - least(greatest(py, ay), b_y)) * (py - least(greatest(py, ay), b_y)) AS e FROM ({flat}) edges) d GROUP BY px, py"""


def _snapped(rows: str) -> str:
    return f"SELECT p.px, p.py, coalesce(s.kind, '') AS kind, s.d2 FROM {_PLACE_ROWS} p LEFT JOIN ({_snap(_EDGES.format(t=rows))}) s ON s.px = p.px AND s.py = p.py"


_NEAR = " UNION ALL ".join(f"SELECT x0, y0, x1, y1, CAST({x} AS BIGINT) AS px, CAST({y} AS BIGINT) AS py FROM {members(x - SNAP_R, y - SNAP_R, x + SNAP_R, y + SNAP_R)} flat" for x, y in _PLACES)
S["snap_edge"] = "WITH near AS (" + _NEAR + ") " + _snapped("near")
Q["snap_edge"] = "WITH near AS (SELECT f.x0, f.y0, f.x1, f.y1, p.px, p.py FROM flat_rect f JOIN " + _PLACE_ROWS + f" p ON f.x0 <= p.px + {SNAP_R} AND f.x1 >= p.px - {SNAP_R} AND f.y0 <= p.py + {SNAP_R} AND f.y1 >= p.py - {SNAP_R}) " + _snapped("near")
