"""Rulers of simple violations and the values measured against a check's bounds.

A single edge is its own ruler. Of an edge pair it is the gap: from the middle of the first edge where that faces the
second as closely as any end does (within FACING), else between the closest ends or feet, with its two components if
the edges are parallel and it is slanted. An axis-parallel rectangle has both spans. Crossing or touching edges
and other polygons have none.
"""

from __future__ import annotations

from ..plans.compiler import view

FACING, PARALLEL = 1.0001, 1e-12

#: Errors with four points as whole numbers (the last two null for single edges): edges, pairs that face, are apart, cross; rectangles and a slanted quadrilateral.
view(
    "drc_points",
    """SELECT event_id, rule, kind, CAST(x0 AS DOUBLE) AS ax, CAST(y0 AS DOUBLE) AS ay, CAST(x0 + w AS DOUBLE) AS bx, CAST(CASE WHEN form = 1 THEN y0 + h ELSE y0 END AS DOUBLE) AS b_y,
       CAST(CASE form WHEN 0 THEN x0 + w WHEN 2 THEN x0 WHEN 3 THEN x0 + 2 * w WHEN 4 THEN x0 WHEN 5 THEN x0 + w + 7 END AS DOUBLE) AS cx, CAST(CASE form WHEN 0 THEN y0 + h WHEN 2 THEN y0 + h WHEN 3 THEN y0 + h WHEN 4 THEN y0 - h WHEN 5 THEN y0 + h END AS DOUBLE) AS cy,
       CAST(CASE form WHEN 0 THEN x0 WHEN 2 THEN x0 + w WHEN 3 THEN x0 + 3 * w WHEN 4 THEN x0 + w WHEN 5 THEN x0 + 3 END AS DOUBLE) AS dx, CAST(CASE WHEN form <> 1 THEN y0 + h END AS DOUBLE) AS dy
  FROM (SELECT event_id, rule, kind, x0, y0, w, h, CASE WHEN kind = 'p' THEN CASE WHEN event_id % 10 = 4 THEN 5 ELSE 0 END WHEN event_id % 4 = 1 THEN 1 ELSE 2 + (event_id DIV 4) % 3 END AS form FROM drc_raw) f""",
)

_LEN = "sqrt(({0}) * ({0}) + ({1}) * ({1}))"


def _foot(p: str, q: str, ax: str, ay: str, bx: str, b_y: str) -> tuple[str, str]:
    """The point of segment a-b nearest to (p, q)."""
    l2 = f"(({bx} - {ax}) * ({bx} - {ax}) + ({b_y} - {ay}) * ({b_y} - {ay}))"
    t = f"(CASE WHEN {l2} <= 0 THEN 0.0D ELSE greatest(0.0D, least(1.0D, (({p} - {ax}) * ({bx} - {ax}) + ({q} - {ay}) * ({b_y} - {ay})) / {l2})) END)"
    return f"({ax} + {t} * ({bx} - {ax}))", f"({ay} + {t} * ({b_y} - {ay}))"


def _gap(p: str, q: str, *segment: str) -> str:
    fx, fy = _foot(p, q, *segment)
    return f"struct({_LEN.format(f'{p} - {fx}', f'{q} - {fy}')} AS d, {p} AS px, {q} AS py, {fx} AS qx, {fy} AS qy)"


def _side(p: str, q: str, ax: str, ay: str, bx: str, b_y: str) -> str:
    return f"(({bx} - {ax}) * ({q} - {ay}) - ({b_y} - {ay}) * ({p} - {ax}) > 0)"


_A, _B = ("ax", "ay", "bx", "b_y"), ("cx", "cy", "dx", "dy")
_ENDS = [_gap("ax", "ay", *_B), _gap("bx", "b_y", *_B), _gap("cx", "cy", *_A), _gap("dx", "dy", *_A)]
_RECT = "(greatest(ax, bx, cx, dx) > least(ax, bx, cx, dx) AND greatest(ay, b_y, cy, dy) > least(ay, b_y, cy, dy) AND ((ax = dx AND bx = cx AND ay = b_y AND cy = dy) OR (ax = bx AND cx = dx AND ay = dy AND b_y = cy)))"

#: Of every error its rulers: how many, the first one's length, and the spans of a rectangle, in micrometres.
RULERS = f"""SELECT event_id, rule, kind, single, area, w, h, n, CASE WHEN n > 0 THEN first / 1000 END AS first FROM (
  SELECT event_id, rule, kind, cx IS NULL AS single, area, w, h, CASE WHEN kind = 'e' AND cx IS NULL THEN CASE WHEN edge > 0 THEN 1 ELSE 0 END WHEN kind = 'e' THEN CASE WHEN crossing OR near.d <= 0 THEN 0 WHEN middle.d <= near.d * {FACING} THEN 1 WHEN parallel AND near.px <> near.qx AND near.py <> near.qy THEN 3 ELSE 1 END
         WHEN rect THEN 2 ELSE 0 END AS n, CASE WHEN kind = 'e' AND cx IS NULL THEN edge WHEN kind = 'e' THEN CASE WHEN middle.d <= near.d * {FACING} THEN middle.d ELSE near.d END WHEN rect THEN w END AS first
  FROM (SELECT event_id, rule, kind, cx, {_LEN.format('bx - ax', 'b_y - ay')} AS edge, {_RECT} AS rect, greatest(ax, bx, cx, dx) - least(ax, bx, cx, dx) AS w, greatest(ay, b_y, cy, dy) - least(ay, b_y, cy, dy) AS h,
         CASE WHEN kind = 'p' THEN abs((ax * b_y - bx * ay) + (bx * cy - cx * b_y) + (cx * dy - dx * cy) + (dx * ay - ax * dy)) / 2 END AS area,
         {_side('cx', 'cy', *_A)} <> {_side('dx', 'dy', *_A)} AND {_side('ax', 'ay', *_B)} <> {_side('bx', 'b_y', *_B)} AS crossing,
         abs((bx - ax) * (dy - cy) - (b_y - ay) * (dx - cx)) <= {PARALLEL}D * {_LEN.format('bx - ax', 'b_y - ay')} * {_LEN.format('dx - cx', 'dy - cy')} AS parallel,
         array_min(array({', '.join(_ENDS)})) AS near, {_gap('(ax + bx) / 2', '(ay + b_y) / 2', *_B)} AS middle FROM drc_points) s) r"""

_MEASURE = "CASE c.metric WHEN 'area' THEN {area} WHEN 'length' THEN {length} ELSE {gap} END"


def _picked(rulers: str, measured: str) -> str:
    """Of each error the bound that counts: the first with an upper or equal sign, else the first, of those with a measured value."""
    return f"""SELECT event_id, metric, op, round(measured, 6) AS measured, round(measured - value, 6) AS delta, round(CASE WHEN value <> 0 THEN (measured - value) / value * 100 END, 4) AS percent FROM (
  SELECT event_id, metric, op, value, measured, row_number() OVER (PARTITION BY event_id ORDER BY CASE WHEN op IN ('<', '<=', '==') THEN 0 ELSE 1 END, ord) AS rn FROM (
    SELECT r.event_id, c.metric, c.op, c.ord, CAST(c.value AS DOUBLE) AS value, {measured} AS measured FROM ({rulers}) r JOIN deck_constraints c ON c.check_name = r.rule) m WHERE measured IS NOT NULL) p WHERE rn = 1"""


Q_RULERS = f"SELECT event_id, kind, n, round(first, 6) AS first FROM ({RULERS}) q"
Q_MEASURED = _picked(RULERS, _MEASURE.format(area="r.area / 1000000", length="CASE WHEN r.kind = 'e' AND r.single THEN r.first END", gap="CASE WHEN r.n > 0 AND r.kind = 'p' THEN least(r.w, r.h) / 1000 WHEN r.n > 0 AND NOT r.single THEN r.first END"))

#: The same for the checking engine by distances of points from lines and by the form of the shape, not by feet.
_DIST = "CASE WHEN ({0} - {2}) * ({4} - {2}) + ({1} - {3}) * ({5} - {3}) <= 0 THEN hypot_({0} - {2}, {1} - {3}) WHEN ({0} - {4}) * ({2} - {4}) + ({1} - {5}) * ({3} - {5}) <= 0 THEN hypot_({0} - {4}, {1} - {5}) ELSE abs(({4} - {2}) * ({1} - {3}) - ({5} - {3}) * ({0} - {2})) / hypot_({4} - {2}, {5} - {3}) END"


def _hypot(text: str) -> str:
    """hypot_(a, b) written out."""
    while (i := text.find("hypot_(")) >= 0:
        depth, at, comma = 0, i + 7, 0
        while depth or text[at] != ")":
            depth += (text[at] == "(") - (text[at] == ")")
            comma = at if text[at] == "," and not depth else comma
            at += 1
        text = f"{text[:i]}sqrt(pow({text[i + 7 : comma]}, 2) + pow({text[comma + 1 : at]}, 2)){text[at + 1 :]}"
    return text


_CHECK = _hypot(f"""SELECT event_id, rule, kind, form, w, h, middle, least(a0, a1, b0, b1) AS near, CASE WHEN form = 0 THEN w * h WHEN form = 5 THEN area5 END AS area FROM (
  SELECT p.event_id, p.rule, p.kind, CASE WHEN p.kind = 'p' THEN CASE WHEN p.event_id % 10 = 4 THEN 5 ELSE 0 END WHEN p.event_id % 4 = 1 THEN 1 ELSE 2 + (p.event_id DIV 4) % 3 END AS form, CAST(e.w AS DOUBLE) AS w, CAST(e.h AS DOUBLE) AS h,
    {_DIST.format('ax', 'ay', 'cx', 'cy', 'dx', 'dy')} AS a0, {_DIST.format('bx', 'b_y', 'cx', 'cy', 'dx', 'dy')} AS a1, {_DIST.format('cx', 'cy', 'ax', 'ay', 'bx', 'b_y')} AS b0, {_DIST.format('dx', 'dy', 'ax', 'ay', 'bx', 'b_y')} AS b1,
    {_DIST.format('(ax + bx) / 2', '(ay + b_y) / 2', 'cx', 'cy', 'dx', 'dy')} AS middle, (CAST(e.w AS DOUBLE) + abs(CAST(e.w AS DOUBLE) + 4)) / 2 * e.h AS area5
  FROM drc_points p JOIN drc_raw e ON e.event_id = p.event_id) d""")
#: By form: rectangles 2; edges 1 by Pythagoras; pairs that face 1; pairs apart 3, from end to end; crossing ones and slanted shapes 0.
_FIRST = _hypot("CASE form WHEN 0 THEN w WHEN 1 THEN hypot_(w, h) WHEN 2 THEN h WHEN 3 THEN hypot_(w, h) END")
_BY_FORM = f"SELECT event_id, rule, kind, form, area, w, h, CASE form WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 3 ELSE 0 END AS n, {_FIRST} / 1000 AS first, near, middle FROM ({_CHECK}) c"
O_RULERS = f"SELECT event_id, kind, n, round(CASE WHEN form = 3 THEN near / 1000 WHEN form = 2 THEN middle / 1000 ELSE first END, 6) AS first FROM ({_BY_FORM}) q"
O_MEASURED = _picked(_BY_FORM, _MEASURE.format(area="r.area / 1000000", length="CASE WHEN r.form = 1 THEN r.first END", gap="CASE r.form WHEN 0 THEN least(r.w, r.h) / 1000 WHEN 2 THEN r.h / 1000 WHEN 3 THEN r.first END"))
