"""Layout, violation and deck tables derived from the star-schema tables, by integer arithmetic only."""

from __future__ import annotations

from .compiler import view

view("lay_cell_origin", "SELECT o_orderkey AS cell, CAST((o_orderkey % 250) * 6000 AS BIGINT) AS ox, CAST((o_orderkey DIV 250) * 6000 AS BIGINT) AS oy FROM orders")
view(
    "lay_place",
    """SELECT parent, child, px, py, na, nb, vax, vby, rot, flip,
       CASE rot WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS co, CASE rot WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS si, CASE flip WHEN 1 THEN -1 ELSE 1 END AS ff
  FROM (SELECT l_orderkey AS parent, l_partkey AS child, CAST((l_partkey % 13) * 400 AS BIGINT) AS px, CAST(l_linenumber * 700 AS BIGINT) AS py,
               CAST(l_linenumber % 4 AS INT) AS rot, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS flip,
               CAST(1 + CAST(l_quantity AS BIGINT) % 3 AS BIGINT) AS na, CAST(1 + l_linenumber % 2 AS BIGINT) AS nb,
               CAST(90 AS BIGINT) AS vax, CAST(110 AS BIGINT) AS vby FROM lineitem) b""",
)
view(
    "lay_rect",
    """SELECT p_partkey AS cell, CAST(p_size % 8 + 1 AS INT) AS layer, CAST(0 AS INT) AS dt, CAST(p_partkey % 50 AS BIGINT) AS x, CAST(p_partkey % 37 AS BIGINT) AS y,
       CAST(10 + p_size * 3 AS BIGINT) AS w, CAST(5 + p_partkey % 60 AS BIGINT) AS h FROM part""",
)
view("lay_text", "SELECT p_partkey AS cell, CAST(63 AS INT) AS layer, CAST(63 AS INT) AS dt, CAST(p_partkey % 41 AS BIGINT) AS x, CAST(p_partkey % 29 AS BIGINT) AS y, p_brand AS s FROM part WHERE p_partkey % 3 = 0")
#: Rows of a two-level hierarchy flattened: a placement's transform applied to a shape, repetitions in the parent's frame.
_CORNERS = """o.ox + p.px + gi.i * p.vax + (p.co * {x0} - p.si * p.ff * {y0}) AS ax, o.oy + p.py + gj.j * p.vby + (p.si * {x0} + p.co * p.ff * {y0}) AS ay,
       o.ox + p.px + gi.i * p.vax + (p.co * {x1} - p.si * p.ff * {y1}) AS bx, o.oy + p.py + gj.j * p.vby + (p.si * {x1} + p.co * p.ff * {y1}) AS b_y"""
view(
    "flat_rect",
    f"""SELECT parent, cell, layer, dt, least(ax, bx) AS x0, least(ay, b_y) AS y0, greatest(ax, bx) AS x1, greatest(ay, b_y) AS y1
  FROM (SELECT p.parent, r.cell, r.layer, r.dt, {_CORNERS.format(x0='r.x', y0='r.y', x1='(r.x + r.w)', y1='(r.y + r.h)')}
        FROM lay_cell_origin o JOIN lay_place p ON p.parent = o.cell JOIN lay_rect r ON r.cell = p.child, @series(gi, i, na), @series(gj, j, nb)) q""",
)
view(
    "flat_text",
    f"""SELECT parent, cell, layer, dt, ax AS x, ay AS y, s
  FROM (SELECT p.parent, t.cell, t.layer, t.dt, t.s, {_CORNERS.format(x0='t.x', y0='t.y', x1='t.x', y1='t.y')}
        FROM lay_cell_origin o JOIN lay_place p ON p.parent = o.cell JOIN lay_text t ON t.cell = p.child, @series(gi, i, na), @series(gj, j, nb)) q""",
)
#: Six levels: 0 -> region -> nation -> customer -> order -> part. Ids carry the level in their hundred thousand millions.
L = 100_000_000_000
view(
    "deep_place",
    f"""SELECT CAST(0 AS BIGINT) AS parent, CAST({L} + r_regionkey AS BIGINT) AS child, CAST(r_regionkey * 90000000 AS BIGINT) AS px, CAST(0 AS BIGINT) AS py, CAST(0 AS INT) AS rot, CAST(0 AS INT) AS flip, CAST(1 AS BIGINT) AS na, CAST(1 AS BIGINT) AS nb, CAST(0 AS BIGINT) AS vax, CAST(0 AS BIGINT) AS vby FROM region
  UNION ALL SELECT {L} + n_regionkey, {2 * L} + n_nationkey, CAST(n_nationkey * 1000000 AS BIGINT), CAST(n_nationkey * 70000 AS BIGINT), CAST(n_nationkey % 4 AS INT), CAST(n_nationkey % 2 AS INT), CAST(1 AS BIGINT), CAST(1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM nation
  UNION ALL SELECT {2 * L} + c_nationkey, {3 * L} + c_custkey, CAST((c_custkey % 100) * 9000 AS BIGINT), CAST((c_custkey DIV 100) * 9000 AS BIGINT), CAST(c_custkey % 4 AS INT), CAST(0 AS INT), CAST(1 + c_custkey % 2 AS BIGINT), CAST(1 AS BIGINT), CAST(5000 AS BIGINT), CAST(0 AS BIGINT) FROM customer
  UNION ALL SELECT {3 * L} + o_custkey, {4 * L} + o_orderkey, CAST((o_orderkey % 10) * 6000 AS BIGINT), CAST((o_orderkey % 7) * 6000 AS BIGINT), CAST(o_orderkey % 4 AS INT), CAST(o_orderkey % 2 AS INT), CAST(1 AS BIGINT), CAST(1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM orders
  UNION ALL SELECT {4 * L} + parent, {5 * L} + child, px, py, rot, flip, na, nb, vax, vby FROM lay_place""",
)
view("deep_rect", f"SELECT CAST({5 * L} + cell AS BIGINT) AS cell, layer, dt, x, y, w, h FROM lay_rect")

view(
    "drc_error",
    """SELECT event_id, rule, kind, x0, y0, w, h, x0 + w AS x1, y0 + h AS y1, status, row_number() OVER (ORDER BY rule, event_id) AS gnum, row_number() OVER (PARTITION BY rule ORDER BY event_id) AS lnum
  FROM (SELECT event_id, concat(upper(event_type), '.', CAST(user_id % 4 AS STRING)) AS rule, CASE WHEN event_id % 2 = 0 THEN 'p' ELSE 'e' END AS kind,
               (event_id * 7919) % 1000003 AS x0, (event_id * 104729) % 1000003 AS y0, CAST(floor(value * 100) AS BIGINT) + 1 AS w, CAST(1 + event_id % 400 AS BIGINT) AS h,
               CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS status FROM events) b""",
)
#: The same errors without numbers, for operators that need none: no global order is made.
view(
    "drc_raw",
    """SELECT event_id, concat(upper(event_type), '.', CAST(user_id % 4 AS STRING)) AS rule, CASE WHEN event_id % 2 = 0 THEN 'p' ELSE 'e' END AS kind,
       (event_id * 7919) % 1000003 AS x0, (event_id * 104729) % 1000003 AS y0, CAST(floor(value * 100) AS BIGINT) + 1 AS w, CAST(1 + event_id % 400 AS BIGINT) AS h,
       CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS status FROM events""",
)
view("drc_status_log", "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS status, CAST(1 AS BIGINT) AS seq FROM events UNION ALL SELECT event_id, CAST(user_id % 3 AS INT), CAST(2 AS BIGINT) FROM events WHERE event_id % 5 = 0")
view("deck_layers", "SELECT concat('L', CAST(n AS STRING)) AS name, CAST(n AS BIGINT) AS spec, CASE WHEN n % 3 = 0 THEN CAST(0 AS BIGINT) END AS spec_dt FROM (SELECT DISTINCT CAST(p_size % 8 + 1 AS INT) AS n FROM part) q")
view("deck_layer_maps", "SELECT CAST(n AS BIGINT) AS gds, CASE WHEN n % 2 = 0 THEN CAST(0 AS BIGINT) END AS dt, CAST(n + 1 AS BIGINT) AS target FROM (SELECT DISTINCT CAST(p_size % 5 + 1 AS INT) AS n FROM part) q")
view(
    "deck_derived",
    """SELECT * FROM (VALUES ('A', 0, 'L1'), ('A', 1, 'B'), ('B', 0, 'L2'), ('B', 1, 'C'), ('C', 0, 'A'), ('C', 1, 'L3'), ('D', 0, 'A'), ('D', 1, 'X'), ('E', 0, 'L5'), ('E', 1, 'D')) AS t(name, ord, operand)""",
)
view(
    "deck_check_operands",
    """SELECT * FROM (VALUES ('CLICK.0', 0, 'A'), ('CLICK.1', 0, 'L4'), ('VIEW.0', 0, 'D'), ('VIEW.1', 0, 'E'), ('PURCHASE.0', 0, 'B'), ('PURCHASE.1', 0, 'NOPE'), ('LOGIN.2', 0, 'L6')) AS t(check_name, ord, operand)""",
)
view(
    "deck_constraints",
    """SELECT * FROM (VALUES ('CLICK.0', 0, 'space', '<', 120.0), ('CLICK.0', 1, 'width', '<=', 40.0), ('VIEW.0', 0, 'width', '<', 60.0), ('VIEW.1', 0, 'area', '<', 900.0), ('PURCHASE.0', 0, 'enclosure', '==', 15.0), ('CLICK.1', 0, 'space', '>', 5.0)) AS t(check_name, ord, metric, op, value)""",
)
view("layer_keys", "SELECT layer, dt, concat('L', CAST(layer AS STRING)) AS name, CAST(layer - 1 AS INT) AS idx FROM (SELECT DISTINCT layer, dt FROM lay_rect) q")
#: Pages: a cell's shapes of one layer in groups, with the statistics that pruning reads.
view(
    "pages_v",
    """SELECT page, layer, dt, count(*) AS records, CAST(sum(members) AS BIGINT) AS members, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(w) AS max_w, max(h) AS max_h, max(least(w, h)) AS max_min, CAST(count(*) * 40 AS BIGINT) AS bytes
  FROM (SELECT p.parent DIV 16 * 16 + r.layer AS page, r.layer, r.dt, p.na * p.nb AS members, o.ox + p.px - 400 AS x0, o.oy + p.py - 400 AS y0, o.ox + p.px + 400 + (p.na - 1) * p.vax AS x1, o.oy + p.py + 400 + (p.nb - 1) * p.vby AS y1, r.w, r.h
        FROM lay_cell_origin o JOIN lay_place p ON p.parent = o.cell JOIN lay_rect r ON r.cell = p.child) q GROUP BY page, layer, dt""",
)
