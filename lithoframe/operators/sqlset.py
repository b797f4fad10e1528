"""Operators that are one SQL plan each: Q[name] = text. Parameters are production values of the views' data."""

from __future__ import annotations

Q: dict[str, str] = {}

W = {"x0": 100000, "y0": 20000, "x1": 600000, "y1": 200000}
HIT = "x0 <= {x1} AND x1 >= {x0} AND y0 <= {y1} AND y1 >= {y0}".format(**W)  # closed: touching boxes meet

# --- layout: flattening, windows, counts
Q["flat_view"] = f"SELECT layer, dt, count(*) AS members, CAST(sum((x1 - x0) * (y1 - y0)) AS BIGINT) AS area, min(x0) AS min_x0, max(y1) AS max_y1 FROM flat_rect WHERE {HIT} GROUP BY layer, dt"
Q["member_total"] = "SELECT CAST(sum(p.na * p.nb) AS BIGINT) AS members FROM lay_cell_origin o JOIN lay_place p ON p.parent = o.cell JOIN lay_rect r ON r.cell = p.child"
Q["layer_counts"] = "SELECT r.layer, r.dt, count(*) AS records, CAST(sum(p.na * p.nb) AS BIGINT) AS members FROM lay_place p JOIN lay_rect r ON r.cell = p.child GROUP BY r.layer, r.dt"
Q["stored_counts"] = "SELECT layer, dt, CAST(sum(shapes) AS BIGINT) AS shapes, CAST(sum(texts) AS BIGINT) AS texts FROM (SELECT layer, dt, 1 AS shapes, 0 AS texts FROM lay_rect UNION ALL SELECT layer, dt, 0, 1 FROM lay_text) q GROUP BY layer, dt"
Q["cell_direct_stats"] = "SELECT cell, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1, count(*) AS records, bit_or(CAST(1 AS BIGINT) << CAST(layer - 1 AS INT)) AS mask FROM lay_rect GROUP BY cell"
Q["transform_bbox"] = """SELECT p.parent, p.child, p.rot, p.flip, count(*) AS n, min(least(p.co * r.x - p.si * p.ff * r.y, p.co * (r.x + r.w) - p.si * p.ff * (r.y + r.h))) AS x0, max(greatest(p.si * r.x + p.co * p.ff * r.y, p.si * (r.x + r.w) + p.co * p.ff * (r.y + r.h))) AS y1
  FROM lay_place p JOIN lay_rect r ON r.cell = p.child GROUP BY p.parent, p.child, p.rot, p.flip"""
Q["transform_invert"] = """SELECT parent, child, px, py, rot, flip, count(*) AS n, min(co * (500000 - px) + si * (90000 - py)) AS ix, min(ff * (co * (90000 - py) - si * (500000 - px))) AS iy,
  min(px + co * 30 - si * ff * 20) AS cx, min(py + si * 30 + co * ff * 20) AS cy, min((rot + CASE flip WHEN 1 THEN 4 - 1 ELSE 1 END) % 4) AS crot, min((flip + 1) % 2) AS cflip FROM lay_place GROUP BY parent, child, px, py, rot, flip"""
Q["bbox_union"] = "SELECT layer, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM flat_rect GROUP BY layer"
Q["bbox_clip"] = f"SELECT layer, count(*) AS members, CAST(sum((cx1 - cx0) * (cy1 - cy0)) AS BIGINT) AS area FROM (SELECT layer, greatest(x0, {W['x0']}) AS cx0, greatest(y0, {W['y0']}) AS cy0, least(x1, {W['x1']}) AS cx1, least(y1, {W['y1']}) AS cy1 FROM flat_rect WHERE {HIT}) q WHERE cx1 > cx0 AND cy1 > cy0 GROUP BY layer"
Q["point_in_bbox"] = "SELECT layer, count(*) AS members FROM flat_rect WHERE x0 <= 301500 AND x1 >= 300400 AND y0 <= 7500 AND y1 >= 4100 GROUP BY layer"
#: Members of an axis-parallel repetition that can meet the window, by index range, before any is made.
Q["grid_index_range"] = f"""SELECT parent, child, px, py, i0, i1, j0, j1, count(*) AS n FROM (
  SELECT p.parent, p.child, o.ox + p.px AS px, o.oy + p.py AS py,
         greatest(CAST(0 AS BIGINT), -@floor(o.ox + p.px + 300 - {W['x0']}, p.vax)) AS i0, least(p.na - 1, @floor({W['x1']} - (o.ox + p.px - 300), p.vax)) AS i1,
         greatest(CAST(0 AS BIGINT), -@floor(o.oy + p.py + 300 - {W['y0']}, p.vby)) AS j0, least(p.nb - 1, @floor({W['y1']} - (o.oy + p.py - 300), p.vby)) AS j1
  FROM lay_cell_origin o JOIN lay_place p ON p.parent = o.cell) q WHERE i0 <= i1 AND j0 <= j1 GROUP BY parent, child, px, py, i0, i1, j0, j1"""
Q["minkowski_box"] = f"SELECT p.parent, p.child, p.px, p.py, count(*) AS n, {W['x0']} - max(r.x + r.w) AS nx0, {W['y0']} - max(r.y + r.h) AS ny0, {W['x1']} - min(r.x) AS nx1, {W['y1']} - min(r.y) AS ny1 FROM lay_place p JOIN lay_rect r ON r.cell = p.child GROUP BY p.parent, p.child, p.px, p.py"
Q["repetition_extent"] = "SELECT parent, child, count(*) AS n, CAST(sum(na * nb) AS BIGINT) AS members, max((na - 1) * vax) AS ex, max((nb - 1) * vby) AS ey FROM lay_place GROUP BY parent, child"
Q["grid_normalise"] = "SELECT parent, child, px, py, na, nb, rot, count(*) AS n, min(CASE WHEN sx < 0 THEN px + (na - 1) * sx ELSE px END) AS bx, min(CASE WHEN sy < 0 THEN py + (nb - 1) * sy ELSE py END) AS b_y, min(abs(sx)) AS stepx, min(abs(sy)) AS stepy FROM (SELECT parent, child, px, py, na, nb, rot, co * vax AS sx, ff * vby AS sy FROM lay_place) q GROUP BY parent, child, px, py, na, nb, rot"
Q["member_at_index"] = "SELECT parent, child, k, count(*) AS n, min(px + (k % na) * vax) AS mx, min(py + (k DIV na) * vby) AS my FROM (SELECT parent, child, px, py, na, nb, vax, vby, (parent * 7 + child) % (na * nb) AS k FROM lay_place) q GROUP BY parent, child, k"
Q["take_members"] = "SELECT parent, child, px, py, g.k AS k, count(*) AS n, min(px + (g.k % na) * vax) AS mx FROM lay_place, @series(g, k, least(na * nb, 2)) GROUP BY parent, child, px, py, g.k"

# --- tiles, bands, cuts, pages
TILE = 250000
Q["tile_bins"] = f"SELECT tx + g.i AS tile_c, ty + k.j AS tile_r, layer, count(*) AS members FROM (SELECT layer, @floor(x0, {TILE}) AS tx, @floor(y0, {TILE}) AS ty, @floor(greatest(x1 - 1, x0), {TILE}) - @floor(x0, {TILE}) + 1 AS nx, @floor(greatest(y1 - 1, y0), {TILE}) - @floor(y0, {TILE}) + 1 AS ny FROM flat_rect) q, @series(g, i, nx), @series(k, j, ny) GROUP BY tx + g.i, ty + k.j, layer"
Q["tile_route_clip"] = f"""SELECT tile_c, tile_r, count(*) AS members, CAST(sum((least(x1, (tile_c + 1) * {TILE}) - greatest(x0, tile_c * {TILE})) * (least(y1, (tile_r + 1) * {TILE}) - greatest(y0, tile_r * {TILE}))) AS BIGINT) AS area
  FROM (SELECT x0, y0, x1, y1, tx + g.i AS tile_c, ty + k.j AS tile_r FROM (SELECT x0, y0, x1, y1, @floor(x0, {TILE}) AS tx, @floor(y0, {TILE}) AS ty, @floor(x1 - 1, {TILE}) - @floor(x0, {TILE}) + 1 AS nx, @floor(y1 - 1, {TILE}) - @floor(y0, {TILE}) + 1 AS ny FROM flat_rect WHERE x1 > x0 AND y1 > y0) q, @series(g, i, nx), @series(k, j, ny)) z GROUP BY tile_c, tile_r"""
Q["tiles_for_bbox"] = f"SELECT g.i + {W['x0'] // TILE} AS tile_c, k.j + {W['y0'] // TILE} AS tile_r FROM (SELECT 1 AS one) q, @series(g, i, {(W['x1'] - 1) // TILE - W['x0'] // TILE + 1}), @series(k, j, {(W['y1'] - 1) // TILE - W['y0'] // TILE + 1})"
Q["size_bands"] = "SELECT layer, CASE WHEN greatest(w, h) < 40 THEN 3 WHEN greatest(w, h) < 80 THEN 2 WHEN greatest(w, h) < 120 THEN 1 ELSE 0 END AS band, count(*) AS shapes FROM lay_rect GROUP BY layer, CASE WHEN greatest(w, h) < 40 THEN 3 WHEN greatest(w, h) < 80 THEN 2 WHEN greatest(w, h) < 120 THEN 1 ELSE 0 END"
Q["band_union"] = "SELECT layer, count(*) AS shapes, CAST(sum(w * h) AS BIGINT) AS area FROM (SELECT layer, w, h FROM lay_rect WHERE greatest(w, h) < 40 UNION ALL SELECT layer, w, h FROM lay_rect WHERE greatest(w, h) >= 40 AND greatest(w, h) < 120 UNION ALL SELECT layer, w, h FROM lay_rect WHERE greatest(w, h) >= 120) q GROUP BY layer"
Q["size_cut"] = "SELECT layer, count(*) AS kept FROM lay_rect WHERE NOT (w < 60 AND h < 60) AND NOT (least(w, h) < CAST(0.25 * 60 AS INT)) GROUP BY layer"
Q["page_stats"] = "SELECT page, layer, dt, records, members, x0, y0, x1, y1, max_w, max_h, max_min FROM pages_v"
Q["page_select"] = f"SELECT page, layer, members FROM pages_v WHERE {HIT} AND NOT (max_w < 100 AND max_h < 100) AND max_min >= 15 AND layer IN (1, 2, 5)"
Q["page_batch"] = "SELECT r.ord, r.page, p.layer, p.members FROM (SELECT * FROM (VALUES (0, 17), (1, 2), (2, 17), (3, 33)) AS t(ord, page)) r LEFT JOIN pages_v p ON p.page = r.page"
Q["page_priority"] = f"SELECT page, layer, dx * dx + dy * dy AS d2 FROM (SELECT page, layer, greatest(x0 - {(W['x0'] + W['x1']) // 2}, CAST(0 AS BIGINT), {(W['x0'] + W['x1']) // 2} - x1) AS dx, greatest(y0 - {(W['y0'] + W['y1']) // 2}, CAST(0 AS BIGINT), {(W['y0'] + W['y1']) // 2} - y1) AS dy FROM pages_v) q"
Q["lod_swap"] = "SELECT layer, CAST(sum(CASE WHEN max_w * 0.01 < 1 AND members > 20 THEN 1 ELSE 0 END) AS BIGINT) AS swapped, CAST(sum(CASE WHEN members * 10000 > (x1 - x0) * (y1 - y0) * 0.0001 THEN 1 ELSE 0 END) AS BIGINT) AS washed FROM pages_v GROUP BY layer"
Q["frame_tone"] = """SELECT tone, count(*) AS n FROM (SELECT CASE WHEN px_per_dbu <= 0 OR side >= 25 THEN 0 WHEN side >= 9 THEN 1 WHEN side >= 5 THEN 2 ELSE 3 END AS tone
  FROM (SELECT v.px_per_dbu, CAST(least(w, h) AS DOUBLE) * v.px_per_dbu AS side FROM lay_rect JOIN (SELECT * FROM (VALUES (CAST(0.25 AS DOUBLE)), (CAST(0.0 AS DOUBLE))) AS t(px_per_dbu)) v ON true) s) q GROUP BY tone"""
Q["plan_inspect"] = "SELECT layer, count(*) AS pages, CAST(sum(CASE WHEN x1 - x0 > 100000 THEN 1 ELSE 0 END) AS BIGINT) AS wide, CAST(sum(members) AS BIGINT) AS members, CAST(sum(bytes) AS BIGINT) AS bytes FROM pages_v GROUP BY layer"
Q["grid_sizing"] = """SELECT layer, n, -@floor(-(x1 - x0), n) AS tile FROM (SELECT layer, x0, x1, least(greatest(k + CASE WHEN s - k > 0.5 OR (s - k = 0.5 AND k % 2 = 1) THEN 1 ELSE 0 END, 4), 96) AS n
  FROM (SELECT layer, x0, x1, s, CAST(floor(s) AS BIGINT) AS k FROM (SELECT layer, sqrt(CAST(sum(bytes) AS DOUBLE) / 4096) AS s, min(x0) AS x0, max(x1) AS x1 FROM pages_v GROUP BY layer) a) b) c"""
Q["read_mode"] = "SELECT layer, CASE WHEN sum(records) * 10 > sum(bytes) THEN 1 ELSE 0 END AS compact FROM pages_v GROUP BY layer"
Q["cache_summary"] = "SELECT k.name, k.layer, k.dt, CAST(p.members AS BIGINT) AS stored, p.x1 - p.x0 AS dx FROM layer_keys k JOIN (SELECT layer, dt, sum(members) AS members, min(x0) AS x0, max(x1) AS x1 FROM pages_v GROUP BY layer, dt) p ON p.layer = k.layer AND p.dt = k.dt"
Q["tile_census"] = "SELECT layer, count(*) AS arrays, CAST(sum(CASE WHEN na * nb = 1 THEN 1 ELSE 0 END) AS BIGINT) AS singles, max(na * nb) AS largest, min(CASE WHEN rn = n DIV 2 + 1 THEN m END) AS p50 FROM (SELECT r.layer, p.na, p.nb, p.na * p.nb AS m, row_number() OVER (PARTITION BY r.layer ORDER BY p.na * p.nb, p.parent, p.child, p.px, p.py, p.rot, p.flip) AS rn, count(*) OVER (PARTITION BY r.layer) AS n FROM lay_place p JOIN lay_rect r ON r.cell = p.child) q GROUP BY layer"

# --- names, masks, layers
Q["layer_spec"] = "SELECT k.layer, k.dt, min(s.ord) AS ord FROM (SELECT * FROM (VALUES (0, 'L3'), (1, '5/0'), (2, 'L3'), (3, '1/0')) AS t(ord, spec)) s JOIN layer_keys k ON k.name = s.spec OR concat(CAST(k.layer AS STRING), '/', CAST(k.dt AS STRING)) = s.spec GROUP BY k.layer, k.dt"
Q["layer_mask"] = "SELECT bit_or(CAST(1 AS BIGINT) << idx) AS mask, count(*) AS n FROM layer_keys WHERE name IN ('L1', 'L4', 'L6')"
Q["mask_meets"] = "SELECT cell FROM (SELECT cell, bit_or(CAST(1 AS BIGINT) << CAST(layer - 1 AS INT)) AS mask FROM lay_rect GROUP BY cell) q WHERE (mask & CAST(41 AS BIGINT)) <> 0"
Q["layer_name_intervals"] = "SELECT layer, dt, name FROM (SELECT k.layer, k.dt, n.name, row_number() OVER (PARTITION BY k.layer, k.dt ORDER BY n.seq DESC) AS rn FROM layer_keys k JOIN (SELECT * FROM (VALUES (0, 1, 3, 'metal'), (1, 2, 5, 'via'), (2, 4, 4, ''), (3, 6, 100, 'top')) AS t(seq, lo, hi, name)) n ON k.layer BETWEEN n.lo AND n.hi WHERE n.name <> '') q WHERE rn = 1"
Q["late_names"] = "SELECT p.child AS refnum, c.p_name AS cellname, count(*) AS uses FROM lay_place p LEFT JOIN part c ON c.p_partkey = p.child GROUP BY p.child, c.p_name"
Q["frame_layer"] = """SELECT max(c.n) AS frame_layer FROM (SELECT g.n FROM (SELECT least(max(layer) + 1, 255) AS top FROM (SELECT layer FROM lay_rect UNION ALL SELECT layer FROM lay_text) a) m, @series(g, n, m.top + 1)) c
  LEFT JOIN (SELECT DISTINCT layer FROM lay_rect UNION SELECT DISTINCT layer FROM lay_text) u ON u.layer = c.n WHERE u.layer IS NULL"""
Q["legend"] = "SELECT k.name, k.layer, k.dt, (k.layer * 137508 % 360000) AS hue FROM layer_keys k WHERE k.layer <> 2"
Q["layer_props"] = "SELECT CAST(split_part(line, ' ', 1) AS INT) AS layer, split_part(line, ' ', 2) AS color, split_part(line, ' ', 3) AS fill FROM (SELECT * FROM (VALUES ('1 red solid'), ('2 blue hatch'), ('5 green dots')) AS t(line)) q"
Q["tsv_escape"] = "SELECT s, escaped, replace(replace(replace(replace(escaped, concat(chr(92), chr(92)), chr(1)), concat(chr(92), 't'), chr(9)), concat(chr(92), 'n'), chr(10)), chr(1), chr(92)) AS unescaped, n FROM (SELECT s, replace(replace(replace(s, chr(92), concat(chr(92), chr(92))), chr(9), concat(chr(92), 't')), chr(10), concat(chr(92), 'n')) AS escaped, count(*) AS n FROM (SELECT concat(s, chr(9), CAST(cell AS STRING), chr(92)) AS s FROM lay_text) q GROUP BY s) e"
Q["top_cells"] = "SELECT count(*) AS tops, min(cell) AS least_top FROM (SELECT DISTINCT d.parent AS cell FROM deep_place d LEFT JOIN (SELECT DISTINCT child FROM deep_place) c ON c.child = d.parent WHERE c.child IS NULL) q"
Q["integrity_orphans"] = "SELECT count(*) AS orphans FROM lay_place p LEFT JOIN lay_rect r ON r.cell = p.child WHERE r.cell IS NULL"

# --- interaction
PX, PY, R = 301000, 5600, 60000
Q["pick"] = f"SELECT layer, dt, cell, area, rn FROM (SELECT layer, dt, cell, (x1 - x0) * (y1 - y0) AS area, row_number() OVER (ORDER BY (x1 - x0) * (y1 - y0), layer, dt, cell, x0, y0, x1, y1) AS rn FROM flat_rect WHERE x0 <= {PX} + 1500 AND x1 >= {PX} - 1500 AND y0 <= {PY} + 1500 AND y1 >= {PY} - 1500) q WHERE rn <= 64"
Q["snap_vertex"] = f"""SELECT vx, vy, d2 FROM (SELECT vx, vy, d2, row_number() OVER (ORDER BY d2, vx, vy) AS rn FROM (SELECT DISTINCT vx, vy, (vx - {PX}) * (vx - {PX}) + (vy - {PY}) * (vy - {PY}) AS d2 FROM (
  SELECT x0 AS vx, y0 AS vy, x0, y0, x1, y1 FROM flat_rect UNION ALL SELECT x1, y0, x0, y0, x1, y1 FROM flat_rect UNION ALL SELECT x0, y1, x0, y0, x1, y1 FROM flat_rect UNION ALL SELECT x1, y1, x0, y0, x1, y1 FROM flat_rect) v WHERE x0 <= {PX + R} AND x1 >= {PX - R} AND y0 <= {PY + R} AND y1 >= {PY - R}) d WHERE d2 <= {R * R}) z WHERE rn <= 5"""
Q["snap_edge"] = f"SELECT fx, fy, min(d2) AS d2 FROM (SELECT fx, fy, (fx - {PX}) * (fx - {PX}) + (fy - {PY}) * (fy - {PY}) AS d2 FROM (SELECT least(greatest({PX}, x0), x1) AS fx, CASE WHEN abs({PY} - y0) <= abs({PY} - y1) THEN y0 ELSE y1 END AS fy FROM flat_rect WHERE x0 <= {PX + R} AND x1 >= {PX - R} AND y0 <= {PY + R} AND y1 >= {PY - R}) e) q WHERE d2 <= 400000000 GROUP BY fx, fy"
Q["probe_window"] = f"SELECT layer, dt, cell, x0, y0, x1, y1, count(*) AS n FROM flat_rect WHERE x0 <= {PX + 2000} AND x1 >= {PX - 2000} AND y0 <= {PY + 2000} AND y1 >= {PY - 2000} GROUP BY layer, dt, cell, x0, y0, x1, y1"
Q["clip_region"] = f"SELECT layer, greatest(x0, {PX - 9000}) AS x0, greatest(y0, {PY - 9000}) AS y0, least(x1, {PX + 9000}) AS x1, least(y1, {PY + 9000}) AS y1, count(*) AS n FROM flat_rect WHERE x0 < {PX + 9000} AND x1 > {PX - 9000} AND y0 < {PY + 9000} AND y1 > {PY - 9000} AND layer IN (1, 2, 3) GROUP BY layer, greatest(x0, {PX - 9000}), greatest(y0, {PY - 9000}), least(x1, {PX + 9000}), least(y1, {PY + 9000})"
Q["global_touch"] = f"SELECT layer, count(*) AS n FROM flat_rect WHERE {HIT} AND layer NOT IN (63, 8) GROUP BY layer"
Q["marker_hit"] = "SELECT gnum, d2 FROM (SELECT gnum, (x0 - 500000) * (x0 - 500000) + (y0 - 500000) * (y0 - 500000) AS d2, row_number() OVER (ORDER BY (x0 - 500000) * (x0 - 500000) + (y0 - 500000) * (y0 - 500000), gnum) AS rn FROM drc_error WHERE (x0 - 500000) * (x0 - 500000) + (y0 - 500000) * (y0 - 500000) <= 10000000000) q WHERE rn = 1"

# --- plan of a view
Q["child_clip"] = f"""SELECT p.parent, p.child, count(*) AS n, min(p.co * ({W['x0']} - o.ox - p.px) + p.si * ({W['y0']} - o.oy - p.py)) AS cx, min(p.ff * (p.co * ({W['y0']} - o.oy - p.py) - p.si * ({W['x0']} - o.ox - p.px))) AS cy
  FROM lay_cell_origin o JOIN lay_place p ON p.parent = o.cell WHERE o.ox + p.px - 400 <= {W['x1']} AND o.ox + p.px + 400 >= {W['x0']} AND o.oy + p.py - 400 <= {W['y1']} AND o.oy + p.py + 400 >= {W['y0']} GROUP BY p.parent, p.child"""
Q["boundary_frames"] = f"SELECT p.parent, p.child, o.ox + p.px AS fx, o.oy + p.py AS fy, p.rot, p.flip, p.na, p.nb, count(*) AS n FROM lay_cell_origin o JOIN lay_place p ON p.parent = o.cell WHERE o.ox + p.px <= {W['x1']} AND o.ox + p.px + 400 >= {W['x0']} AND o.oy + p.py <= {W['y1']} AND o.oy + p.py + 400 >= {W['y0']} GROUP BY p.parent, p.child, o.ox + p.px, o.oy + p.py, p.rot, p.flip, p.na, p.nb"
Q["thin_frames"] = "SELECT child, bx, b_y, parent FROM (SELECT p.child, (o.ox + p.px) DIV 50000 AS bx, (o.oy + p.py) DIV 50000 AS b_y, p.parent, row_number() OVER (PARTITION BY p.child, (o.ox + p.px) DIV 50000, (o.oy + p.py) DIV 50000 ORDER BY p.parent, p.px, p.py) AS rn FROM lay_cell_origin o JOIN lay_place p ON p.parent = o.cell) q WHERE rn = 1"
Q["frontier_boxes"] = "SELECT x0, y0, x1, y1, bin, rn, row_number() OVER (ORDER BY (x1 - x0) * (y1 - y0) DESC, keep) AS pos FROM (SELECT x0, y0, x1, y1, bin, rn, row_number() OVER (ORDER BY rn, bin) AS keep FROM (SELECT x0, y0, x1, y1, (y0 DIV 100000) * 64 + x0 DIV 100000 AS bin, row_number() OVER (PARTITION BY (y0 DIV 100000) * 64 + x0 DIV 100000 ORDER BY (x1 - x0) * (y1 - y0) DESC, page, layer) AS rn FROM pages_v WHERE x0 >= 0 AND y0 >= 0) q WHERE rn <= 4) z WHERE keep <= 600"
Q["stream_prefix"] = "SELECT page, layer, pos, total FROM (SELECT page, layer, row_number() OVER (ORDER BY members DESC, page, layer) AS pos, CAST(sum(bytes) OVER (ORDER BY members DESC, page, layer ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total FROM pages_v) q WHERE pos = 1 OR total <= 20000"
Q["lru_evict"] = "SELECT page, layer FROM (SELECT page, layer, gen, CAST(coalesce(sum(bytes) OVER (ORDER BY gen, page, layer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before, CAST(sum(bytes) OVER () AS BIGINT) AS held FROM (SELECT page, layer, bytes, page % 7 AS gen FROM pages_v) a) q WHERE before < held - 60000 AND gen < 6"
Q["ws_new"] = f"SELECT n.page, n.layer FROM (SELECT page, layer FROM pages_v WHERE {HIT}) n LEFT JOIN (SELECT page, layer FROM pages_v WHERE x0 <= 400000) c ON c.page = n.page AND c.layer = n.layer WHERE c.page IS NULL"
Q["ws_touch"] = f"SELECT page, layer FROM pages_v WHERE {HIT} INTERSECT SELECT page, layer FROM pages_v WHERE x0 <= 400000"

# --- labels
Q["label_walk"] = f"SELECT s, layer, x, y, count(*) AS n FROM flat_text WHERE x BETWEEN {W['x0']} AND {W['x1']} AND y BETWEEN {W['y0']} AND {W['y1']} GROUP BY s, layer, x, y"
Q["label_declutter"] = f"SELECT bx, b_y, s, x, y FROM (SELECT @floor(x, 20000) AS bx, @floor(y, 20000) AS b_y, s, x, y, row_number() OVER (PARTITION BY @floor(x, 20000), @floor(y, 20000) ORDER BY layer, x, y, s, cell, parent) AS rn FROM flat_text WHERE x BETWEEN {W['x0']} AND {W['x1']} AND y BETWEEN {W['y0']} AND {W['y1']}) q WHERE rn = 1"
Q["all_texts"] = "SELECT t.s, count(*) AS records, CAST(sum(p.na * p.nb) AS BIGINT) AS members FROM lay_place p JOIN lay_text t ON t.cell = p.child GROUP BY t.s"
Q["text_thinning"] = "SELECT cell, s, rn FROM (SELECT cell, s, row_number() OVER (PARTITION BY layer ORDER BY cell) AS rn FROM lay_text) q WHERE (rn - 1) % 4 = 0"
Q["block_name_fit"] = """SELECT cell, turned, CASE WHEN tall >= 9 AND length(name) <= room THEN name WHEN room < 3 OR tall < 4 THEN NULL WHEN tall >= 9 THEN concat(substr(name, 1, CAST(room - 3 AS INT)), '...') ELSE '...' END AS label
  FROM (SELECT cell, name, CASE WHEN h > w THEN 1 ELSE 0 END AS turned, greatest(w, h) DIV 7 AS room, least(w, h) AS tall FROM (SELECT r.cell, c.p_name AS name, r.w, r.h FROM lay_rect r JOIN part c ON c.p_partkey = r.cell) a) q"""
Q["skeleton"] = "SELECT parent, layer, x0, y0, x1, y1, rn FROM (SELECT parent, layer, x0, y0, x1, y1, row_number() OVER (ORDER BY (x1 - x0) * (y1 - y0) DESC, layer, x0, y0, x1, y1, parent) AS rn FROM flat_rect WHERE x1 - x0 >= 100 OR y1 - y0 >= 100) q WHERE rn <= 500"

# --- violations
Q["drc_rules"] = "SELECT rule, count(*) AS errors, CAST(sum(status) AS BIGINT) AS waived, min(x0) AS min_x0, min(y0) AS min_y0, max(x0 + w) AS max_x1, max(y0 + h) AS max_y1 FROM drc_raw GROUP BY rule"
Q["drc_query_rect"] = "SELECT rule, lnum, gnum, kind FROM (SELECT rule, lnum, gnum, kind, row_number() OVER (ORDER BY gnum) AS rn FROM drc_error WHERE status = 0 AND x0 <= 500000 AND x0 + w >= 200000 AND y0 <= 500000 AND y0 + h >= 200000) z WHERE rn <= 200"
Q["drc_numbers"] = "SELECT event_id, rule, gnum, lnum FROM drc_error"
Q["drc_totals"] = "SELECT count(*) AS errors, count(DISTINCT rule) AS rules, CAST(sum(CASE WHEN kind = 'p' THEN 1 ELSE 0 END) AS BIGINT) AS polygons FROM drc_raw"
Q["drc_block_bbox"] = "SELECT rule, (lnum - 1) DIV 64 AS block, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM drc_error GROUP BY rule, (lnum - 1) DIV 64"
Q["drc_page"] = "SELECT rule, lnum, pos FROM (SELECT rule, lnum, row_number() OVER (PARTITION BY rule ORDER BY lnum) AS pos FROM drc_error WHERE status = 0) q WHERE pos > 20 AND pos <= 50"
Q["drc_rank"] = "SELECT rule, lnum, status, before FROM (SELECT rule, lnum, status, CAST(coalesce(sum(CASE WHEN status = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY rule ORDER BY lnum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM drc_error) q WHERE status = 0"
Q["drc_step"] = """SELECT rule, lnum, coalesce(lead(lnum) OVER (PARTITION BY rule ORDER BY lnum), min(lnum) OVER (PARTITION BY rule)) AS nxt,
  coalesce(lag(lnum) OVER (PARTITION BY rule ORDER BY lnum), max(lnum) OVER (PARTITION BY rule)) AS prv FROM drc_error WHERE status = 0"""
Q["drc_grid_page"] = "SELECT gnum, cell FROM (SELECT gnum, row_number() OVER (ORDER BY gnum) - 1 AS cell FROM drc_error WHERE rule IN ('CLICK.0', 'VIEW.1') AND status = 0) q WHERE cell >= 50 AND cell < 1050"
Q["drc_waive_counts"] = "SELECT rule, CAST(sum(CASE WHEN status = 1 THEN 1 ELSE 0 END) AS BIGINT) AS waived, CAST(sum(CASE WHEN status <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS open_errors FROM drc_raw GROUP BY rule"
Q["drc_error_spec"] = "SELECT rule, lnum FROM drc_error WHERE lnum BETWEEN 5 AND 9"
Q["drc_frame_window"] = """SELECT event_id, frac, cx - half AS wx0, cx + half AS wx1, cy - half AS wy0, cy + half AS wy1 FROM (SELECT event_id, frac, CAST(x0 + x0 + w AS DOUBLE) / 2 AS cx, CAST(y0 + y0 + h AS DOUBLE) / 2 AS cy,
  CASE WHEN greatest(w, h) = 0 THEN CAST(100 AS DOUBLE) ELSE CAST(greatest(w, h) AS DOUBLE) END / least(greatest(frac, 0.02), 1.0) / 2 AS half FROM drc_raw JOIN (SELECT * FROM (VALUES (CAST(0.25 AS DOUBLE)), (CAST(0.001 AS DOUBLE)), (CAST(4.0 AS DOUBLE))) AS t(frac)) f ON true) q"""
Q["drc_latest_status"] = "SELECT event_id, status FROM (SELECT event_id, status, row_number() OVER (PARTITION BY event_id ORDER BY seq DESC) AS rn FROM drc_status_log) q WHERE rn = 1"
Q["drc_status_counts"] = "SELECT status, count(*) AS n FROM (SELECT event_id, status, row_number() OVER (PARTITION BY event_id ORDER BY seq DESC) AS rn FROM drc_status_log) q WHERE rn = 1 GROUP BY status"
Q["drc_batch_waive"] = "SELECT rule, event_id, new_status, CAST(3 AS BIGINT) AS seq FROM (SELECT rule, event_id, status, CASE WHEN min(status) OVER (PARTITION BY rule) = 1 THEN 0 ELSE 1 END AS new_status FROM drc_raw WHERE event_id % 13 = 0) q WHERE new_status <> status"
Q["drc_cd_value"] = "SELECT event_id, kind, CASE WHEN kind = 'p' THEN least(w, h) ELSE w END AS cd, CASE WHEN kind = 'p' THEN w * h ELSE 0 END AS area FROM drc_raw"
Q["drc_measured_bound"] = """SELECT e.event_id, c.metric, c.op, m.measured, CAST(m.measured AS DOUBLE) - c.value AS delta FROM drc_raw e JOIN (SELECT check_name, metric, op, CAST(value AS DOUBLE) AS value, row_number() OVER (PARTITION BY check_name ORDER BY CASE WHEN op IN ('<', '<=', '==') THEN 0 ELSE 1 END, ord) AS rn FROM deck_constraints) c ON c.check_name = e.rule AND c.rn = 1
  JOIN (SELECT event_id, CASE WHEN kind = 'p' THEN least(w, h) ELSE w END AS measured FROM drc_raw) m ON m.event_id = e.event_id"""
Q["drc_area_perimeter"] = "SELECT rule, CAST(sum(w * h) AS BIGINT) AS area, CAST(sum(2 * (w + h)) AS BIGINT) AS perimeter FROM drc_raw WHERE kind = 'p' GROUP BY rule"
Q["rule_search"] = "SELECT rule, count(*) AS errors FROM drc_raw WHERE lower(rule) LIKE '%ic%' GROUP BY rule"
Q["rule_types"] = "SELECT coalesce(c.metric, 'other') AS metric, count(*) AS rules FROM (SELECT DISTINCT rule FROM drc_raw) r LEFT JOIN (SELECT check_name, min(metric) AS metric FROM deck_constraints GROUP BY check_name) c ON c.check_name = r.rule GROUP BY coalesce(c.metric, 'other')"
Q["rule_match"] = "SELECT count(*) AS rules, CAST(sum(CASE WHEN c.check_name IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS matched FROM (SELECT DISTINCT rule FROM drc_raw) r LEFT JOIN (SELECT DISTINCT check_name FROM deck_check_operands) c ON c.check_name = r.rule"

# --- deck
Q["deck_layer_resolution"] = "SELECT l.name, coalesce(m.gds, l.spec) AS gds, CASE WHEN m.gds IS NOT NULL THEN m.dt ELSE l.spec_dt END AS dt FROM deck_layers l LEFT JOIN deck_layer_maps m ON m.target = l.spec"
Q["deck_isolation"] = "SELECT DISTINCT k.layer, k.dt, k.name FROM layer_keys k JOIN (SELECT coalesce(m.gds, l.spec) AS gds, CASE WHEN m.gds IS NOT NULL THEN m.dt ELSE l.spec_dt END AS dt FROM deck_layers l LEFT JOIN deck_layer_maps m ON m.target = l.spec WHERE l.name IN ('L2', 'L4', 'L6')) g ON k.layer = g.gds AND (g.dt IS NULL OR g.dt = k.dt)"
Q["deck_scan"] = "SELECT metric, op, count(*) AS n FROM deck_constraints GROUP BY metric, op"

# --- rasters
TEX = 20000
Q["coverage_raster"] = f"SELECT layer, cx, cy, CAST(sum((least(x1, (cx + 1) * {TEX}) - greatest(x0, cx * {TEX})) * (least(y1, (cy + 1) * {TEX}) - greatest(y0, cy * {TEX}))) AS BIGINT) AS covered FROM (SELECT layer, x0, y0, x1, y1, tx + g.i AS cx, ty + k.j AS cy FROM (SELECT layer, x0, y0, x1, y1, @floor(x0, {TEX}) AS tx, @floor(y0, {TEX}) AS ty, @floor(x1 - 1, {TEX}) - @floor(x0, {TEX}) + 1 AS nx, @floor(y1 - 1, {TEX}) - @floor(y0, {TEX}) + 1 AS ny FROM flat_rect WHERE x1 > x0 AND y1 > y0) q, @series(g, i, nx), @series(k, j, ny)) z GROUP BY layer, cx, cy"
Q["coverage_mip"] = f"SELECT layer, @floor(cx, 2) AS cx, @floor(cy, 2) AS cy, CAST(sum(covered) AS BIGINT) AS covered FROM ({Q['coverage_raster']}) base GROUP BY layer, @floor(cx, 2), @floor(cy, 2)"
Q["coverage_view"] = f"SELECT cx, cy, max(covered) AS densest FROM ({Q['coverage_raster']}) base WHERE cx BETWEEN 5 AND 30 AND cy BETWEEN 1 AND 10 GROUP BY cx, cy"
#: Marked raster cells joined to spans along each row, then equal spans of adjacent rows to rectangles.
Q["lod_rectangles"] = f"""SELECT layer, x0, x1, min(cy) AS y0, max(cy) AS y1 FROM (
  SELECT layer, x0, x1, cy, cy - row_number() OVER (PARTITION BY layer, x0, x1 ORDER BY cy) AS grp FROM (
    SELECT layer, cy, min(cx) AS x0, max(cx) AS x1 FROM (
      SELECT layer, cx, cy, cx - row_number() OVER (PARTITION BY layer, cy ORDER BY cx) AS run FROM (SELECT DISTINCT layer, @floor((x0 + x1) DIV 2, {TEX}) AS cx, @floor((y0 + y1) DIV 2, {TEX}) AS cy FROM flat_rect WHERE x0 >= 0 AND y0 >= 0) c) r GROUP BY layer, cy, run) s) t GROUP BY layer, x0, x1, grp"""

# --- sessions
#: The newest request of a kind runs; purchases stand for clips, which all run.
Q["request_coalesce"] = "SELECT session, kind, gen FROM (SELECT user_id AS session, event_type AS kind, event_id AS gen, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) q WHERE rn = 1 OR kind = 'purchase'"
Q["selection_toggle"] = """SELECT event_id FROM (SELECT event_id, 1 AS n FROM drc_raw WHERE rule = 'CLICK.0' AND event_id % 3 <> 0 UNION ALL SELECT event_id, 1 FROM drc_raw WHERE event_id % 97 = 0) t GROUP BY event_id HAVING count(*) % 2 = 1
  UNION SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS pos FROM drc_raw WHERE rule = 'VIEW.1') r WHERE pos BETWEEN 3 AND 9"""
Q["region_difference"] = """SELECT layer, w, h, CAST(sum(a) AS BIGINT) AS in_first, CAST(sum(b) AS BIGINT) AS in_second FROM (SELECT layer, w, h, 1 AS a, 0 AS b FROM lay_rect UNION ALL SELECT layer, w, h, 0, 1 FROM lay_rect WHERE cell % 2 = 0) q GROUP BY layer, w, h HAVING sum(a) <> sum(b)"""
