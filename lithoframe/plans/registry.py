"""Every query of the engine by name, and its SQL."""

from __future__ import annotations

from functools import partial

from ..operators import bake, density, folds, graph, numbers, rulers, viewplan
from ..operators.pruned import S as PRUNED
from ..operators.sqlset import Q as SQLSET
from . import adapters  # noqa: F401  the views
from .compiler import oracle, run


def _sql(text: str, spark, sf_dir: str):
    return run(spark, sf_dir, text)


Q = SQLSET | density.Q | bake.Q
#: Where S has a text, Spark runs that and the plain text checks it.
QUERIES: dict = {name: partial(_sql, PRUNED.get(name, text)) for name, text in Q.items()}
ORACLES: dict = {name: oracle(text) for name, text in Q.items()}

QUERIES |= {"closure": graph.q_closure, "cell_heights": graph.q_heights, "recursive_members": graph.q_recursive_members}
#: A recursive query keeps its own WITH RECURSIVE in front of the views.
ORACLES |= {"closure": oracle(graph.CLOSURE_SQL), "cell_heights": oracle(graph.HEIGHTS_SQL), "recursive_members": oracle(graph.MEMBERS_SQL)}
QUERIES |= {"density_members": density.q_density_members, "density_instances": density.q_density_instances}
ORACLES |= {"density_members": oracle(density.MEMBERS_SQL), "density_instances": oracle(density.INSTANCES_SQL)}
QUERIES |= {"recursive_boxes": folds.q_recursive_boxes, "recursive_area": folds.q_recursive_area, "lod_cut": folds.q_lod_cut}
ORACLES |= {"recursive_boxes": oracle(folds.BOXES_SQL), "recursive_area": oracle(folds.AREA_SQL), "lod_cut": oracle(folds.LOD_SQL)}
#: Greedy runs are beyond SQL; a test holds them against brute force.
QUERIES |= {"find_grids": folds.q_find_grids}
#: Numbers come after filters; the plain text with its global order checks them.
QUERIES |= {"drc_query_rect": numbers.q_drc_query_rect, "drc_grid_page": numbers.q_drc_grid_page, "marker_hit": numbers.q_marker_hit}
#: Rulers by feet on segments, checked by the form of each shape.
QUERIES |= {"drc_rulers": partial(_sql, rulers.Q_RULERS), "drc_measured_bound": partial(_sql, rulers.Q_MEASURED)}
ORACLES |= {"drc_rulers": oracle(rulers.O_RULERS), "drc_measured_bound": oracle(rulers.O_MEASURED)}
#: The view by windows of cells, checked by a walk of every instance.
QUERIES |= {"view_plan": viewplan.q_view_plan, "view_counters": viewplan.q_view_counters, "flat_deep": viewplan.q_flat_deep}
ORACLES |= {"view_plan": oracle(viewplan.PLAN_SQL), "view_counters": oracle(viewplan.COUNTERS_SQL), "flat_deep": oracle(viewplan.FLAT_SQL)}
QUERIES |= {"coverage_levels": bake.q_coverage_levels, "label_hash": bake.q_label_hash, "derivation_listing": bake.q_derivation_listing}
ORACLES |= {"coverage_levels": oracle(bake.MIP_SQL), "label_hash": oracle(bake.HASH_SQL), "derivation_listing": oracle(bake.LISTING_SQL)}
#: Folds that depend on order, and grids; tests hold them against brute force.
QUERIES |= {"box_sets": bake.q_box_sets, "compact_places": bake.q_compact_places}
