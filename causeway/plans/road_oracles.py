"""DuckDB SQL of the road queries, written apart from the operators."""

from __future__ import annotations

from causeway.plans.bindings import SCENARIOS
from causeway.plans.pixel_oracles import ctes

_SPEED = "CASE highway WHEN 'primary' THEN 70e0 WHEN 'secondary' THEN 60e0 WHEN 'tertiary' THEN 50e0 WHEN 'residential' THEN 30e0 END"
_STATED = "CASE WHEN regexp_matches(lower(maxspeed), '^\\s*\\d+(\\.\\d+)?\\s*(mph|km/h|kph)?\\s*$') THEN regexp_extract(maxspeed, '\\d+(\\.\\d+)?')::DOUBLE * CASE WHEN lower(maxspeed) LIKE '%mph%' THEN 1.609344e0 ELSE 1e0 END END"
_WAYS = ctes("way_v", "way_node_v", "node_v", "facility_v", "origin_v", "surface_v") + f""", w0 AS (SELECT *, {_STATED} AS stated, {_SPEED} AS fallback,
  CASE WHEN highway NOT IN ('primary', 'secondary', 'tertiary', 'residential') THEN 'class_outside_contract' WHEN access = 'private' THEN 'motor_access_restricted_or_area' WHEN oneway = 'reversible' THEN 'unsupported_direction' END AS reject_reason,
  CASE WHEN oneway = 'yes' THEN 1 WHEN oneway = '-1' THEN -1 WHEN oneway IS NOT NULL THEN NULL WHEN junction = 'roundabout' THEN 1 ELSE 0 END AS direction,
  CASE WHEN oneway = 'yes' THEN 'explicit_forward' WHEN oneway = '-1' THEN 'explicit_reverse' WHEN oneway IS NOT NULL THEN 'unsupported_oneway:' || oneway WHEN junction = 'roundabout' THEN 'inferred_one_way' ELSE 'assumed_two_way_unmarked' END AS direction_source,
  coalesce(bridge NOT IN ('no', '0', 'false'), false) AS is_bridge, coalesce(tunnel NOT IN ('no', '0', 'false'), false) AS is_tunnel, try_cast(coalesce(layer, '0') AS BIGINT) AS level FROM way_v WHERE way_id IN (SELECT way_id FROM way_node_v)),
w AS (SELECT *, CASE WHEN stated BETWEEN 5 AND 140 THEN stated ELSE fallback END AS kmh, CASE WHEN stated BETWEEN 5 AND 140 THEN 'explicit_maxspeed' ELSE 'class_assumption' END AS speed_source FROM w0),
st AS (SELECT p.way_id, p.idx::BIGINT AS idx, p.node AS a, q.node AS b, p.l_discount, p.l_tax FROM way_node_v p JOIN way_node_v q ON p.way_id = q.way_id AND q.idx = p.idx + 1),
sg0 AS (SELECT concat('osm:', st.way_id, ':', idx) AS segment_id, st.way_id, idx, a, b, na.x_m AS ax, na.y_m AS ay, nb.x_m AS bx, nb.y_m AS by_, sqrt((na.x_m - nb.x_m) * (na.x_m - nb.x_m) + (na.y_m - nb.y_m) * (na.y_m - nb.y_m)) AS length_m,
  highway, direction, kmh, speed_source, is_bridge, is_tunnel, level, l_discount, l_tax FROM st JOIN w ON st.way_id = w.way_id JOIN node_v na ON a = na.node_id JOIN node_v nb ON b = nb.node_id WHERE reject_reason IS NULL AND a <> b),
sg AS (SELECT *, length_m / kmh * 3.6e0 AS cost FROM sg0 WHERE length_m >= 0.01e0),
ed AS (SELECT concat(segment_id, ':', s, '>', t) AS edge_id, * FROM (SELECT a AS s, b AS t, * FROM sg WHERE direction >= 0 UNION ALL SELECT b AS s, a AS t, * FROM sg WHERE direction <= 0)) """
_W = "WITH RECURSIVE " + _WAYS
_KEYS = "SELECT scenario_id, threshold, policy, rule FROM (SELECT unnest([{names}]) AS scenario_id, unnest([{values}]) AS threshold) CROSS JOIN (SELECT unnest(['supported_overlap', 'retained_overlap', 'supported_plus_within_tile_unknown', 'supported_plus_all_unknown']) AS policy) CROSS JOIN (SELECT unnest(['bridge_exempt', 'bridge_candidate']) AS rule)"


def _closed(names: list[str] | None = None) -> str:
    own = names or list(SCENARIOS)
    keys = _KEYS.format(names=", ".join(f"'{n}'" for n in own), values=", ".join(f"{SCENARIOS[n]}e0" for n in own))
    return f""", ky AS (SELECT concat_ws('|', scenario_id, policy, rule) AS scenario_key, * FROM ({keys})),
ev AS (SELECT segment_id, length_m, ax BETWEEN 100 AND 800 AND bx BETWEEN 100 AND 800 AND ay BETWEEN 0 AND 1010 AND by_ BETWEEN 0 AND 1010 AS seen, CASE WHEN l_tax < 0.04e0 THEN length_m ELSE length_m * 0.6e0 END AS retained, l_discount, is_bridge, is_tunnel FROM sg),
cl AS (SELECT * FROM (SELECT scenario_key, scenario_id, policy, rule, segment_id, CASE WHEN seen AND l_discount >= threshold AND (CASE WHEN policy = 'retained_overlap' THEN retained ELSE length_m END) >= 15 AND NOT is_tunnel AND (NOT is_bridge OR rule = 'bridge_candidate')
    THEN CASE WHEN policy = 'retained_overlap' THEN 'retained_overlap' ELSE 'supported_overlap' END
  WHEN policy = 'supported_plus_within_tile_unknown' AND seen AND length_m > 0 AND retained < length_m - 1e-6 THEN 'within_tile_unknown'
  WHEN policy = 'supported_plus_all_unknown' AND (NOT seen OR retained < length_m - 1e-6) THEN 'outside_or_partial_unknown' END AS reason FROM ev CROSS JOIN ky) WHERE reason IS NOT NULL) """


def _spread(keys: str, barred: bool) -> str:
    """Costs by relaxation over a fixed number of hops, beyond what these graphs need."""
    bar = "WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl.scenario_key = d.scenario_key AND cl.segment_id = e.segment_id)" if barred else ""
    return f""", d AS (SELECT 0 AS hop, k.scenario_key, f.node, 0e0 AS cost, min(f.facility_id) AS facility FROM ({keys}) k CROSS JOIN facility_v f WHERE f.node IN (SELECT s FROM ed UNION SELECT t FROM ed) GROUP BY k.scenario_key, f.node
 UNION ALL SELECT hop + 1, scenario_key, node, cost, facility FROM (SELECT *, row_number() OVER (PARTITION BY scenario_key, node ORDER BY cost, facility) AS n FROM
 (SELECT hop, scenario_key, node, cost, facility FROM d UNION ALL SELECT d.hop, d.scenario_key, e.s, d.cost + e.cost, d.facility FROM d JOIN ed e ON e.t = d.node {bar})) WHERE n = 1 AND hop < 24),
 sv AS (SELECT scenario_key, node, cost, facility FROM d WHERE hop = 24) """


_BASE = _spread("SELECT 'baseline' AS scenario_key", False)


def _access(names: list[str] | None = None) -> str:
    return _closed(names) + _spread("SELECT scenario_key FROM ky UNION ALL SELECT 'baseline'", True) + """, ar AS (SELECT ky.scenario_key, o.origin_id, x.facility, x.cost, z.cost AS base, x.cost - z.cost AS delta FROM origin_v o CROSS JOIN ky
 LEFT JOIN sv z ON z.scenario_key = 'baseline' AND z.node = o.node LEFT JOIN sv x ON x.scenario_key = ky.scenario_key AND x.node = o.node) """


_BOX = "200e0, 200e0, 700e0, 650e0".split(", ")


def _edge(p: str, d: str, low: str, high: str, f: str, none: str) -> str:
    return f"CASE WHEN {d} = 0 THEN {none} ELSE {f}(({low} - {p}) / nullif({d}, 0), ({high} - {p}) / nullif({d}, 0)) END"


_CLIP = f""", c0 AS (SELECT *, greatest(0e0, {_edge('ax', '(bx - ax)', _BOX[0], _BOX[2], 'least', '0e0')}, {_edge('ay', '(by_ - ay)', _BOX[1], _BOX[3], 'least', '0e0')}) AS t0,
 least(1e0, {_edge('ax', '(bx - ax)', _BOX[0], _BOX[2], 'greatest', '1e0')}, {_edge('ay', '(by_ - ay)', _BOX[1], _BOX[3], 'greatest', '1e0')}) AS t1,
 (bx <> ax OR ax BETWEEN {_BOX[0]} AND {_BOX[2]}) AND (by_ <> ay OR ay BETWEEN {_BOX[1]} AND {_BOX[3]}) AS fine FROM sg), cp AS (SELECT *, (t1 - t0) * length_m AS within_m FROM c0 WHERE fine AND t0 <= t1) """
_SAMPLES = """, n0 AS (SELECT *, greatest(1, cast(ceil(within_m / 15e0) AS BIGINT)) AS n FROM cp WHERE within_m > 0), sm AS (SELECT segment_id, length_m, within_m, within_m / n AS weight, ax + (t0 + (t1 - t0) * ((i + 0.5e0) / n)) * (bx - ax) AS x, ay + (t0 + (t1 - t0) * ((i + 0.5e0) / n)) * (by_ - ay) AS y FROM (SELECT *, unnest(range(0, n)) AS i FROM n0)) """
_ROADEV = """, pe AS MATERIALIZED (SELECT * FROM surface_v),
 re AS (SELECT segment_id, any_value(length_m) AS length_m, any_value(within_m) AS within_tile_m, coalesce(sum(weight) FILTER (eligible), 0e0) AS supported_m, coalesce(sum(weight) FILTER (eligible AND abs(p - 0.5e0) > 0.15e0), 0e0) AS retained_m,
 coalesce(sum(weight) FILTER (eligible AND flags <> 0), 0e0) AS flagged_m, coalesce(sum(weight) FILTER (eligible AND p >= 0.5e0), 0e0) AS water_m, sum(weight * p) FILTER (eligible) AS weighted
 FROM sm LEFT JOIN pe ON px_row = cast(floor(y / 25e0) AS BIGINT) AND px_col = cast(floor(x / 25e0) AS BIGINT) GROUP BY 1) """


def _turn(a: str, b: str, c: str) -> str:
    (ax, ay), (bx, by), (cx, cy) = a.split("/"), b.split("/"), c.split("/")
    return f"sign(({bx} - {ax}) * ({cy} - {ay}) - ({by} - {ay}) * ({cx} - {ax}))"


_P = [f"l.{x}/l.{y}" for x, y in (("ax", "ay"), ("bx", "by_"))] + [f"r.{x}/r.{y}" for x, y in (("ax", "ay"), ("bx", "by_"))]
_CROSS = f""", sx AS MATERIALIZED (SELECT * REPLACE (way_id * 8e0 + a * 7919 % 97 AS ax, (a * 104729 % 401)::DOUBLE AS ay, way_id * 8e0 + b * 7919 % 97 AS bx, (b * 104729 % 401)::DOUBLE AS by_) FROM sg), cr AS (SELECT l.segment_id AS left_id, r.segment_id AS right_id, l.is_bridge OR r.is_bridge OR l.is_tunnel OR r.is_tunnel OR l.level IS DISTINCT FROM r.level AS grade_tagged FROM sx l JOIN sx r ON l.segment_id < r.segment_id
 AND least(l.ax, l.bx) <= greatest(r.ax, r.bx) AND least(r.ax, r.bx) <= greatest(l.ax, l.bx) WHERE l.a NOT IN (r.a, r.b) AND l.b NOT IN (r.a, r.b)
 AND {_turn(_P[0], _P[1], _P[2])} * {_turn(_P[0], _P[1], _P[3])} < 0 AND {_turn(_P[2], _P[3], _P[0])} * {_turn(_P[2], _P[3], _P[1])} < 0) """
_COMP = """, li AS (SELECT s AS u, t AS v FROM ed UNION SELECT t, s FROM ed), co AS (SELECT 0 AS hop, u AS node, u AS component FROM (SELECT DISTINCT u FROM li)
 UNION ALL SELECT hop + 1, node, min(component) FROM (SELECT hop, node, component FROM co UNION ALL SELECT co.hop, li.v, co.component FROM co JOIN li ON li.u = co.node) WHERE hop < 24 GROUP BY hop, node), wc AS (SELECT node, component FROM co WHERE hop = 24) """
_RING = [(100, 100), (800, 200), (600, 900), (400, 500), (100, 100)]
_SIDES = list(zip(_RING, _RING[1:]))
_COVER = " + ".join(f"CASE WHEN ({p[1]} > y_m) <> ({q[1]} > y_m) AND x_m < ({q[0]} - {p[0]}) * (y_m - {p[1]}) / ({q[1]} - {p[1]})::DOUBLE + {p[0]} THEN 1 ELSE 0 END" for p, q in _SIDES)
_ON = " OR ".join(
    f"(({q[0]} - {p[0]}) * (y_m - {p[1]}) - ({q[1]} - {p[1]}) * (x_m - {p[0]}) = 0 AND x_m BETWEEN {min(p[0], q[0])} AND {max(p[0], q[0])} AND y_m BETWEEN {min(p[1], q[1])} AND {max(p[1], q[1])})" for p, q in _SIDES
)
_RUNS = "WITH " + ctes("run_v") + " "

ORACLES: dict[str, str] = {
    "road_class_filter": _W + "SELECT reject_reason, count(*) AS ways FROM w WHERE reject_reason IS NOT NULL GROUP BY 1",
    "road_speed": _W + "SELECT way_id, round(kmh, 6) AS kmh, speed_source AS source FROM w WHERE reject_reason IS NULL",
    "travel_direction": _W + "SELECT way_id, direction::BIGINT AS direction, direction_source AS source FROM w",
    "layer_parse": _W + "SELECT way_id, is_bridge AS bridge, is_tunnel AS tunnel, level AS layer FROM w",
    "way_segments": _W + "SELECT way_id, idx, a, b FROM st",
    "directed_edges": _W + "SELECT edge_id, segment_id, s AS source, t AS target, round(cost, 6) AS cost_seconds FROM ed",
    "edge_costs": _W + "SELECT highway, speed_source, count(*) AS edges, round(sum(length_m), 3) AS length_m, round(sum(cost), 3) AS cost_seconds FROM ed GROUP BY 1, 2",
    "graph_quality": _W + _COMP + ", cs AS (SELECT component, count(*) AS n FROM wc GROUP BY 1) SELECT (SELECT count(*) FROM cs) AS weak_components, (SELECT max(n) FROM cs) AS largest_component, (SELECT sum(n)::BIGINT FROM cs) AS graph_nodes, count(*) AS directed_edges, count(DISTINCT segment_id) AS physical_segments, round(sum(length_m), 3) AS total_length_m FROM ed",
    "weak_components": _W + _COMP + "SELECT node, component FROM wc",
    "nearest_facility": _W + _BASE + "SELECT node, round(cost, 6) AS cost_seconds, facility AS facility_id FROM sv",
    "path_audit": _W + _BASE + """, nx AS (SELECT node, target FROM (SELECT v.node, e.t AS target, row_number() OVER (PARTITION BY v.node ORDER BY e.edge_id) AS n FROM sv v JOIN ed e ON e.s = v.node JOIN sv u ON u.node = e.t WHERE v.cost = u.cost + e.cost AND v.facility = u.facility AND v.node NOT IN (SELECT node FROM facility_v)) WHERE n = 1),
        bb AS (SELECT min(x_m) AS x0, max(x_m) AS x1, min(y_m) AS y0, max(y_m) AS y1 FROM node_v), mg AS (SELECT node_id AS node, least(x_m - x0, x1 - x_m, y_m - y0, y1 - y_m) AS margin FROM node_v CROSS JOIN bb),
        wk AS (SELECT o.origin_id, o.node, 0::BIGINT AS hops, m.margin AS border_m FROM origin_v o JOIN sv ON sv.node = o.node JOIN mg m ON m.node = o.node UNION ALL SELECT wk.origin_id, nx.target, wk.hops + 1, least(wk.border_m, m.margin) FROM wk JOIN nx ON nx.node = wk.node JOIN mg m ON m.node = nx.target)
        SELECT origin_id, node AS end_node, hops, round(border_m, 6) AS border_m FROM (SELECT *, row_number() OVER (PARTITION BY origin_id ORDER BY hops DESC) AS n FROM wk) WHERE n = 1""",
    "closure_ids": _W + _closed() + "SELECT scenario_key, segment_id, reason FROM cl",
    "closure_reasons": _W + _closed() + "SELECT scenario_key, reason, count(*) AS segments FROM cl GROUP BY 1, 2",
    "policy_grid": _W + _closed() + "SELECT scenario_key, scenario_id, policy, rule AS bridge_rule, (SELECT count(*) FROM origin_v) AS origins FROM ky",
    "batched_scenario_cost": _W + _access() + "SELECT scenario_key, count(*) AS reached_nodes, round(sum(cost), 3) AS total_cost_seconds FROM sv GROUP BY 1",
    "access_rows": _W + _access() + "SELECT scenario_key, origin_id, facility AS nearest_facility_id, round(cost, 6) AS estimated_cost_seconds, round(base, 6) AS baseline_cost_seconds, round(delta, 6) AS cost_delta_seconds, base IS NULL AS baseline_unreachable, base IS NOT NULL AND cost IS NULL AS newly_disconnected, CASE WHEN cost IS NULL THEN 'no_graph_path' END AS reason FROM ar",
    "access_summary_by_policy": _W + _access() + """SELECT scenario_id, policy, rule AS bridge_rule, count(*) AS origins, count(*) FILTER (base IS NULL) AS baseline_unreachable, count(*) FILTER (base IS NOT NULL AND cost IS NULL) AS newly_disconnected, count(delta) AS paired_reachable,
        round(avg(delta), 5) AS mean_increase_seconds, round(max(delta), 6) AS greatest_increase_seconds, count(*) FILTER (delta < -1e-7) AS improved FROM ar JOIN ky ON ar.scenario_key = ky.scenario_key GROUP BY 1, 2, 3""",
    "ranking_reversals": _W + _access() + """, pr AS (SELECT a.scenario_key, (a.base < b.base) <> (a.cost < b.cost) AS flipped FROM ar a JOIN ar b ON a.scenario_key = b.scenario_key AND a.origin_id < b.origin_id WHERE a.delta IS NOT NULL AND b.delta IS NOT NULL
        AND abs(a.base - b.base) > 1e-9 * greatest(abs(a.base), abs(b.base)) AND abs(a.cost - b.cost) > 1e-9 * greatest(abs(a.cost), abs(b.cost))) SELECT scenario_key, count(*) AS comparable_pairs, count(*) FILTER (flipped) AS reversed_pairs, round(count(*) FILTER (flipped) / count(*)::DOUBLE, 6) AS reversal_fraction FROM pr GROUP BY 1""",
    "access_stability": _W + _access() + "SELECT origin_id, count(*) AS members, count(cost) AS reachable_members, round(min(cost), 6) AS least_cost_seconds, round(max(cost), 6) AS greatest_cost_seconds, count(*) FILTER (base IS NOT NULL AND cost IS NULL) AS newly_disconnected FROM ar GROUP BY 1",
    "first_disconnected": _W + _access() + "SELECT scenario_key, min(origin_id) FILTER (base IS NOT NULL AND cost IS NULL) AS origin_id FROM ar GROUP BY 1",
    "origin_overview": _W + _access() + "SELECT ar.origin_id, x_m, y_m, round(max(base), 6) AS baseline_cost_seconds, count(cost) AS reachable_members, round(max(cost), 6) AS greatest_cost_seconds FROM ar JOIN origin_v o ON o.origin_id = ar.origin_id JOIN node_v ON node_id = o.node GROUP BY 1, 2, 3",
    "origin_table_sorted": _W + _access() + "SELECT origin_id, round(cost, 6) AS estimated_cost_seconds, row_number() OVER (ORDER BY cost NULLS LAST, origin_id) AS place FROM ar WHERE scenario_key = 'wet_05|supported_overlap|bridge_exempt'",
    "scenario_lookup": _W + _closed() + "SELECT segment_id, reason FROM cl WHERE scenario_key = 'wet_05|retained_overlap|bridge_candidate'",
    "road_lookup": _W + _closed() + "SELECT sg.segment_id, highway, CASE WHEN seen THEN 'within_image' ELSE 'outside_image_unknown' END AS state, CASE WHEN seen THEN round(sg.length_m, 6) END AS supported_m, CASE WHEN seen THEN round(retained, 6) END AS retained_m FROM sg JOIN ev ON sg.segment_id = ev.segment_id",
    "export_row": _W + _closed() + """SELECT scenario_key, '{"key":"' || scenario_key || '","closed":' || count(*) || '}' AS document FROM cl GROUP BY scenario_key""",
    "bundle_integrity": _W + _closed() + """, gn AS (SELECT s AS node FROM ed UNION SELECT t FROM ed) SELECT 'evidence_in_roads' AS rule, count(*) AS missing FROM ev WHERE segment_id NOT IN (SELECT segment_id FROM sg) UNION ALL SELECT 'water_in_evidence', 0
        UNION ALL SELECT 'facility_in_graph', count(*) FROM facility_v WHERE node NOT IN (SELECT node FROM gn) UNION ALL SELECT 'origin_in_graph', count(*) FROM origin_v WHERE node NOT IN (SELECT node FROM gn)""",
    "snap_points": "WITH " + ctes("point_v", "node_v") + """, k AS (SELECT point_id, p.x_m AS x, p.y_m AS y, min(struct_pack(d := sqrt((p.x_m - n.x_m) * (p.x_m - n.x_m) + (p.y_m - n.y_m) * (p.y_m - n.y_m)), node := node_id)) AS b FROM point_v p CROSS JOIN node_v n GROUP BY 1, 2, 3),
        s AS (SELECT *, CASE WHEN NOT (x BETWEEN 50 AND 950 AND y BETWEEN 50 AND 950) THEN 'outside_study_bbox' WHEN b.d <= 12 THEN 'snapped' ELSE 'beyond_snap_limit' END AS status FROM k)
        SELECT point_id, status, CASE WHEN status = 'snapped' THEN b.node END AS nearest_node_id, round(b.d, 6) AS nearest_distance_m, CASE WHEN status = 'outside_study_bbox' THEN 0e0 ELSE round(least(x - 50, 950 - x, y - 50, 950 - y), 6) END AS boundary_distance_m FROM s""",
    "hospital_radius": "WITH " + ctes("point_v") + ", m AS (SELECT point_id, sqrt((x_m - 500) * (x_m - 500) + (y_m - 500) * (y_m - 500)) AS d FROM point_v) SELECT point_id, round(d, 6) AS distance_m FROM m WHERE d <= 250",
    "segment_clip": _W + _CLIP + "SELECT segment_id, round(t0, 6) AS t0, round(t1, 6) AS t1, round(within_m, 6) AS within_m FROM cp",
    "line_samples": _W + _CLIP + _SAMPLES + "SELECT segment_id, count(*) AS samples, round(sum(weight), 5) AS weight FROM sm GROUP BY 1",
    "road_evidence": _W + _CLIP + _SAMPLES + _ROADEV + """SELECT segment_id, round(length_m + 1e-9, 5) AS length_m, round(within_tile_m + 1e-9, 5) AS within_tile_m, round(supported_m + 1e-9, 5) AS supported_m, round(retained_m + 1e-9, 5) AS retained_m, round(flagged_m + 1e-9, 5) AS flagged_m, round(water_m + 1e-9, 5) AS water_m,
        round(greatest(0e0, length_m - supported_m) + 1e-9, 5) AS unknown_m, round(least(1e0, supported_m / length_m) + 1e-9, 5) AS coverage, round(weighted / nullif(supported_m, 0) + 1e-9, 5) AS mean_score FROM re""",
    "length_contract": _W + _CLIP + _SAMPLES + _ROADEV + "SELECT count(*) AS segments, count(*) FILTER (within_tile_m > length_m + 1e-5 OR supported_m > within_tile_m + 1e-5 OR retained_m > supported_m + 1e-5 OR water_m > supported_m + 1e-5) AS broken FROM re",
    "crossing_audit": _W + _CROSS + "SELECT count(*) AS crossings, count(*) FILTER (grade_tagged) AS grade_tagged, count(*) FILTER (NOT grade_tagged) AS untagged FROM cr",
    "crossing_examples": _W + _CROSS + "SELECT left_id, right_id, grade_tagged FROM cr ORDER BY left_id, right_id LIMIT 10",
    "polygon_cover": "WITH " + ctes("node_v") + f" SELECT node_id FROM node_v WHERE {_ON} OR ({_COVER}) % 2 = 1",
    "latest_run": _RUNS + "SELECT milestone, run_id FROM (SELECT *, row_number() OVER (PARTITION BY milestone ORDER BY completed_at DESC, run_id DESC) AS n FROM run_v WHERE status = 'complete' AND hash_ok) WHERE n = 1",
    "status_ladder": _RUNS + "SELECT milestone, run_id, hash_ok AND reference < 4 AS valid FROM (SELECT *, row_number() OVER (PARTITION BY milestone ORDER BY completed_at DESC, run_id DESC) AS n FROM run_v WHERE status = 'complete') WHERE n = 1",
    "manifest_files": _RUNS + """, x AS (SELECT DISTINCT concat(milestone, '/', run_id) AS path FROM run_v WHERE hash_ok), y AS (SELECT DISTINCT concat(milestone, '/', run_id) AS path FROM run_v WHERE status = 'complete')
        SELECT status, count(*) AS files FROM (SELECT 'missing' AS status FROM x WHERE path NOT IN (SELECT path FROM y) UNION ALL SELECT 'extra' FROM y WHERE path NOT IN (SELECT path FROM x)) GROUP BY 1""",
    "json_tags": "SELECT event_type, count(*) AS rows, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS sum_k, min(json_extract(props, '$.k')::BIGINT) AS least_k FROM events GROUP BY 1",
}
