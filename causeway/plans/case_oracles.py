"""DuckDB SQL of the case queries, written apart from the operators."""

from __future__ import annotations

from causeway.plans import pixel_oracles as po
from causeway.plans import road_oracles as ro

_PX = po._PX
_SHIFT = po.word("concat_ws(':', 'm6-block-v1', tile_id, (cast(floor(px_row / 512) AS BIGINT) * 512), (cast(floor(px_col / 512) AS BIGINT) * 512), seed)")
_CASE = _PX + po._MASKS + f""", fx AS (SELECT scenario_id, CASE WHEN eligible THEN cast(ndwi >= cut AS INTEGER) END AS value FROM sc CROSS JOIN (SELECT 'm3_ndwi_reference' AS scenario_id, -0.05e0 AS cut UNION ALL SELECT 'm3_ndwi_threshold_-0.15', -0.05e0 - 0.1e0 UNION ALL SELECT 'm3_ndwi_threshold_+0.05', -0.05e0 + 0.1e0)),
 sh AS (SELECT 'm3_shared_offset_seed_' || seed AS scenario_id, CASE WHEN eligible THEN cast(greatest(least(p + (2 * ({_SHIFT}::DOUBLE / 18446744073709551615::DOUBLE) - 1) * 0.08e0, 1e0), 0e0) >= 1 / (1 + exp(-(2.5e0 * -0.05e0 + 0.2e0))) AS INTEGER) END AS value FROM sc CROSS JOIN (SELECT s::INTEGER AS seed FROM range(601, 609) r(s))),
 cs AS (SELECT scenario_id, count(value) AS known_pixels, coalesce(sum(value), 0)::BIGINT AS water_pixels FROM (SELECT scenario_id, value FROM mk UNION ALL SELECT * FROM fx UNION ALL SELECT * FROM sh) GROUP BY 1) """
_LATE = "0.5e0 / (1 + exp(-greatest(least(vh / 10 + 1, 30e0), -30e0))) + 0.5e0 * greatest(least((ndwi + 1) / 2, 1e0), 0e0)"
_METHODS = {
    "radar_vh": "vh <= -23e0",
    "ndwi": "ndwi >= -0.05e0",
    "mndwi": "mndwi >= 0.15e0",
    "logistic": f"1 / (1 + exp(-greatest(least(0.1e0 + {po._LOGIT}, 30e0), -30e0))) >= 0.5e0",
    "late": f"{_LATE} >= 0.5e0",
}


def _final(source: str) -> str:
    parts = [f"SELECT '{m}' AS method, event_id, tp, fp, fn, tn FROM ({po._conf(hit, source, 'event_id')})" for m, hit in _METHODS.items()]
    iou, f1 = po._ratio("tp", "tp + fp + fn"), po._ratio("2 * tp", "2 * tp + fp + fn")
    return f", fm AS (SELECT *, {iou} AS iou, {f1} AS f1 FROM ({' UNION ALL '.join(parts)})) "


_CELLS = " UNION ALL ".join(
    f"SELECT '{c}' AS condition, event_id, vh, {value} AS value, {present} AS present FROM pl"
    for c, value, present in (
        ("clean", "clean", "true"),
        ("missing_optical", "0e0", "false"),
        ("block_missing", "CASE WHEN hit THEN 0e0 ELSE clean END", "NOT hit"),
        ("block_brightened", "CASE WHEN hit THEN greatest(least(0.65e0 * clean + 0.7e0, 3e0), -3e0) ELSE clean END", "true"),
    )
)
_STRESS = "concat_ws(':', 'm4-stress-v1', tile_id)"

ORACLES: dict[str, str] = {
    "case_scores": _CASE + "SELECT row_number() OVER (ORDER BY CASE WHEN scenario_id = 'm3_ndwi_reference' THEN 0 WHEN scenario_id = 'threshold_0.50' THEN 1 WHEN starts_with(scenario_id, 'm3_') THEN 2 ELSE 3 END, scenario_id) AS place, * FROM cs",
    "case_grid": _CASE + """, pl AS (SELECT unnest(['supported_overlap', 'retained_overlap', 'supported_plus_within_tile_unknown', 'supported_plus_all_unknown']) AS policy), ru AS (SELECT unnest(['bridge_exempt', 'bridge_candidate']) AS bridge_rule)
        SELECT concat_ws('|', scenario_id, policy, bridge_rule) AS scenario_key, scenario_id, policy, bridge_rule, water_pixels FROM cs CROSS JOIN pl CROSS JOIN ru WHERE scenario_id = 'm3_ndwi_reference' OR policy IN ('supported_overlap', 'retained_overlap')""",
    "final_methods": _PX + ", fs AS (SELECT * FROM sc WHERE split = 'final_test')" + _final("fs") + "SELECT event_id, method, tp, fp, fn, tn, 0::BIGINT AS undefined, round(iou, 6) AS iou, round(f1, 6) AS f1 FROM fm",
    "final_macro": _PX + _final("sc") + "SELECT method, round(avg(iou), 6) AS macro_iou, round(avg(f1), 6) AS macro_f1, count(iou) AS defined_events FROM fm GROUP BY 1",
    "final_retention": _PX + """, k AS (SELECT *, abs(p - 0.5e0) > 0.15e0 AND flags = 0 AS kept FROM sc WHERE eligible AND split = 'final_test')
        SELECT event_id, count(DISTINCT tile_id) AS tiles, count(*) AS eligible_pixels, count(*) FILTER (label = 1) AS water_pixels, count(*) FILTER (kept) AS retained_pixels, count(*) FILTER (label = 1 AND NOT kept) AS withheld_water,
        round(count(*) FILTER (label = 1) / count(*)::DOUBLE, 6) AS water_prevalence, round(count(*) FILTER (kept) / count(*)::DOUBLE, 6) AS retained_fraction FROM k GROUP BY 1""",
    "chip_event_join": po._CAT + "SELECT chip, location, r_name AS continent FROM catalog_v JOIN nation ON location = n_name JOIN region ON n_regionkey = r_regionkey",
    "footprint_audit": po._CAT + """, f AS (SELECT chip, tile_key % 5 AS k, greatest(0e0, least(xmax + tile_key % 5 * 0.05e0, xmax) - greatest(xmin + tile_key % 5 * 0.05e0, xmin)) * (ymax - ymin) / ((xmax - xmin) * (ymax - ymin)) AS c FROM catalog_v)
        SELECT chip, round(c, 6) AS coverage, c >= 0.98e0 AS accepted, k = 0 AS same_grid FROM f""",
    "tile_quality": _PX + """SELECT tile_id, count(*) AS pixels, count(*) FILTER (radar_valid) AS radar_valid_pixels, count(*) FILTER (optical_valid) AS optical_valid_pixels, count(*) FILTER (radar_valid AND optical_valid) AS paired_valid_pixels,
        count(label) AS labelled_pixels, count(*) FILTER (eligible) AS eligible_pixels, 0::BIGINT AS broken_masks FROM px GROUP BY 1""",
    "case_observation": _PX + "SELECT event_id, count(*) AS pixels, count(*) FILTER (radar_valid AND optical_valid AND abs(b3 + b8) > 1e-6 AND abs(b3 + b11) > 1e-6) AS eligible, -1::BIGINT AS label FROM pixel_v GROUP BY 1",
    "inventory_audit": """WITH s AS (SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN CASE WHEN lang = 'en' THEN 'not_listed' END WHEN doc_id % 40 = 3 THEN 'missing' WHEN doc_id % 30 = 1 AND n_chars <> 0 THEN 'size_differs' WHEN lang = 'en' THEN 'complete' ELSE 'not_needed' END AS state FROM documents)
        SELECT state, count(*) AS paths FROM s WHERE state IS NOT NULL GROUP BY 1""",
    "fusion_conditions": _PX + f""", t AS (SELECT tile_id, min(px_row) AS row0, max(px_row) - min(px_row) + 1 AS height, cast(round_even(sqrt(0.25e0) * least(max(px_row) - min(px_row) + 1, 64)::DOUBLE, 0) AS BIGINT) AS side FROM px GROUP BY 1),
        b AS (SELECT tile_id AS tid, row0, side, ({po.word(_STRESS)} % (height - side + 1)::UBIGINT)::BIGINT AS top, ({po.word(_STRESS, 1)} % (64 - side + 1)::UBIGINT)::BIGINT AS lft FROM t),
        pl AS (SELECT event_id, vh, greatest(least((b3 - 0.2e0) / 0.2e0, 3e0), -3e0) AS clean, px_row - row0 >= top AND px_row - row0 < top + side AND px_col - 1 >= lft AND px_col - 1 < lft + side AS hit FROM px JOIN b ON tile_id = tid WHERE eligible),
        o AS ({_CELLS}), z AS (SELECT *, 1 / (1 + exp(-(vh / 10 + 1))) AS radar, 1 / (1 + exp(-value)) AS optical FROM o)
        SELECT event_id, condition, count(*) FILTER (present) AS present_pixels, round(avg(value), 5) AS mean_input, round(avg(CASE WHEN present THEN 0.5e0 * radar + 0.5e0 * optical ELSE radar END), 5) AS mean_fused FROM z GROUP BY 1, 2""",
    "budget_grid": _PX + """, e AS (SELECT event_id, count(DISTINCT tile_id) AS n FROM pixel_v WHERE split = 'train' GROUP BY 1), u AS (SELECT budget::BIGINT AS budget, sum(least(budget, n))::BIGINT AS tiles FROM e CROSS JOIN (SELECT unnest([4, 8, 16]) AS budget) GROUP BY 1)
        SELECT * FROM u CROSS JOIN (SELECT unnest([0, 1, 2])::BIGINT AS seed) CROSS JOIN (SELECT unnest(['radar', 'optical', 'early', 'late']) AS method) CROSS JOIN (SELECT unnest(['clean', 'missing_optical', 'block_missing', 'block_brightened']) AS condition)""",
    "normalized_dates": "SELECT cast(cast(o_orderdate AS DATE) AS VARCHAR) AS day, count(*) AS orders FROM orders GROUP BY 1",
    "inspection_picks": ro._W + ro._closed() + """, wt AS (SELECT * FROM ev WHERE seen AND l_discount >= 0.05e0 AND length_m >= 15)
        SELECT (SELECT segment_id FROM wt ORDER BY length_m DESC, segment_id LIMIT 1) AS exposed_link, (SELECT min(segment_id) FROM wt WHERE is_bridge) AS bridge_overlap, (SELECT min(segment_id) FROM ev WHERE NOT seen) AS outside_footprint_link""",
    "closure_index_audit": ro._W + ro._closed() + """, n AS (SELECT scenario_key, count(*) AS entries FROM cl GROUP BY 1), op AS (SELECT scenario_key FROM ky UNION ALL SELECT DISTINCT replace(scenario_key, 'wet_05', 'wet_99') FROM ky WHERE scenario_id = 'wet_05')
        SELECT scenario_key, op.scenario_key IS NOT NULL AS offered, coalesce(entries, 0) AS entries FROM op FULL JOIN n USING (scenario_key)""",
    "clip_rejects": ro._W + ro._CLIP + "SELECT CASE WHEN cp.segment_id IS NULL THEN 'outside_box' ELSE 'kept' END AS status, count(*) AS segments, round(coalesce(sum(within_m), 0), 3) AS within_m FROM sg LEFT JOIN cp ON sg.segment_id = cp.segment_id GROUP BY 1",
    "nearest_link": ro._W + """, q AS (SELECT segment_id, (bx - ax) * 0.78e0 AS dx, by_ - ay AS dy, (512.5e0 - ax) * 0.78e0 AS qx, 487.5e0 - ay AS qy FROM sg), f AS (SELECT *, greatest(0e0, least(1e0, (qx * dx + qy * dy) / (dx * dx + dy * dy))) AS u FROM q),
        g AS (SELECT segment_id, sqrt((qx - u * dx) * (qx - u * dx) + (qy - u * dy) * (qy - u * dy)) AS gap FROM f) SELECT segment_id, round(gap, 6) AS distance FROM g WHERE gap <= 9 ORDER BY gap, segment_id LIMIT 1""",
    "boundary_audit": f"SELECT count(*) AS paths, count(*) FILTER (border_m <= 50) AS within_guard, count(*) FILTER (border_m < 0) AS leaving, min(border_m) AS least_border_m FROM ({ro.ORACLES['path_audit']})",
    "run_gates": ro._RUNS + """, a AS (SELECT run_id, o_custkey, status = 'complete' AND hash_ok AS sound, row_number() OVER (PARTITION BY o_custkey ORDER BY completed_at, run_id) AS k FROM run_v JOIN orders ON o_orderkey = run_id),
        b AS (SELECT *, max(CASE WHEN NOT sound THEN k END) OVER (PARTITION BY o_custkey ORDER BY k) AS bad FROM a)
        SELECT b.run_id, bad IS NULL AS valid, c.run_id AS cause, b.k - bad AS depth FROM b LEFT JOIN a c ON c.o_custkey = b.o_custkey AND c.k = b.bad""",
}
