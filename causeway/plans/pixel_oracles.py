"""DuckDB SQL of the pixel queries, written apart from the operators."""

from __future__ import annotations

from causeway.plans.bindings import TABLES, VIEWS

_NAMES = {t: t for t in TABLES}


def ctes(*views: str) -> str:
    return ", ".join(f"{v} AS ({VIEWS[v].format(**_NAMES)})" for v in views)


def word(text: str, k: int = 0) -> str:
    """Unsigned little-endian integer of eight digest bytes."""
    parts = " || ".join(f"substr(sha256({text}), {16 * k + 2 * i + 1}, 2)" for i in range(7, -1, -1))
    return f"(('0x' || {parts})::UBIGINT)"


_PX = "WITH " + ctes("pixel_v") + """, px AS (SELECT *, CASE WHEN eligible THEN (b3 - b8) / (b3 + b8) END AS ndwi, CASE WHEN eligible THEN (b3 - b11) / (b3 + b11) END AS mndwi FROM pixel_v),
sc AS (SELECT *, CASE WHEN ndwi IS NOT NULL THEN 1 / (1 + exp(-(2.5e0 * greatest(least(ndwi, 1e0), -1e0) + 0.2e0))) END AS p,
  CASE WHEN eligible THEN (CASE WHEN least(abs(b3 + b8), abs(b3 + b11)) < 0.15e0 THEN 1 ELSE 0 END) + (CASE WHEN greatest(b3, b8, b11) > 0.4e0 THEN 2 ELSE 0 END) END AS flags FROM px) """
_ID = "tile_id, px_row, px_col, px_tie"


def _conf(hit: str, source: str, keys: str) -> str:
    return f"""SELECT {keys}, count(*) FILTER (eligible AND label = 1 AND {hit}) AS tp, count(*) FILTER (eligible AND label = 0 AND {hit}) AS fp,
      count(*) FILTER (eligible AND label = 1 AND NOT ({hit})) AS fn, count(*) FILTER (eligible AND label = 0 AND NOT ({hit})) AS tn, count(*) FILTER (eligible) AS eligible_pixels FROM {source} GROUP BY {keys}"""


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) <> 0 THEN cast({a} AS DOUBLE) / ({b}) END"


_MET = f"round({_ratio('tp', 'tp + fp + fn')}, 6) AS iou, round({_ratio('2 * tp', '2 * tp + fp + fn')}, 6) AS f1, round({_ratio('tp', 'tp + fp')}, 6) AS precision, round({_ratio('tp', 'tp + fn')}, 6) AS recall"
_CAT = "WITH " + ctes("catalog_v") + " "
_BINS = """bins AS (SELECT event_id, least(cast(floor(p * 10) AS BIGINT), 9) AS bin, count(*) AS pixels, sum(label::DOUBLE) AS positives, sum(p) AS sum_p, sum((p - label) * (p - label)) AS sum_brier,
  sum(-(label * ln(greatest(least(p, 1 - 1e-6), 1e-6)) + (1 - label) * ln(1 - greatest(least(p, 1 - 1e-6), 1e-6)))) AS sum_log_loss FROM {src} WHERE label IS NOT NULL AND p IS NOT NULL GROUP BY 1, 2)"""
_ECE = "{keys} sum(pixels)::BIGINT AS pixels, round(sum(positives) / sum(pixels), 5) AS prevalence, round(sum(sum_brier) / sum(pixels), 5) AS brier, round(sum(sum_log_loss) / sum(pixels), 5) AS log_loss, round(sum(abs(sum_p - positives)) / sum(pixels), 5) AS ece"
_MASKS = ", mk AS (SELECT sc.*, scenario_id, CASE WHEN eligible AND p IS NOT NULL THEN cast(CASE WHEN seed IS NULL THEN p >= threshold ELSE greatest(least(p + (2 * (" + word(
    "concat_ws(':', 'm5-block-v1', tile_id, (cast(floor(px_row / 512) AS BIGINT) * 512), (cast(floor(px_col / 512) AS BIGINT) * 512), seed)"
) + """::DOUBLE / 18446744073709551615::DOUBLE) - 1) * 0.12e0, 1e0), 0e0) >= 0.5e0 END AS INTEGER) END AS value
 FROM sc CROSS JOIN (SELECT 'threshold_0.65' AS scenario_id, 0.65e0 AS threshold, NULL::INTEGER AS seed UNION ALL SELECT 'threshold_0.50', 0.5e0, NULL UNION ALL SELECT 'threshold_0.35', 0.35e0, NULL UNION ALL SELECT 'offset_seed_' || s, NULL, s::INTEGER FROM range(501, 509) t(s)) g) """
_THR = """, grid AS (SELECT round(-0.5e0 + 0.05e0 * k, 2) AS threshold FROM range(0, 21) t(k)), cv AS (SELECT threshold, event_id, count(*) FILTER (label = 1 AND ndwi >= threshold) AS tp, count(*) FILTER (label = 0 AND ndwi >= threshold) AS fp,
 count(*) FILTER (label = 1 AND NOT ndwi >= threshold) AS fn FROM px CROSS JOIN grid WHERE split = 'train' AND eligible GROUP BY 1, 2),
 cu AS (SELECT threshold, avg(""" + _ratio("tp", "tp + fp + fn") + ") AS macro_iou, count(" + _ratio("tp", "tp + fp + fn") + ") AS defined_events FROM cv GROUP BY 1) "
_LOGIT = " + ".join(
    f"({w}e0) * {x}"
    for w, x in zip(
        [0.4, -0.3, 1.5, 0.5, -2.0, -1.0, -0.5, 1.2, 2.4],
        [*(f"greatest(least(({b} + 20) / 10e0, 3e0), -3e0)" for b in ("vv", "vh")), *(f"greatest(least(({b} - 0.2e0) / 0.2e0, 3e0), -3e0)" for b in ("b3", "b4", "b8", "b11", "b12")), "ndwi", "mndwi"],
    )
)
_GAIN = ", mo AS (" + " UNION ALL ".join(f"SELECT {k} AS seed, * FROM ({_conf(f'mndwi + {s}e0 >= 0.15e0', 'px', 'event_id')})" for k, s in ((0, "0.0"), (1, "0.05"), (2, "-0.05"))) + "), rf AS (" + _conf(
    "vh <= -23e0", "px", "event_id"
) + f"), gn AS (SELECT mo.seed, mo.event_id, {_ratio('mo.tp', 'mo.tp + mo.fp + mo.fn')} AS iou, {_ratio('rf.tp', 'rf.tp + rf.fp + rf.fn')} AS ref FROM mo JOIN rf ON mo.event_id = rf.event_id) "
_OVER = "a.xmin < b.xmax AND b.xmin < a.xmax AND a.ymin < b.ymax AND b.ymin < a.ymax AND a.tile_key < b.tile_key"


def _channel(band: str, shift: str, scale: str) -> str:
    return f"round(CASE WHEN eligible THEN greatest(least(({band} {shift}) / {scale}, 3e0), -3e0) ELSE 0e0 END, 6) AS in_{band}"


ORACLES: dict[str, str] = {
    "split_membership": "WITH " + ctes("catalog_v", "official_v") + """, j AS (SELECT coalesce(c.chip, o.chip) AS chip, CASE WHEN o.chip IS NULL THEN 'catalog_only' WHEN c.chip IS NULL THEN 'official_only' WHEN c.split <> o.official_split THEN 'split_differs' ELSE 'agrees' END AS status
        FROM catalog_v c FULL JOIN official_v o ON c.chip = o.chip) SELECT * FROM j WHERE status <> 'agrees'""",
    "split_mismatch": _CAT + """, x AS (SELECT DISTINCT event_id FROM catalog_v), y AS (SELECT unnest(['e0', 'e1', 'e2', 'e3', 'e7']) AS event_id)
        SELECT event_id, 'missing' AS status FROM y WHERE event_id NOT IN (SELECT event_id FROM x) UNION ALL SELECT event_id, 'extra' FROM x WHERE event_id NOT IN (SELECT event_id FROM y)""",
    "date_offset": _CAT + "SELECT chip, date_diff('day', s1_date, s2_date)::BIGINT AS offset_days FROM catalog_v",
    "event_id_strings": _CAT + "SELECT chip, split_part(chip, '_', 1) AS prefix, lower(replace(location, ' ', '-')) AS slug, CASE location WHEN 'VIETNAM' THEN 'MEKONG' ELSE location END AS event_name FROM catalog_v",
    "bbox_overlap_audit": _CAT + f"SELECT a.tile_key AS a_tile_key, b.tile_key AS b_tile_key FROM catalog_v a JOIN catalog_v b ON {_OVER}",
    "overlap_split_leakage": _CAT + f"SELECT a.split AS a_split, b.split AS b_split, count(*) AS pairs FROM catalog_v a JOIN catalog_v b ON {_OVER} WHERE a.split <> b.split GROUP BY 1, 2",
    "bbox_centroids": _CAT + "SELECT chip, round((xmin + xmax) / 2, 6) AS cx, round((ymin + ymax) / 2, 6) AS cy, xmin < xmax AND ymin < ymax AS sane FROM catalog_v",
    "split_counts": _CAT + "SELECT split, count(*) AS tiles, count(DISTINCT event_id) AS events FROM catalog_v GROUP BY 1",
    "duplicate_audit": "SELECT copies, count(*) AS keys FROM (SELECT count(*) AS copies FROM lineitem GROUP BY l_orderkey, l_linenumber) WHERE copies > 1 GROUP BY 1",
    "split_overlap": _PX + "SELECT a.split AS a_split, b.split AS b_split, count(*) AS shared FROM (SELECT DISTINCT px_row, split FROM px) a JOIN (SELECT DISTINCT px_row, split FROM px) b ON a.px_row = b.px_row AND a.split < b.split GROUP BY 1, 2",
    "hash_bucket": f"SELECT doc_id, ({word("concat('m5-cal-v1:', doc_id)")} % 97)::BIGINT AS bucket FROM documents",
    "event_hash_rank": "WITH " + ctes("pixel_v") + " SELECT event_id, row_number() OVER (ORDER BY sha256('m5-cal-v1:' || event_id), event_id) AS hash_rank FROM (SELECT DISTINCT event_id FROM pixel_v)",
    "nested_subset": "WITH " + ctes("pixel_v") + " SELECT * FROM (SELECT event_id, tile_id, row_number() OVER (PARTITION BY event_id ORDER BY sha256(concat_ws(':', 'm4-nested-v1', event_id, tile_id)), tile_id) AS hash_rank FROM (SELECT DISTINCT event_id, tile_id FROM pixel_v WHERE split = 'train')) WHERE hash_rank <= 4",
    "stage_topk": "WITH " + ctes("pixel_v") + " SELECT split, event_id, tile_id FROM (SELECT *, row_number() OVER (PARTITION BY split, event_id ORDER BY sha256('m3_event_development_v1:' || tile_id), tile_id) AS k FROM (SELECT DISTINCT split, event_id, tile_id FROM pixel_v WHERE split <> 'final_test')) WHERE k <= 3",
    "staged_object_keys": "WITH " + ctes("pixel_v") + " SELECT concat_ws('/', split, layer, tile_id) AS object_key FROM (SELECT *, row_number() OVER (PARTITION BY split, event_id ORDER BY sha256('m3_event_development_v1:' || tile_id), tile_id) AS k FROM (SELECT DISTINCT split, event_id, tile_id FROM pixel_v WHERE split <> 'final_test')) CROSS JOIN (SELECT unnest(['label', 'radar', 'optical']) AS layer) WHERE k <= 3",
    "block_sample": _PX + f""", bl AS (SELECT *, cast(floor(px_row / 512) AS BIGINT) * 512 AS top, cast(floor(px_col / 512) AS BIGINT) * 512 AS left_ FROM px WHERE split = 'train' AND eligible),
        rk AS (SELECT *, row_number() OVER (PARTITION BY tile_id, top, left_ ORDER BY px_row, px_col, px_tie) - 1 AS place, count(*) OVER (PARTITION BY tile_id, top, left_) AS available FROM bl)
        SELECT tile_id, top, left_ AS "left", px_row, px_col, px_tie, available FROM rk WHERE place = ({word("concat_ws(':', 'm5-sample-v1', tile_id, top, left_)")} % available::UBIGINT)""",
    "stratified_sample": _PX + """, r AS (SELECT *, sha256(concat_ws(':', 'sample', tile_id, px_row, px_col, px_tie)) AS digest FROM px WHERE split = 'train' AND eligible),
        c AS (SELECT event_id AS ev, (ceil(200e0 / count(DISTINCT tile_id)) * 2)::BIGINT AS cap FROM r GROUP BY 1),
        t AS (SELECT * FROM (SELECT r.*, cap, row_number() OVER (PARTITION BY tile_id, label ORDER BY digest, px_row, px_col, px_tie) AS k FROM r JOIN c ON r.event_id = ev) WHERE k <= cap)
        SELECT event_id, tile_id, label, px_row, px_col, px_tie FROM (SELECT *, row_number() OVER (PARTITION BY event_id, label ORDER BY digest, px_row, px_col, px_tie) AS m FROM t) WHERE m <= 200""",
    "ndwi_mndwi": _PX + f"SELECT {_ID}, round(ndwi, 6) AS ndwi, round(mndwi, 6) AS mndwi FROM px",
    "eligible_counts": _PX + "SELECT event_id, count(*) FILTER (eligible) AS eligible, count(*) FILTER (radar_valid AND optical_valid) AS paired, count(label) AS labelled FROM px GROUP BY 1",
    "features_clip": _PX + f"SELECT {_ID}, " + ", ".join([*(_channel(b, "+ 20", "10e0") for b in ("vv", "vh")), *(_channel(b, "- 0.2e0", "0.2e0") for b in ("b3", "b4", "b8", "b11", "b12"))]) + " FROM px",
    "quality_flags": _PX + "SELECT event_id, flags, count(*) AS pixels FROM sc GROUP BY 1, 2",
    "quality_strata": _PX + "SELECT event_id, count(*) FILTER (flags = 0) AS ordinary_pixels, count(*) FILTER (flags & 1 = 1) AS weak_pixels, count(*) FILTER (flags & 2 = 2) AS bright_pixels FROM sc GROUP BY 1",
    "retained_state": _PX + """SELECT event_id, CASE WHEN p IS NULL THEN 'unknown' WHEN abs(p - 0.5e0) > 0.15e0 AND flags = 0 THEN CASE WHEN p >= 0.5e0 THEN 'retained_wet' ELSE 'retained_dry' END WHEN p >= 0.5e0 THEN 'withheld_wet' ELSE 'withheld_dry' END AS state,
        count(*) AS pixels FROM sc GROUP BY 1, 2""",
    "confusion_by_tile": _PX + _conf("mndwi >= 0.15e0", "px", "event_id, tile_id"),
    "metrics_by_event": _PX + f", k AS ({_conf('mndwi >= 0.15e0', 'px', 'event_id')}) SELECT *, {_MET} FROM k",
    "event_macro": _PX + f", k AS ({_conf('mndwi >= 0.15e0', 'px', 'event_id')}) SELECT round(avg({_ratio('tp', 'tp + fp + fn')}), 6) AS macro_iou, count({_ratio('tp', 'tp + fp + fn')}) AS defined_events FROM k",
    "support_coverage": _PX + "SELECT event_id, count(label) AS labelled_pixels, count(*) FILTER (label IS NOT NULL AND eligible) AS eligible_pixels, round(count(*) FILTER (label IS NOT NULL AND eligible) / nullif(count(label), 0)::DOUBLE, 6) AS coverage FROM px GROUP BY 1",
    "worst_tile": _PX + f", k AS ({_conf('mndwi >= 0.15e0', 'px', 'event_id, tile_id')}) SELECT event_id, tile_id, errors FROM (SELECT event_id, tile_id, fp + fn AS errors, row_number() OVER (PARTITION BY event_id ORDER BY fp + fn DESC, tile_id DESC) AS n FROM k) WHERE n = 1",
    "sensor_availability": _PX + "SELECT event_id, count(label) AS labelled, count(*) FILTER (label IS NOT NULL AND radar_valid) AS labelled_radar, count(*) FILTER (label IS NOT NULL AND optical_valid) AS labelled_optical, count(*) FILTER (label IS NOT NULL AND radar_valid AND optical_valid) AS labelled_paired, count(*) FILTER (eligible) AS labelled_common FROM px GROUP BY 1",
    "threshold_curve": _PX + _THR + "SELECT threshold, round(macro_iou, 6) AS macro_iou, defined_events FROM cu",
    "best_threshold": _PX + _THR + "SELECT threshold, round(macro_iou, 6) AS macro_iou FROM cu ORDER BY cu.macro_iou DESC, threshold LIMIT 1",
    "logistic_score": _PX + f"SELECT {_ID}, round(CASE WHEN eligible THEN 1 / (1 + exp(-greatest(least(0.1e0 + {_LOGIT}, 30e0), -30e0))) END, 6) AS score FROM px",
    "calibrated_probability": _PX + f"SELECT {_ID}, round(p, 6) AS p, round(CASE WHEN ndwi IS NOT NULL THEN greatest(least((ndwi + 1) / 2, 1e0), 0e0) END, 6) AS unit_ndwi FROM sc",
    "reliability_bins": "WITH " + ctes("doc_label_v") + ", " + _BINS.format(src="doc_label_v") + " SELECT event_id, bin, pixels, round(positives, 6) AS positives, round(sum_p, 5) AS sum_p, round(sum_brier, 5) AS sum_brier, round(sum_log_loss, 4) AS sum_log_loss FROM bins",
    "reliability_summary": _PX + ", " + _BINS.format(src="sc") + " SELECT " + _ECE.format(keys="event_id,") + " FROM bins GROUP BY event_id",
    "reliability_pooled": _PX + ", " + _BINS.format(src="sc") + ", pooled AS (SELECT bin, sum(pixels) AS pixels, sum(positives) AS positives, sum(sum_p) AS sum_p, sum(sum_brier) AS sum_brier, sum(sum_log_loss) AS sum_log_loss FROM bins GROUP BY 1) SELECT " + _ECE.format(keys="") + " FROM pooled",
    "abstention_table": _PX + """, g AS (SELECT m AS margin, q AS gated FROM (SELECT unnest([0e0, 0.15e0, 0.25e0]) AS m) CROSS JOIN (SELECT unnest([false, true]) AS q)),
        k AS (SELECT *, abs(p - 0.5e0) > margin AND (NOT gated OR flags = 0) AS keep, (p >= 0.5e0) <> (label = 1) AS wrong FROM sc CROSS JOIN g WHERE eligible)
        SELECT event_id, margin, gated, count(*) AS pixels, count(*) FILTER (keep) AS retained_pixels, count(*) FILTER (keep AND wrong) AS retained_errors, count(*) FILTER (NOT keep AND label = 1) AS withheld_water,
        round(count(*) FILTER (keep AND wrong) / nullif(count(*) FILTER (keep), 0)::DOUBLE, 5) AS conditional_error, round(sum((p - label) * (p - label)) FILTER (keep) / nullif(count(*) FILTER (keep), 0)::DOUBLE, 5) AS retained_brier FROM k GROUP BY 1, 2, 3""",
    "calibration_weights": "WITH " + ctes("doc_label_v") + """, k AS (SELECT *, 1e0 / ((SELECT count(DISTINCT event_id) FROM doc_label_v WHERE label IS NOT NULL) * count(*) OVER (PARTITION BY event_id)) AS weight FROM doc_label_v WHERE label IS NOT NULL)
        SELECT event_id, round(sum(weight), 6) AS total, round(sum(weight * label), 6) AS positive FROM k GROUP BY 1""",
    "class_weight": _PX + "SELECT event_id, round(least(10e0, count(*) FILTER (label = 0) / nullif(count(*) FILTER (label = 1), 0)::DOUBLE), 6) AS positive_weight FROM px WHERE eligible GROUP BY 1",
    "stress_block_pixels": _PX + f""", t AS (SELECT tile_id, max(px_row) - min(px_row) + 1 AS height, 64 AS width FROM px GROUP BY 1), s AS (SELECT *, cast(round_even(sqrt(0.25e0) * least(height, width)::DOUBLE, 0) AS BIGINT) AS side FROM t)
        SELECT tile_id, side, ({word("concat_ws(':', 'm4-stress-v1', tile_id)")} % (height - side + 1)::UBIGINT)::BIGINT AS top, ({word("concat_ws(':', 'm4-stress-v1', tile_id)", 1)} % (width - side + 1)::UBIGINT)::BIGINT AS "left" FROM s""",
    "late_fusion": _PX + f""", f AS (SELECT *, CASE WHEN radar_valid THEN 1 / (1 + exp(-greatest(least(vh / 10 + 1, 30e0), -30e0))) END AS radar, CASE WHEN eligible THEN greatest(least((ndwi + 1) / 2, 1e0), 0e0) END AS optical FROM px)
        SELECT {_ID}, round(CASE WHEN optical IS NOT NULL THEN 0.5e0 * radar + 0.5e0 * optical ELSE radar END, 6) AS fused FROM f""",
    "optical_conditions": _PX + """, f AS (SELECT event_id, CASE WHEN eligible THEN greatest(least((b3 - 0.2e0) / 0.2e0, 3e0), -3e0) ELSE 0e0 END AS clean FROM px), v AS (SELECT event_id, 'clean' AS condition, clean AS x FROM f
        UNION ALL SELECT event_id, 'absent', 0e0 FROM f UNION ALL SELECT event_id, 'brightened', greatest(least((1 - 0.35e0) * clean + 2 * 0.35e0, 3e0), -3e0) FROM f)
        SELECT event_id, condition, round(avg(x), 5) AS mean_input, round(min(x), 5) AS least, round(max(x), 5) AS greatest FROM v GROUP BY 1, 2""",
    "scenario_masks": _PX + _MASKS + "SELECT scenario_id, value, count(*) AS pixels FROM mk GROUP BY 1, 2",
    "scenario_summary": _PX + _MASKS + "SELECT event_id, scenario_id, count(value) AS known_pixels, coalesce(sum(value), 0)::BIGINT AS water_pixels, round(sum(value) / nullif(count(value), 0)::DOUBLE, 6) AS water_fraction FROM mk GROUP BY 1, 2",
    "scenario_jaccard": _PX + _MASKS + """, d AS (SELECT event_id, max(value) FILTER (scenario_id = 'threshold_0.65') AS a, max(value) FILTER (scenario_id = 'threshold_0.35') AS b, min(value) = max(value) AS same FROM mk WHERE value IS NOT NULL GROUP BY event_id, tile_id, px_row, px_col, px_tie, vh, b8, b11, radar_valid, label)
        SELECT event_id, round(count(*) FILTER (a = 1 AND b = 1) / nullif(count(*) FILTER (a = 1 OR b = 1), 0)::DOUBLE, 6) AS jaccard, round(count(*) FILTER (same) / count(*)::DOUBLE, 6) AS unanimous_fraction FROM d GROUP BY 1""",
    "band_stats": _PX + " UNION ALL ".join(
        f"SELECT event_id, '{b}' AS band, round(min({b}), 6) AS least, round(quantile_cont({b}, 0.5), 6) AS median, round(max({b}), 6) AS greatest, round(count(*) FILTER ({b} = 0) / count(*)::DOUBLE, 6) AS zero_fraction, count(*) FILTER ({b} IS NULL) AS missing FROM px GROUP BY 1" for b in ("vh", "b3", "b8", "b11")
    ),
    "percentile_stretch": _PX + """, l AS (SELECT event_id AS ev, quantile_cont(b3, 0.02) AS low, quantile_cont(b3, 0.98) AS high FROM px GROUP BY 1), s AS (SELECT event_id, CASE WHEN high > low THEN greatest(least((b3 - low) / (high - low), 1e0), 0e0) ELSE 0e0 END AS x FROM px JOIN l ON event_id = ev)
        SELECT event_id, round(avg(x), 5) AS mean_stretched, count(*) FILTER (x = 1) AS saturated FROM s GROUP BY 1""",
    "model_gain_vs_reference": _PX + _GAIN + "SELECT seed::BIGINT AS seed, event_id, round(iou - ref, 6) AS gain FROM gn",
    "promotion_rule": _PX + _GAIN + ", z AS (SELECT seed, avg(iou) - avg(ref) AS g, max(ref - iou) AS w FROM gn GROUP BY 1) SELECT 'mndwi' AS method, round(min(g), 6) AS least_gain, round(max(w), 6) AS worst_loss, bool_and(g >= 0.02e0 AND w <= 0.05e0) AS promoted FROM z",
    "step_parity": "SELECT c_mktsegment, round((max(n) - min(n)) / max(n)::DOUBLE, 6) AS spread, (max(n) - min(n)) / max(n)::DOUBLE <= 0.5e0 AS parity FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1",
    "replay_diff": """WITH l AS (SELECT s_suppkey, s_nationkey FROM supplier), r AS (SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 4 THEN 0 ELSE s_nationkey END AS s_nationkey FROM supplier)
        SELECT *, 'left' AS side FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r) UNION ALL SELECT *, 'right' FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l)""",
    "tolerance_diff": "SELECT s_suppkey FROM supplier WHERE s_suppkey % 13 = 1 OR s_suppkey % 7 = 2",
    "set_checks": """WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_discount > 0.05e0), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_tax > 0.02e0)
        SELECT (SELECT count(*) FROM a WHERE l_partkey IN (SELECT * FROM b)) AS shared, (SELECT count(*) FROM a WHERE l_partkey NOT IN (SELECT * FROM b)) AS only_first, (SELECT count(*) FROM b WHERE l_partkey NOT IN (SELECT * FROM a)) AS only_second,
        (SELECT count(*) FROM a WHERE l_partkey NOT IN (SELECT * FROM b)) = 0 AS is_subset""",
}
