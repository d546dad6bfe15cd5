"""Queries of rasters, tiles on another grid, clipping and validity, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions import clipping
from causeway.operators import regrid
from causeway.plans.bindings import VIEWS, table, view
from causeway.sources import geotiff, tiff
from causeway.staging import new_path

#: Grids of the label and of two sensors that lie askew to it; a tile is a supplier.
LABEL = regrid.Grid(24, 24, (1.0, 0.0, 0.0, 0.0, -1.0, 24.0))
RADAR = regrid.Grid(26, 26, (1.0, 0.0, -0.7, 0.0, -1.0, 25.4))
OPTICAL = regrid.Grid(19, 19, (1.4, 0.0, -1.0, 0.0, -1.4, 25.2))
#: A convex window over the plane of the nodes.
WINDOW = ((200.0, 150.0), (850.0, 100.0), (900.0, 800.0), (150.0, 900.0))

_SENSOR = """
    SELECT concat('t', l_suppkey) AS tile_id, l_orderkey * 7919 % {size} AS px_row, l_partkey * 104729 % 1009 % {size} AS px_col,
           max(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE -1 END) AS label, avg(cast(l_quantity AS double)) AS vh, avg(cast(l_discount AS double)) * 10000 AS b3, avg(cast(l_tax AS double)) * 10000 AS b8
    FROM {lineitem} GROUP BY 1, 2, 3"""


def _sensor(spark: SparkSession, sf_dir: str, grid: regrid.Grid) -> DataFrame:
    """Lines as the pixels of a sensor; places without a line are missing."""
    return spark.sql(_SENSOR.replace("{size}", str(grid.height)), lineitem=table(spark, sf_dir, "lineitem"))


def canonical_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and sums of the tiles whose sensors are brought to the label grid."""
    size = LABEL.width * LABEL.height
    place = table(spark, sf_dir, "supplier").select(F.concat(F.lit("t"), F.col("s_suppkey")).alias("tile_id"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint"))).alias("k"))
    place = place.select("tile_id", F.floor(F.col("k") / LABEL.width).alias("px_row"), (F.col("k") % LABEL.width).alias("px_col"))
    labels = place.join(_sensor(spark, sf_dir, LABEL).select("tile_id", "px_row", "px_col", "label"), ["tile_id", "px_row", "px_col"], "left").withColumn("label", F.coalesce("label", F.lit(-1)))
    grids = {"label": LABEL, "radar": RADAR, "optical": OPTICAL}
    tiles = regrid.canonical(labels, _sensor(spark, sf_dir, RADAR), _sensor(spark, sf_dir, OPTICAL), grids, radar_bands=["vh"], optical_bands=["b3", "b8"])
    sums = tiles.groupBy("tile_id").agg(*[F.round(F.sum(b), 4).alias(f"{b}_sum") for b in ("vh", "b3", "b8")])
    return regrid.quality(tiles).drop("cloud_known").join(sums, "tile_id")


def raster_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optical tiles written as GeoTIFF and scanned again: one band of some rows."""
    path = new_path(spark, "rasters")
    pixels = _sensor(spark, sf_dir, OPTICAL).select("tile_id", "px_row", "px_col", F.array("b3", "b8").alias("values"))
    layout = tiff.Layout(OPTICAL.width, OPTICAL.height, 2, "f8", (16, 16), OPTICAL.transform, 4326, float("nan"), ("B3", "B8"), 3)
    geotiff.write_rasters(pixels, path, layout, name="tile_id")
    back = spark.read.format("geotiff").option("bands", "2").load(path).filter("px_row >= 3 AND px_row < 12")
    found = back.select(F.regexp_extract("path", r"([^/]+)\.tif$", 1).alias("tile_id"), F.get("values", F.lit(0)).alias("v")).filter(~F.isnan("v"))
    return found.groupBy("tile_id").agg(F.count("*").alias("pixels"), F.round(F.sum("v"), 4).alias("b8_sum"))


def _window():
    closed = [*WINDOW, WINDOW[0]]
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in closed])


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways as lines over the places of their nodes."""
    nodes = view(spark, sf_dir, "node_v").select(F.col("node_id").alias("node"), "x_m", "y_m")
    placed = view(spark, sf_dir, "way_node_v").select("way_id", "idx", "node").join(nodes, "node")
    listed = placed.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.struct(F.col("x_m").alias("x"), F.col("y_m").alias("y")).alias("p")))).alias("l"))  # the nodes of one way
    return listed.select("way_id", F.col("l.p").alias("line"))


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways as closed rings."""
    return _lines(spark, sf_dir).select("way_id", F.concat("line", F.slice("line", 1, 1)).alias("ring"))


def line_clip_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and metres of every way inside a convex window."""
    cut = _lines(spark, sf_dir).select("way_id", clipping.clip_line(F.col("line"), _window()).alias("parts"))
    return cut.select("way_id", F.size("parts").cast("bigint").alias("parts"), F.round(F.aggregate("parts", F.lit(0.0), lambda s, p: s + clipping.line_length(p)), 4).alias("within_m"))


def polygon_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed area of the rings of ways inside a convex window."""
    cut = _rings(spark, sf_dir).select("way_id", clipping.clip_ring(F.col("ring"), _window()).alias("c")).filter(F.size("c") > 0)
    return cut.select("way_id", F.round(clipping.twice_area(F.col("c")) / 2, 2).alias("area"))


def ring_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the rings of ways are not valid, with counts."""
    fault = clipping.polygon_fault(F.array("ring"))
    return _rings(spark, sf_dir).select(F.coalesce(fault, F.lit("valid")).alias("fault")).groupBy("fault").agg(F.count("*").alias("rings"))


QUERIES = {f.__name__: f for f in (canonical_tiles, raster_round_trip, line_clip_parts, polygon_clip, ring_faults)}


# SQL, written apart from the operators -------------------------------------


def _plain(name: str) -> str:
    text = VIEWS[name] if name in VIEWS else name
    for t in ("lineitem", "part", "orders"):
        text = text.replace(f"{{{t}}}", t)
    return text


def _on_label(name: str, size: int, y: str, x: str, bands: tuple[str, ...]) -> str:
    """Bilinear values and nearest validity of a sensor at every label pixel, by a join of four neighbours."""
    rows = _plain(_SENSOR.replace("{size}", str(size)))
    weights = "(1 - abs(y - n.px_row)) * (1 - abs(x - n.px_col))"
    sums = ", ".join(f"sum({weights} * n.{b}) / sum({weights}) AS {b}" for b in bands)
    return f"""{name}_rows AS MATERIALIZED ({rows}),
  {name}_at AS (SELECT tile_id, px_row, px_col, {y} AS y, {x} AS x FROM label),
  {name} AS (SELECT a.tile_id, a.px_row, a.px_col, {sums}
    FROM {name}_at a JOIN {name}_rows m ON m.tile_id = a.tile_id AND m.px_row = floor(y + 0.5) AND m.px_col = floor(x + 0.5)
    JOIN {name}_rows n ON n.tile_id = a.tile_id AND n.px_row BETWEEN floor(y) AND floor(y) + 1 AND n.px_col BETWEEN floor(x) AND floor(x) + 1
    GROUP BY 1, 2, 3)"""


_TILES = f"""WITH label AS MATERIALIZED (
    SELECT p.tile_id, p.px_row, p.px_col, coalesce(label, -1) AS label
    FROM (SELECT concat('t', s_suppkey) AS tile_id, r AS px_row, c AS px_col FROM supplier, range(24) AS a(r), range(24) AS b(c)) p
    LEFT JOIN ({_plain(_SENSOR.replace("{size}", "24"))}) l ON l.tile_id = p.tile_id AND l.px_row = p.px_row AND l.px_col = p.px_col),
  {_on_label("radar", 26, "px_row + 1.4e0", "px_col + 0.7e0", ("vh",))},
  {_on_label("optical", 19, "(px_row + 1e0) / 1.4e0", "(px_col + 0.8e0) / 1.4e0", ("b3", "b8"))}
  SELECT l.tile_id, count(*) FILTER (label < 0) AS label_unknown, count(vh) AS radar_valid, count(b3) AS optical_nodata_valid, count(*) FILTER (vh IS NOT NULL AND b3 IS NOT NULL) AS paired_sensor_valid,
    count(*) FILTER (vh IS NOT NULL AND b3 IS NOT NULL AND label >= 0) AS label_and_paired_valid, round(sum(vh), 4) AS vh_sum, round(sum(b3 / 10000), 4) AS b3_sum, round(sum(b8 / 10000), 4) AS b8_sum
  FROM label l LEFT JOIN radar r ON r.tile_id = l.tile_id AND r.px_row = l.px_row AND r.px_col = l.px_col
    LEFT JOIN optical o ON o.tile_id = l.tile_id AND o.px_row = l.px_row AND o.px_col = l.px_col
  GROUP BY 1"""
_ROUND_TRIP = f"SELECT tile_id, count(*) AS pixels, round(sum(b8), 4) AS b8_sum FROM ({_plain(_SENSOR.replace('{size}', '19'))}) WHERE px_row >= 3 AND px_row < 12 GROUP BY 1"

_NODES = f"""nodes AS (SELECT way_id, idx, x_m AS x, y_m AS y FROM ({_plain('way_node_v')}) w JOIN ({_plain('node_v')}) n ON n.node_id = w.node)"""
_EDGES = [(*WINDOW[k], *WINDOW[(k + 1) % 4]) for k in range(4)]


def _side_of(edge: tuple[float, ...], x: str, y: str) -> str:
    px, py, qx, qy = edge
    return f"({qx - px}::DOUBLE * ({y} - {py}::DOUBLE) - {qy - py}::DOUBLE * ({x} - {px}::DOUBLE))"


_STARTS = ", ".join(f"{_side_of(e, 'x', 'y')} AS s{k}, {_side_of(e, 'x2', 'y2')} AS e{k}" for k, e in enumerate(_EDGES))
_ENTERS = ", ".join(f"CASE WHEN s{k} < 0 AND e{k} >= 0 THEN s{k} / (s{k} - e{k}) ELSE 0 END" for k in range(4))
_LEAVES = ", ".join(f"CASE WHEN s{k} >= 0 AND e{k} < 0 THEN s{k} / (s{k} - e{k}) ELSE 1 END" for k in range(4))
_GONE = " OR ".join(f"(s{k} < 0 AND e{k} < 0)" for k in range(4))
_LINES = f"""WITH {_NODES},
  pairs AS (SELECT way_id, idx, x, y, lead(x) OVER (PARTITION BY way_id ORDER BY idx) AS x2, lead(y) OVER (PARTITION BY way_id ORDER BY idx) AS y2 FROM nodes),
  cut AS (SELECT way_id, idx, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS d, CASE WHEN {_GONE} THEN 2 ELSE greatest({_ENTERS}) END AS t0, least({_LEAVES}) AS t1 FROM (SELECT *, {_STARTS} FROM pairs WHERE x2 IS NOT NULL AND (x <> x2 OR y <> y2))),
  runs AS (SELECT way_id, d, t0, t1, t1 > t0 AS within, lag(t1 > t0 AND t1 = 1) OVER (PARTITION BY way_id ORDER BY idx) AS open FROM cut),
  told AS (SELECT way_id, count(*) FILTER (within AND NOT (t0 = 0 AND coalesce(open, false))) AS parts, coalesce(sum((t1 - t0) * d) FILTER (within), 0) AS m FROM runs GROUP BY 1)
  SELECT way_id, coalesce(parts, 0) AS parts, round(coalesce(m, 0), 4) AS within_m FROM (SELECT DISTINCT way_id FROM nodes) LEFT JOIN told USING (way_id)"""


def _polygon_sql() -> str:
    """One pass for each edge of the window: of every side its crossing, then its end, if inside."""
    parts = [_NODES, "p0 AS (SELECT way_id, idx AS i, x, y FROM nodes)"]
    for k, edge in enumerate(_EDGES):
        after = lambda c: f"coalesce(lead({c}) OVER (PARTITION BY way_id ORDER BY i), first_value({c}) OVER (PARTITION BY way_id ORDER BY i)) AS {c}2"  # noqa: E731, B023
        parts.append(f"q{k} AS (SELECT *, {_side_of(edge, 'x', 'y')} AS s, {_side_of(edge, 'x2', 'y2')} AS e FROM (SELECT way_id, i, x, y, {after('x')}, {after('y')} FROM p{k}))")
        cross = "x + s / (s - e) * (x2 - x) AS x, y + s / (s - e) * (y2 - y) AS y"
        parts.append(f"r{k} AS (SELECT way_id, 2 * i AS i, {cross} FROM q{k} WHERE (s > 0 AND e < 0) OR (s < 0 AND e > 0) UNION ALL SELECT way_id, 2 * i + 1, x2, y2 FROM q{k} WHERE e >= 0)")
        parts.append(f"p{k + 1} AS (SELECT way_id, row_number() OVER (PARTITION BY way_id ORDER BY i) AS i, x, y FROM r{k})")
    last = "SELECT way_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2, first_value(x) OVER w AS x0, first_value(y) OVER w AS y0 FROM p4 WINDOW w AS (PARTITION BY way_id ORDER BY i)"
    return "WITH " + ",\n  ".join(parts) + f"\n  SELECT way_id, round(sum((x - x0) * (y2 - y0) - (x2 - x0) * (y - y0)) / 2, 2) AS area FROM ({last}) GROUP BY way_id"


def _turn(a: str, b: str, c: str) -> str:
    return f"sign(({b}_x - {a}_x) * ({c}_y - {a}_y) - ({b}_y - {a}_y) * ({c}_x - {a}_x))"


def _on(a: str, b: str, c: str) -> str:
    return f"({_turn(a, b, c)} = 0 AND {c}_x BETWEEN least({a}_x, {b}_x) AND greatest({a}_x, {b}_x) AND {c}_y BETWEEN least({a}_y, {b}_y) AND greatest({a}_y, {b}_y))"


def _back(a: str, b: str, d: str) -> str:
    """Side (b, d) runs back along side (a, b)."""
    return f"({_turn(a, b, d)} = 0 AND ({d}_x - {b}_x) * ({b}_x - {a}_x) + ({d}_y - {b}_y) * ({b}_y - {a}_y) < 0)"


_FAULTS = f"""WITH {_NODES},
  closed AS (SELECT way_id, idx, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2, first_value(x) OVER w AS x0, first_value(y) OVER w AS y0, count(*) OVER (PARTITION BY way_id) + 1 AS points
    FROM nodes WINDOW w AS (PARTITION BY way_id ORDER BY idx)),
  sides AS (SELECT way_id, row_number() OVER (PARTITION BY way_id ORDER BY idx) AS k, count(*) OVER (PARTITION BY way_id) AS n, x, y, x2, y2 FROM closed WHERE x <> x2 OR y <> y2),
  pairs AS (SELECT a.way_id, a.k AS i, b.k AS j, a.n, a.x AS a_x, a.y AS a_y, a.x2 AS b_x, a.y2 AS b_y, b.x AS c_x, b.y AS c_y, b.x2 AS d_x, b.y2 AS d_y FROM sides a JOIN sides b ON a.way_id = b.way_id AND a.k < b.k),
  bad AS (SELECT DISTINCT way_id FROM pairs WHERE CASE
    WHEN n = 2 THEN {_back('a', 'b', 'd')} OR {_back('c', 'd', 'b')}
    WHEN j = i + 1 THEN {_back('a', 'b', 'd')}
    WHEN i = 1 AND j = n THEN {_back('c', 'd', 'b')}
    ELSE ({_turn('a', 'b', 'c')} * {_turn('a', 'b', 'd')} < 0 AND {_turn('c', 'd', 'a')} * {_turn('c', 'd', 'b')} < 0) OR {_on('a', 'b', 'c')} OR {_on('a', 'b', 'd')} OR {_on('c', 'd', 'a')} OR {_on('c', 'd', 'b')} END),
  rings AS (SELECT way_id, max(points) AS points, sum((x - x0) * (y2 - y0) - (x2 - x0) * (y - y0)) AS area FROM closed GROUP BY 1)
  SELECT CASE WHEN points < 4 THEN 'too_few_points' WHEN way_id IN (SELECT way_id FROM bad) THEN 'self_intersection' WHEN area = 0 THEN 'no_area' ELSE 'valid' END AS fault, count(*) AS rings FROM rings GROUP BY 1"""

ORACLES = {"canonical_tiles": _TILES, "raster_round_trip": _ROUND_TRIP, "line_clip_parts": _LINES, "polygon_clip": _polygon_sql(), "ring_faults": _FAULTS}
