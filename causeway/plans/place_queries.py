"""Queries by place over segments laid out along a curve, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.plans import bundle, road_oracles
from causeway.plans.bindings import view, ways
from causeway.operators import graph
from causeway.staging import new_path

#: Views of the study by name: a street corner, a quarter, a strip and a place beyond the plane.
VIEWS = {"corner": (500.0, 500.0, 504.0, 504.0), "quarter": (0.0, 0.0, 90.0, 90.0), "strip": (0.0, 777.0, 1000.0, 777.5), "beyond": (5000.0, 0.0, 6000.0, 1.0)}
#: Pointers by name, with the reach of a click.
POINTERS = {"centre": (512.5, 487.5), "south": (77.25, 3.5), "edge": (998.5, 1008.5), "far": (-400.0, 40.0)}
REACH = 25.0


def _placed(spark: SparkSession, sf_dir: str) -> str:
    path = new_path(spark, "placed")
    segments = graph.segments(ways(spark, sf_dir), view(spark, sf_dir, "node_v"))
    bundle.place_roads(segments.select("segment_id", "ax", "ay", "bx", "by_"), f"{path}/places", rows_per_file=20_000)
    return path


def roads_in_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All roads of each view."""
    path = _placed(spark, sf_dir)
    return reduce(DataFrame.unionByName, [bundle.roads_in_view(spark, path, box).select(F.lit(name).alias("view"), "segment_id") for name, box in VIEWS.items()])


def roads_under_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The road under each pointer, if there is one within its reach."""
    path = _placed(spark, sf_dir)
    found = [bundle.road_under(spark, path, x, y, limit=REACH, x_scale=0.78).select(F.lit(name).alias("pointer"), "segment_id", F.round("distance", 6).alias("distance")) for name, (x, y) in POINTERS.items()]
    return reduce(DataFrame.unionByName, found)


QUERIES = {f.__name__: f for f in (roads_in_view, roads_under_pointers)}


# SQL over all segments, written apart from the layout -----------------------

_VIEWS = ", ".join(f"('{name}', {', '.join(f'{v}e0' for v in box)})" for name, box in VIEWS.items())
_POINTERS = ", ".join(f"('{name}', {x}e0, {y}e0)" for name, (x, y) in POINTERS.items())

ORACLES = {
    "roads_in_view": road_oracles._W
    + f"""SELECT v.name AS view, segment_id FROM sg JOIN (VALUES {_VIEWS}) v(name, x0, y0, x1, y1)
  ON least(ax, bx) <= x1 AND greatest(ax, bx) >= x0 AND least(ay, by_) <= y1 AND greatest(ay, by_) >= y0""",
    "roads_under_pointers": road_oracles._W
    + f""", q AS (SELECT name, segment_id, (bx - ax) * 0.78e0 AS dx, by_ - ay AS dy, (px - ax) * 0.78e0 AS qx, py - ay AS qy FROM sg CROSS JOIN (VALUES {_POINTERS}) p(name, px, py)),
  f AS (SELECT *, greatest(0e0, least(1e0, (qx * dx + qy * dy) / (dx * dx + dy * dy))) AS u FROM q),
  g AS (SELECT name, segment_id, sqrt((qx - u * dx) * (qx - u * dx) + (qy - u * dy) * (qy - u * dy)) AS gap FROM f)
  SELECT name AS pointer, segment_id, round(gap, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY gap, segment_id) AS n FROM g WHERE gap <= {REACH}e0) WHERE n = 1""",
}
