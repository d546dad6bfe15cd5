"""Queries of replay by hash trees, byte-stable files and counted rejects, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators import graph, replay
from causeway.plans.bindings import VIEWS, table, view, ways
from causeway.sources.stable import write_stable_lines
from causeway.staging import new_path

# Lines as pixels of a first run; a second run changes, loses and gains a few.
_FIRST = "SELECT l_orderkey, cast(l_linenumber AS bigint) AS l_linenumber, l_partkey, cast(l_quantity AS double) AS vh, CASE WHEN l_tax = 0 THEN cast('NaN' AS double) ELSE l_discount / l_tax END AS ratio FROM {lineitem}"
_SECOND = f"""SELECT l_orderkey, CASE WHEN l_orderkey % 1999 = 11 THEN l_linenumber + 100 ELSE l_linenumber END AS l_linenumber, l_partkey,
  CASE WHEN (l_orderkey * 31 + l_linenumber) % 997 = 5 THEN vh + 1 ELSE vh END AS vh, CASE WHEN (l_orderkey * 31 + l_partkey) % 1201 = 3 THEN NULL ELSE ratio END AS ratio
  FROM ({_FIRST}) WHERE l_orderkey % 1499 <> 7"""


def replay_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels that differ between two runs, with the bands that changed."""
    lines = table(spark, sf_dir, "lineitem")
    first, second = (spark.sql(text, lineitem=lines) for text in (_FIRST, _SECOND))
    found = replay.differences(first, second, ["l_orderkey", "l_linenumber"])
    return found.withColumn("changed", F.array_join("changed", ","))


def stable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-stable files of the orders: rows and digest of the content of each."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return write_stable_lines(rows, new_path(spark, "stable"), ["o_orderkey"], rows_per_file=2_000).drop("file_sha256")


def graph_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the graph took and left out, counted in the pass that builds it."""
    _, counts = graph.counted_segments(ways(spark, sf_dir), view(spark, sf_dir, "node_v"))
    return spark.createDataFrame(sorted(counts.items()), "counter string, n long")


QUERIES = {f.__name__: f for f in (replay_pixels, stable_files, graph_counters)}


# SQL, written apart from the operators -------------------------------------

_REPLAY = f"""WITH u AS (SELECT *, 1 AS side FROM ({_FIRST}) UNION ALL SELECT *, -1 FROM ({_SECOND})),
  net AS (SELECT l_orderkey, l_linenumber, l_partkey, vh, ratio, sum(side) AS copies FROM u GROUP BY ALL HAVING sum(side) <> 0),
  k AS (SELECT l_orderkey, l_linenumber, sum(greatest(copies, 0))::BIGINT AS n_left, sum(greatest(-copies, 0))::BIGINT AS n_right FROM net GROUP BY ALL)
  SELECT k.*, CASE WHEN n_left = 1 AND n_right = 1 THEN concat_ws(',', CASE WHEN a.l_partkey IS DISTINCT FROM b.l_partkey THEN 'l_partkey' END, CASE WHEN a.ratio IS DISTINCT FROM b.ratio THEN 'ratio' END, CASE WHEN a.vh IS DISTINCT FROM b.vh THEN 'vh' END) END AS changed
  FROM k LEFT JOIN net a ON n_left = 1 AND n_right = 1 AND a.copies > 0 AND a.l_orderkey = k.l_orderkey AND a.l_linenumber = k.l_linenumber
    LEFT JOIN net b ON n_left = 1 AND n_right = 1 AND b.copies < 0 AND b.l_orderkey = k.l_orderkey AND b.l_linenumber = k.l_linenumber""".replace("{lineitem}", "lineitem")

_STABLE = """SELECT concat('part-', lpad(n::VARCHAR, 6, '0'), '.jsonl.gz') AS file, count(*) AS rows, sha256(string_agg(line || chr(10), '' ORDER BY o_orderkey, line)) AS content_sha256
  FROM (SELECT o_orderkey, line, (row_number() OVER (ORDER BY o_orderkey, line) - 1) // 2000 AS n
        FROM (SELECT o_orderkey, '{"o_custkey":' || coalesce(o_custkey::VARCHAR, 'null') || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":' || coalesce('"' || o_orderstatus || '"', 'null') || '}' AS line FROM orders)) GROUP BY n"""

_COUNTERS = f"""WITH w AS (SELECT way_id, coalesce(highway, '') NOT IN ('primary', 'secondary', 'tertiary', 'residential') OR coalesce(access, '') = 'private' OR coalesce(oneway, '') = 'reversible' AS rejected FROM ({VIEWS['way_v']}) WHERE way_id IN (SELECT way_id FROM ({VIEWS['way_node_v']}))),
  s AS (SELECT way_id, node AS a, lead(node) OVER (PARTITION BY way_id ORDER BY idx) AS b FROM ({VIEWS['way_node_v']})),
  t AS (SELECT a, b FROM s JOIN w USING (way_id) WHERE NOT rejected AND b IS NOT NULL),
  p AS (SELECT sqrt((m.x_m - n.x_m) * (m.x_m - n.x_m) + (m.y_m - n.y_m) * (m.y_m - n.y_m)) AS d FROM t JOIN ({VIEWS['node_v']}) m ON m.node_id = a JOIN ({VIEWS['node_v']}) n ON n.node_id = b WHERE a <> b),
  c AS (SELECT (SELECT count(*) FROM w) AS ways, (SELECT count(*) FROM w WHERE rejected) AS rejected_ways, (SELECT count(*) FROM t) AS steps, (SELECT count(*) FROM t WHERE a = b) AS self_loops,
    (SELECT count(*) FROM t WHERE a <> b) - (SELECT count(*) FROM p) AS unplaced, (SELECT count(*) FROM p WHERE d < 0.01) AS near_zero, (SELECT count(*) FROM p WHERE d >= 0.01) AS segments)
  UNPIVOT c ON COLUMNS(*) INTO NAME counter VALUE n"""
for _t in ("lineitem", "part", "orders"):
    _COUNTERS = _COUNTERS.replace(f"{{{_t}}}", _t)

ORACLES = {"replay_pixels": _REPLAY, "stable_files": _STABLE, "graph_counters": _COUNTERS}
