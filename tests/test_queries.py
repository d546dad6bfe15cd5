"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from causeway.plans import case_queries, pixel_queries, place_queries, replay_queries, road_queries, shape_queries

DATA = "/root/testdata/sf0.001"
#: Queries that solve shortest paths under all assumptions take long; one of them stands for all here.
SLOW = {"batched_scenario_cost", "access_rows", "ranking_reversals", "access_stability", "first_disconnected", "origin_overview", "origin_table_sorted", "path_audit", "graph_quality", "boundary_audit"}
NAMES = [n for n in [*pixel_queries.QUERIES, *road_queries.QUERIES, *case_queries.QUERIES, *shape_queries.QUERIES, *replay_queries.QUERIES, *place_queries.QUERIES] if n in entry_module.oracle_sql() and n not in SLOW]


@pytest.fixture(scope="module")
def sql():
    db = duckdb.connect()
    for name in os.listdir(DATA):
        db.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return db


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sql, name):
    df = entry_module.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    found = sql.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(_plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_every_query_without_sql_is_known():
    own = {**pixel_queries.QUERIES, **road_queries.QUERIES, **case_queries.QUERIES, **shape_queries.QUERIES, **replay_queries.QUERIES, **place_queries.QUERIES}
    assert {n for n in own if n not in entry_module.oracle_sql()} == {"utm_projection", "logistic_fit", "monotone_fit"}
