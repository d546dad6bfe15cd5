"""Replay by hash trees, byte-stable files and counters of the graph's rejects."""

from __future__ import annotations

import gzip
import hashlib
import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from causeway.contracts import ContractError
from causeway.operators import graph, replay
from causeway.sources.stable import write_stable_lines

SCHEMA = "k long, band string, v double, parts array<int>"


def _same(x, y):
    return x is y or (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y)) or x == y


def _frozen(row):
    return tuple(tuple(c) if isinstance(c, list) else "nan" if isinstance(c, float) and math.isnan(c) else c for c in row)


def test_differences_by_brute_force(spark):
    draw = random.Random(3)

    def row():
        return [draw.choice([None, *range(12)]), draw.choice(["a", "b", None]), draw.choice([None, 0.0, 1.5, float("nan")]), draw.choice([None, [], [1], [1, 2]])]

    left = [row() for _ in range(150)]
    right = [list(r) for r in left if draw.random() < 0.9] + [row() for _ in range(20)]
    for r in right[:20]:
        r[2] = -0.0 if r[2] == 0.0 else r[2]
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA).select("v", "parts", "k", "band")
    one, two = Counter(map(_frozen, left)), Counter(map(_frozen, right))
    expected = {}
    for r in one | two:
        lost, gained = max(one[r] - two[r], 0), max(two[r] - one[r], 0)
        if lost or gained:
            was = expected.setdefault(r[:2], [[], []])
            was[0] += [r] * lost
            was[1] += [r] * gained
    told = {k: (len(x), len(y), [c for c, p, q in (("parts", x[0][3], y[0][3]), ("v", x[0][2], y[0][2])) if p != q] if len(x) == len(y) == 1 else None) for k, (x, y) in expected.items()}
    for depth in (1, 2, None):
        got = {(r["k"], r["band"]): (r["n_left"], r["n_right"], r["changed"]) for r in replay.differences(a, b, ["k", "band"], depth=depth).collect()}
        assert got == told and got
    assert replay.differences(a, a, ["k"]).count() == 0
    assert replay.differences(a.limit(0), a.limit(0), ["k"]).count() == 0
    assert replay.differences(a.limit(0), a, ["k"]).agg(F.sum("n_right")).first()[0] == len(left)


def test_columns_must_agree(spark):
    a = spark.createDataFrame([(1, 2.0)], "k long, v double")
    for other, keys in ((a.select("k"), ["k"]), (a.withColumn("v", F.lit(1)), ["k"]), (a, ["z"]), (a, [])):
        with pytest.raises(ContractError):
            replay.differences(a, other, keys)


def test_one_changed_pixel_reads_one_leaf(spark):
    """Of 200,000 pixels one differs: one leaf of 4,096 is looked at, and kept trees need no scan of the rest."""
    a = spark.range(200_000).select(F.col("id").alias("px"), (F.col("id") * 0.5).alias("v"))
    b = a.withColumn("v", F.when(F.col("px") == 77_777, F.lit(float("nan"))).otherwise(F.col("v")))
    trees = tuple(replay.hash_tree(t, ["px"], 2) for t in (a, b))
    leaves = replay.differing_leaves(*trees, 2)
    assert leaves.count() == 1 and trees[0].filter("level = 2").count() == 4096
    node = leaves.first()["node"]
    assert trees[0].filter(F.col("level") == 2).filter(F.col("node") == node).first()["rows"] < 200
    got = replay.differences(a, b, ["px"], depth=2, trees=trees).collect()
    assert [tuple(r) for r in got] == [(77_777, 1, 1, ["v"])]
    assert trees[0].filter("level = 0").first()["rows"] == 200_000


def test_files_are_equal_for_every_partitioning(spark, tmp_path):
    rows = [(k % 50, None if k % 7 == 0 else f"té{k % 9}", k / 4) for k in range(1_003)] + [(None, "x", 1.0)] * 3
    df = spark.createDataFrame(rows, "k long, line string, place double")
    seen = []
    for parts in (1, 8, 61):
        path = str(tmp_path / str(parts))
        found = {r["file"]: r for r in write_stable_lines(df.repartition(parts, "place"), path, ["k"], rows_per_file=100).collect()}
        files = {n: open(f"{path}/{n}", "rb").read() for n in sorted(os.listdir(path)) if n.startswith("part-")}
        assert not [n for n in os.listdir(path) if n.endswith(".gz") is False and "crc" not in n]
        assert {n: hashlib.sha256(d).hexdigest() for n, d in files.items()} == {n: r["file_sha256"] for n, r in found.items()}
        assert sum(r["rows"] for r in found.values()) == len(rows) and len(files) == 11
        seen.append(files)
    assert seen[0] == seen[1] == seen[2]
    assert gzip.decompress(seen[0]["part-000000.jsonl.gz"]).decode().splitlines()[0] == '{"k":null,"line":"x","place":1.0}'
    back = spark.read.schema("k long, line string, place double").json(f"{tmp_path}/8")
    assert Counter(map(tuple, back.collect())) == Counter(rows)
    with pytest.raises(FileExistsError):
        write_stable_lines(df, f"{tmp_path}/8", ["k"])
    assert write_stable_lines(df.limit(0), f"{tmp_path}/none", ["k"]).count() == 0


def test_counters_of_the_graph(spark):
    tags = {"highway": "primary"}
    ways = spark.createDataFrame([(1, [1, 2, 2, 3, 4], tags), (2, [1, 9], tags), (3, [1, 2], {"highway": "footway"}), (4, [5], tags)], "way_id long, nodes array<long>, tags map<string,string>")
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 0.0), (3, 5.0, 0.001), (4, 9.0, 0.0), (5, 1.0, 1.0)], "node_id long, x_m double, y_m double")
    out, counts = graph.counted_segments(ways, nodes)
    assert counts == {"ways": 4, "rejected_ways": 1, "steps": 5, "self_loops": 1, "unplaced": 1, "near_zero": 1, "segments": 2}
    assert out.count() == 2 == graph.segments(ways, nodes).count()
    assert set(graph.counted_segments(ways.limit(0), nodes)[1].values()) == {0}
    none = graph.counted_segments(ways.filter("way_id > 0").repartition(3), nodes.filter("node_id > 100").repartition(3))[1]
    assert none["unplaced"] == 4 and none["segments"] == none["near_zero"] == 0
