"""Files along a curve: lookups equal a scan of all rows and open few files."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from causeway.operators.spatial import nearest_link
from causeway.sources import layout

SCHEMA = "segment_id string, ax double, ay double, bx double, by_ double"


def _box():
    return F.least("ax", "bx"), F.least("ay", "by_"), F.greatest("ax", "bx"), F.greatest("ay", "by_")


def _rows(count, seed=5, reach=4.0):
    draw = random.Random(seed)
    rows = []
    for k in range(count):
        x, y = draw.uniform(-3000, 7000), draw.uniform(100, 5100)
        far = 900.0 if k % 97 == 0 else reach
        rows.append((f"s{k:05d}", x, y, x + draw.uniform(-far, far), y + draw.uniform(-far, far)))
    return rows


def _meeting(rows, view):
    return sorted(r[0] for r in rows if min(r[1], r[3]) <= view[2] and max(r[1], r[3]) >= view[0] and min(r[2], r[4]) <= view[3] and max(r[2], r[4]) >= view[1])


def test_ranges_cover_exactly_when_there_are_enough():
    draw = random.Random(2)
    for _ in range(30):
        low = draw.randrange(layout._CELLS - 9), draw.randrange(layout._CELLS - 9)
        high = low[0] + draw.randrange(9), low[1] + draw.randrange(9)
        cells = {layout._interleaved(x, y) for x in range(low[0], high[0] + 1) for y in range(low[1], high[1] + 1)}
        exact = layout.curve_ranges(low, high, most=1 << 20)
        assert {p for a, b in exact for p in range(a, b + 1)} == cells
        coarse = layout.curve_ranges(low, high, most=8)
        assert len(coarse) <= 8 and all(any(a <= p <= b for a, b in coarse) for p in cells)


def test_places_are_interleaved_bits(spark):
    cells = [(0, 0), (1, 0), (0, 1), (layout._CELLS - 1, 5), (123_456, 654_321), (layout._CELLS - 1, layout._CELLS - 1)]
    df = spark.createDataFrame(cells, "x long, y long")
    got = df.select((layout._spread(F.col("x")) + F.shiftleft(layout._spread(F.col("y")), 1)).alias("p")).collect()
    assert [r["p"] for r in got] == [layout._interleaved(x, y) for x, y in cells]


def test_views_equal_a_scan_and_open_few_files(spark, tmp_path):
    rows = _rows(20_000)
    path = str(tmp_path / "roads")
    layout.write_layout(spark.createDataFrame(rows, SCHEMA).repartition(7), path, _box(), rows_per_file=200)
    total = len(spark.read.parquet(path).inputFiles())
    assert total >= 100 and spark.read.parquet(path).count() == len(rows)
    draw = random.Random(9)
    views = [(x, y, x + w, y + w / 2) for x, y, w in ((draw.uniform(-3200, 7000), draw.uniform(0, 5100), draw.choice([0.0, 5.0, 60.0, 400.0])) for _ in range(8))]
    views += [(-1e9, -1e9, 1e9, 1e9), (9e5, 0.0, 9e5, 1.0), (float("-inf"), 200.0, float("inf"), 200.0), (rows[4][1], rows[4][2], rows[4][1], rows[4][2])]
    for view in views:
        found = layout.in_view(spark, path, view)
        assert sorted(r["segment_id"] for r in found.collect()) == _meeting(rows, view)
        if 0 <= view[2] - view[0] <= 60:
            assert len(found.inputFiles()) <= total // 5, view
        assert found.columns == ["segment_id", "ax", "ay", "bx", "by_"]


def test_pointers_equal_a_scan_and_open_few_files(spark, tmp_path):
    rows = _rows(8_000, seed=6)
    df = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path / "roads")
    layout.write_layout(df, path, _box(), rows_per_file=100)
    total = len(spark.read.parquet(path).inputFiles())
    for x, y, limit, scale in ((rows[7][1], rows[7][2], 50.0, 0.6), (0.0, 2500.0, 400.0, 1.0), (-9e4, 0.0, 10.0, 1.0), (100.0, 100.0, 0.0, 1.0)):
        found = layout.link_under(spark, path, x, y, limit=limit, x_scale=scale)
        assert found.collect() == nearest_link(df, x, y, limit=limit, x_scale=scale).collect()
    assert 0 < len(layout.in_view(spark, path, (rows[7][1] - 2, rows[7][2] - 2, rows[7][1] + 2, rows[7][2] + 2)).inputFiles()) <= total // 5
    for limit, scale in ((-1.0, 1.0), (float("nan"), 1.0), (1.0, 0.0)):
        with pytest.raises(ValueError):
            layout.link_under(spark, path, 0.0, 0.0, limit=limit, x_scale=scale)


def test_broken_boxes_ties_and_empty_tables(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [("same", 5.0, 5.0, 5.0, 5.0)] * 900 + [("a", None, 1.0, 2.0, 3.0), ("b", nan, 1.0, 2.0, 3.0), ("c", -inf, 1.0, 2.0, 3.0), ("d", 1.0, 1.0, inf, 3.0), (None, 6.0, 5.0, 6.0, 5.0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("tags", F.create_map(F.lit("k"), F.lit("v")))
    path = str(tmp_path / "hot")
    boxes = F.col("ax"), F.col("ay"), F.col("bx"), F.col("by_")
    layout.write_layout(df, path, boxes, rows_per_file=50)
    assert spark.read.parquet(path).count() == len(rows)
    assert spark.read.parquet(f"{path}.files").agg(F.max("rows")).first()[0] <= 50
    assert layout.in_view(spark, path, (0.0, 0.0, 9.0, 9.0)).count() == 901
    assert layout.in_view(spark, path, (-inf, -inf, inf, inf)).count() == 901
    assert layout.in_view(spark, path, (5.5, 0.0, 6.0, 5.0)).first()["segment_id"] is None
    layout.write_layout(df.limit(0), str(tmp_path / "none"), boxes)
    empty = layout.in_view(spark, str(tmp_path / "none"), (0.0, 0.0, 1.0, 1.0))
    assert empty.count() == 0 and empty.columns == df.columns
    with pytest.raises(ValueError):
        layout.write_layout(df.withColumn("Curve_Place", F.lit(1)), str(tmp_path / "clash"), boxes)
    for view in ((1.0, 0.0, 0.0, 1.0), (nan, 0.0, 1.0, 1.0)):
        with pytest.raises(ValueError):
            layout.in_view(spark, path, view)
