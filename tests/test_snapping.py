"""Snapping amid nodes that lie far denser than its limit."""

from __future__ import annotations

import math
import random

from causeway.operators import spatial


def test_dense_nodes_are_not_all_met(spark, monkeypatch):
    draw = random.Random(3)
    spots = [(float(x), float(y)) for x in range(30) for y in range(30)]
    nodes = [(1000 * k + n, x, y) for k in (3, 1, 2) for n, (x, y) in enumerate(spots)]
    points = [(k, draw.uniform(-1, 31), draw.uniform(-1, 31)) for k in range(150)] + [(900, 4.5, 7.0), (901, 700.0, -60.0)]
    places, reaches = [], []
    near = spatial._nearest
    monkeypatch.setattr(spatial, "_nearest", lambda p, n, reach: places.append(n.count()) or reaches.append(reach) or near(p, n, reach))
    rows = spatial.snap(spark.createDataFrame(points, "point_id bigint, x_m double, y_m double"), spark.createDataFrame(nodes, "node_id bigint, x_m double, y_m double"), limit_m=12.0).collect()
    got = {r["point_id"]: (r["status"], r["nearest_node_id"], r["nearest_distance_m"]) for r in rows}
    want = {}
    for p, x, y in points:
        d, n = min((math.sqrt((x - u) * (x - u) + (y - v) * (y - v)), n) for n, u, v in nodes)
        want[p] = ("snapped", n, d) if d <= 12.0 else ("beyond_snap_limit", None, d)
    assert len(rows) == len(points) and got == want
    assert places[0] == 900 and reaches[0] < 1.0  # one node for each place, and a cell meets few of them
