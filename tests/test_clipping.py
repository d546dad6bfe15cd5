"""Clipping and validity of geometries against plain Python on random shapes."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from causeway.functions import clipping as cl

QUAD = [(1.0, 1.0), (9.0, 0.0), (10.0, 8.0), (2.0, 9.0), (1.0, 1.0)]
KIND = "array<struct<x: double, y: double>>"


def _inside(window, x, y, slack=0.0):
    return all((q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0]) >= -slack for p, q in zip(window, window[1:]))


def _length_inside(line, window):
    """Length inside by bisection-free half-plane cuts of each side."""
    total = 0.0
    for a, b in zip(line, line[1:]):
        t0, t1 = 0.0, 1.0
        for p, q in zip(window, window[1:]):
            da = (q[0] - p[0]) * (a[1] - p[1]) - (q[1] - p[1]) * (a[0] - p[0])
            db = (q[0] - p[0]) * (b[1] - p[1]) - (q[1] - p[1]) * (b[0] - p[0])
            if da < 0 and db < 0:
                t1 = -1.0
            elif da < 0 <= db:
                t0 = max(t0, da / (da - db))
            elif db < 0 <= da:
                t1 = min(t1, da / (da - db))
        total += max(0.0, t1 - t0) * math.dist(a, b)
    return total


def _area(ring):
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:])) / 2


def _in_ring(ring, x, y):
    inside = False
    for p, q in zip(ring, ring[1:]):
        if (p[1] > y) != (q[1] > y) and x < (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]) + p[0]:
            inside = not inside
    return inside


def _star(rng, n, x, y, r):
    """A ring without crossings."""
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    far = [rng.uniform(0.3, 1) * r for _ in angles]
    ring = [(x + d * math.cos(a), y + d * math.sin(a)) for a, d in zip(angles, far, strict=True)]
    return [*ring, ring[0]]


def _floats(shape):
    return tuple(map(float, shape)) if isinstance(shape, tuple) else [_floats(v) for v in shape]


def _geometries(spark, rows, kind):
    rows = _floats(rows)
    return spark.createDataFrame(list(enumerate(rows)), f"id int, g {kind}")


def _window(ring):
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ring])


@pytest.mark.parametrize("turned", [False, True])
def test_lines_keep_their_parts(spark, turned):
    rng = random.Random(1)
    lines = [[(rng.uniform(-3, 13), rng.uniform(-3, 12)) for _ in range(rng.randint(2, 12))] for _ in range(200)]
    lines += [[(0, 5), (12, 5), (12, 6), (0, 6)], [(3, 3), (3, 3), (4, 4)], [(-5, -5), (-4, -4)], [(1, 1), (-3, 1)], [(5, 5)], []]
    window = QUAD[::-1] if turned else QUAD
    df = _geometries(spark, lines, KIND).select("id", cl.clip_line(F.col("g"), _window(window)).alias("parts"))
    df = df.withColumn("length", F.aggregate("parts", F.lit(0.0), lambda s, p: s + cl.line_length(p)))
    for r in df.collect():
        line = lines[r["id"]]
        assert r["length"] == pytest.approx(_length_inside(line, QUAD), abs=1e-9)
        assert all(_inside(QUAD, p["x"], p["y"], 1e-9) for part in r["parts"] for p in part)
        ends = [(part[0], part[-1]) for part in r["parts"]]
        assert all(a[1] != b[0] for a, b in zip(ends, ends[1:]))  # parts that go on are one
    assert len(df.filter("id = 200").first()["parts"]) == 2
    assert df.filter("id = 203").first()["parts"] == []


def test_polygons_keep_their_area(spark):
    """Area inside and outside the window add up, by clipping with the four half-planes' complements."""
    rng = random.Random(2)
    rings = [_star(rng, rng.randint(3, 15), rng.uniform(-1, 11), rng.uniform(-1, 10), rng.uniform(0.5, 9)) for _ in range(120)]
    df = _geometries(spark, [[r] for r in rings], f"array<{KIND}>")
    window = _window(QUAD)
    got = df.select("id", cl.clip_polygon(F.col("g"), window).alias("c")).withColumn("area", F.when(F.size("c") > 0, cl.polygon_area(F.col("c"))).otherwise(0.0)).collect()

    def cut(ring, p, q, sign):
        out = []
        for a, b in zip(ring, ring[1:]):
            da, db = (sign * ((q[0] - p[0]) * (v[1] - p[1]) - (q[1] - p[1]) * (v[0] - p[0])) for v in (a, b))
            if da * db < 0:
                t = da / (da - db)
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
            if db >= 0:
                out.append(b)
        return [*out, out[0]] if out else []

    for r in got:
        inside, outside = rings[r["id"]], 0.0
        for p, q in zip(QUAD, QUAD[1:]):
            outside += abs(_area(cut(inside, p, q, -1)))
            inside = cut(inside, p, q, 1)
        assert r["area"] == pytest.approx(abs(_area(inside)), abs=1e-9)
        assert r["area"] + outside == pytest.approx(abs(_area(rings[r["id"]])), abs=1e-8)
    holed = [[QUAD, [(4, 4), (5, 4), (5, 5), (4, 5), (4, 4)], [(20, 20), (21, 20), (21, 21), (20, 20)]]]
    one = _geometries(spark, holed, f"array<{KIND}>").select(cl.clip_polygon(F.col("g"), window).alias("c")).select(F.size("c").alias("n"), cl.polygon_area(F.col("c")).alias("a")).first()
    assert one["n"] == 2 and one["a"] == pytest.approx(_area(QUAD) - 1)


def test_interior_points_lie_inside(spark):
    rng = random.Random(3)
    rings = [_star(rng, rng.randint(3, 20), 0, 0, 5) for _ in range(150)]
    polygons = [[r] for r in rings] + [[[(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(1, 1), (1, 9), (9, 9), (9, 1), (1, 1)]], [[(0, 0), (1, 1), (2, 2), (0, 0)]]]
    for r in _geometries(spark, polygons, f"array<{KIND}>").select("id", cl.interior_point(F.col("g")).alias("p")).collect():
        rings_ = polygons[r["id"]]
        if r["id"] == len(polygons) - 1:
            assert r["p"] is None
        else:
            assert _in_ring(rings_[0], *r["p"]) and not any(_in_ring(h, *r["p"]) for h in rings_[1:])


def _crosses(ring):
    """All pairs of sides, exactly on integers."""
    sides = [s for s in zip(ring, ring[1:]) if s[0] != s[1]]
    n = len(sides)
    turn = lambda p, q, v: (q[0] - p[0]) * (v[1] - p[1]) - (q[1] - p[1]) * (v[0] - p[0])
    on = lambda p, q, v: turn(p, q, v) == 0 and min(p[0], q[0]) <= v[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= v[1] <= max(p[1], q[1])
    for i in range(n):
        for j in range(i + 1, n):
            (a, b), (c, d) = sides[i], sides[j]
            if j == i + 1 or (i == 0 and j == n - 1):
                (a, b), (c, d) = (sides[i], sides[j]) if j == i + 1 else (sides[j], sides[i])
                if turn(a, b, d) == 0 and (d[0] - c[0]) * (b[0] - a[0]) + (d[1] - c[1]) * (b[1] - a[1]) < 0:
                    return True
            elif (turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0) or on(a, b, c) or on(a, b, d) or on(c, d, a) or on(c, d, b):
                return True
    return False


def test_rings_that_cross_themselves(spark):
    rng = random.Random(4)
    rings = []
    for _ in range(400):
        ring = [(float(rng.randint(0, 6)), float(rng.randint(0, 6))) for _ in range(rng.randint(3, 7))]
        rings.append([*ring, ring[0]])
    rings += [_star(rng, 40, 0, 0, 9) for _ in range(20)]
    got = {r["id"]: r["x"] for r in _geometries(spark, rings, KIND).select("id", cl.ring_crosses_itself(F.col("g")).alias("x")).collect()}
    want = {k: _crosses(r) for k, r in enumerate(rings)}
    assert got == want and 20 < sum(want.values()) < 400


def test_every_fault_has_its_reason(spark):
    square = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    hole = [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]
    cases = {
        None: [[square], [square, hole], [square[::-1], hole], [square, hole, [(2, 2), (3, 2), (3, 3), (2, 2)]]],
        "empty": [None, [], [[]], [square, []]],
        "non_finite": [[[(0, 0), (float("nan"), 1), (1, 1), (0, 0)]], [[(0, 0), (1, float("inf")), (1, 1), (0, 0)]], [[(0, 0), None, (1, 1), (0, 0)]]],
        "too_few_points": [[[(0, 0), (1, 1), (0, 0)]]],
        "not_closed": [[[(0, 0), (4, 0), (4, 4), (0, 4)]], [square, hole[:-1]]],
        "self_intersection": [[[(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)]], [[(0, 0), (1, 1), (2, 2), (0, 0)]], [[(0, 0), (4, 0), (4, 4), (2, 0), (0, 4), (0, 0)]]],
        "no_area": [[[(1, 1)] * 4]],
        "hole_outside_shell": [[square, [(3, 1), (6, 1), (6, 2), (3, 1)]], [square, [(9, 9), (10, 9), (10, 10), (9, 9)]]],
        "holes_overlap": [[square, hole, [(1.5, 1.5), (3, 1.5), (3, 3), (1.5, 1.5)]], [square, hole, hole]],
    }
    rows = [(reason, polygon) for reason, polygons in cases.items() for polygon in polygons]
    float_ = lambda p: None if p is None else [[None if v is None else (float(v[0]), float(v[1])) for v in r] for r in p]
    df = spark.createDataFrame([(k, r, float_(p)) for k, (r, p) in enumerate(rows)], f"id int, reason string, g array<{KIND}>")
    for r in df.withColumn("got", cl.polygon_fault(F.col("g"))).collect():
        assert r["got"] == r["reason"], rows[r["id"]]
    lines = {None: [(0, 0), (1, 1), (0, 0)], "too_few_points": [(2, 2), (2, 2)], "empty": [], "non_finite": [(0, float("nan")), (1, 1)]}
    df = spark.createDataFrame([(k, [tuple(map(float, p)) for p in v]) for k, v in lines.items()], f"reason string, g {KIND}")
    assert all(r["got"] == r["reason"] for r in df.withColumn("got", cl.line_fault(F.col("g"))).collect())
