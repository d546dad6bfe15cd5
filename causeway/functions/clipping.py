"""Clipping of lines and polygons, and the validity of geometries, as column expressions.

A line or ring is an array of ``struct(x double, y double)``; a ring is closed (its last
point is its first).  A polygon is an array of rings, the shell first, then holes.  A
window is a convex ring.  All work is inside one row, on built-in higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from causeway.functions.geometry import covers

#: Reasons for which a geometry is not valid; null stands for a valid one.
REASONS = ("empty", "non_finite", "too_few_points", "not_closed", "no_area", "self_intersection", "hole_outside_shell", "holes_overlap")

POINT = "struct<x: double, y: double>"


def sides(line: Column) -> Column:
    """Sides of a line or ring as array of ``struct(p, q)``; none for fewer than two points."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.zip_with(F.slice(line, 1, n), F.slice(line, 2, n), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def twice_area(ring: Column) -> Column:
    """Twice the signed area of a closed ring, above 0 for counter-clockwise ones; taken from its first point, for exactness."""
    x0, y0 = ring[0]["x"], ring[0]["y"]
    return F.aggregate(sides(ring), F.lit(0.0), lambda s, e: s + (e["p"]["x"] - x0) * (e["q"]["y"] - y0) - (e["q"]["x"] - x0) * (e["p"]["y"] - y0))


def counter_clockwise(ring: Column) -> Column:
    return F.when(twice_area(ring) < 0, F.reverse(ring)).otherwise(ring)


def line_length(line: Column) -> Column:
    return F.aggregate(sides(line), F.lit(0.0), lambda s, e: s + F.sqrt((e["q"]["x"] - e["p"]["x"]) ** 2 + (e["q"]["y"] - e["p"]["y"]) ** 2))


def polygon_area(rings: Column) -> Column:
    """Area of the shell less that of the holes."""
    shell = F.abs(twice_area(rings[0])) / 2
    return F.aggregate(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), shell, lambda s, r: s - F.abs(twice_area(r)) / 2)


def _left(edge: Column, x: Column, y: Column) -> Column:
    """Above 0 for places to the left of an edge, 0 on it."""
    p, q = edge["p"], edge["q"]
    return (q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"])


def _at(s: Column, t: Column) -> Column:
    """Place on a side; exactly its ends for 0 and 1."""
    one = lambda c: F.when(t == 0, s["p"][c]).when(t == 1, s["q"][c]).otherwise(s["p"][c] + t * (s["q"][c] - s["p"][c]))
    return F.struct(one("x").alias("x"), one("y").alias("y"))


def clip_side(side: Column, window: Column) -> Column:
    """Cyrus-Beck: parameters ``struct(t0, t1)`` of the part of a side in a counter-clockwise convex window, null when outside.

    The border belongs to the window; a touching side keeps a part of no length.
    """

    def cut(state: Column, edge: Column) -> Column:
        start, end = _left(edge, side["p"]["x"], side["p"]["y"]), _left(edge, side["q"]["x"], side["q"]["y"])
        t = start / F.nullif(start - end, F.lit(0.0))
        enters = F.when((start < 0) & (end >= 0), t).otherwise(F.lit(0.0))
        leaves = F.when((start >= 0) & (end < 0), t).otherwise(F.lit(1.0))
        gone = (start < 0) & (end < 0)
        return F.struct(F.when(gone, F.lit(2.0)).otherwise(F.greatest(state["t0"], enters)).alias("t0"), F.least(state["t1"], leaves).alias("t1"))

    whole = F.struct(F.lit(0.0).alias("t0"), F.lit(1.0).alias("t1"))
    part = F.aggregate(sides(window), whole, cut)
    return F.transform(F.array(part), lambda k: F.when(k["t0"] <= k["t1"], k))[0]


def clip_line(line: Column, window: Column) -> Column:
    """Parts of a line inside a convex window: array of lines in order.

    A line that leaves and comes back has several parts.  Parts of no length, where it
    only touches the window, are left out.
    """
    ring = counter_clockwise(window)

    def step(state: Column, side: Column) -> Column:
        def grown(cut: Column) -> Column:
            piece = F.array(_at(side, cut["t0"]), _at(side, cut["t1"]))
            inside = cut.isNotNull() & (cut["t1"] > cut["t0"])
            goes_on = state["open"] & (cut["t0"] == 0)
            last = F.size(state["parts"])
            continued = F.concat(F.slice(state["parts"], 1, F.greatest(last - 1, F.lit(0))), F.array(F.concat(F.element_at(state["parts"], F.greatest(last, F.lit(1))), F.slice(piece, 2, 1))))
            parts = F.when(~F.coalesce(inside, F.lit(False)), state["parts"]).when(goes_on, continued).otherwise(F.concat(state["parts"], F.array(piece)))
            return F.struct(parts.alias("parts"), F.coalesce(inside & (cut["t1"] == 1), F.lit(False)).alias("open"))

        stays = F.coalesce((side["p"]["x"] == side["q"]["x"]) & (side["p"]["y"] == side["q"]["y"]), F.lit(False))
        moved = F.transform(F.array(clip_side(side, ring)), grown)[0]
        return F.when(stays, state).otherwise(moved)

    start = F.struct(F.array().cast(f"array<array<{POINT}>>").alias("parts"), F.lit(False).alias("open"))
    return F.aggregate(sides(line), start, step, lambda s: s["parts"])


def clip_ring(ring: Column, window: Column) -> Column:
    """Sutherland-Hodgman: the part of a closed ring in a convex window as one closed ring; empty when outside.

    Pieces that the window parts stay joined by sides of no width along its border, which adds no area.
    """

    def by_edge(points: Column, edge: Column) -> Column:
        def corner(s: Column) -> Column:
            start, end = _left(edge, s["p"]["x"], s["p"]["y"]), _left(edge, s["q"]["x"], s["q"]["y"])
            crossing = F.array(_at(s, start / F.nullif(start - end, F.lit(0.0))))
            none = F.array().cast(f"array<{POINT}>")
            return F.when((start >= 0) & (end >= 0), F.array(s["q"])).when((start >= 0) & (end < 0), F.when(start > 0, crossing).otherwise(none)).when((start < 0) & (end >= 0), F.when(end > 0, F.concat(crossing, F.array(s["q"]))).otherwise(F.array(s["q"]))).otherwise(none)

        kept = F.flatten(F.transform(sides(points), corner))
        return F.transform(F.array(kept), lambda k: F.when(F.size(k) > 0, F.concat(k, F.slice(k, 1, 1))).otherwise(k))[0]

    return F.aggregate(sides(counter_clockwise(window)), ring, by_edge)


def clip_polygon(rings: Column, window: Column) -> Column:
    """Part of a polygon in a convex window: its clipped shell and holes, those without area left out; empty when outside."""
    cut = F.transform(rings, lambda r: clip_ring(r, window))
    whole = lambda r: (F.size(r) >= 4) & (twice_area(r) != 0)
    return F.transform(F.array(cut), lambda c: F.when(whole(c[0]), F.filter(c, whole)).otherwise(F.array().cast(f"array<array<{POINT}>>")))[0]


def interior_point(rings: Column) -> Column:
    """A point inside a polygon: the middle of its widest stretch along a horizontal line; null without area.

    The line lies half-way between two neighbouring heights of corners, the pair next to
    the middle of the polygon's height that has a stretch.
    """
    corners = F.flatten(rings)
    heights = F.array_sort(F.array_distinct(F.transform(corners, lambda p: p["y"])))
    centre = (F.element_at(heights, 1) + F.element_at(heights, -1)) / 2
    n = F.greatest(F.size(heights) - 1, F.lit(0))
    lines = F.zip_with(F.slice(heights, 1, n), F.slice(heights, 2, n), lambda a, b: (a + b) / 2)
    every = F.flatten(F.transform(rings, sides))

    def widest(y: Column) -> Column:
        met = F.filter(every, lambda s: (s["p"]["y"] > y) != (s["q"]["y"] > y))
        xs = F.array_sort(F.transform(met, lambda s: s["p"]["x"] + (y - s["p"]["y"]) * (s["q"]["x"] - s["p"]["x"]) / (s["q"]["y"] - s["p"]["y"])))
        at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(xs) - 2, F.lit(0))), lambda k: (k % 2 == 0) & (k + 1 < F.size(xs)))
        stretches = F.transform(at, lambda k: F.struct((F.get(xs, k + 1) - F.get(xs, k)).alias("width"), ((F.get(xs, k) + F.get(xs, k + 1)) / 2).alias("x"), y.alias("y")))
        return F.array_max(stretches)

    found = F.filter(F.transform(lines, widest), lambda w: w.isNotNull() & (w["width"] > 0))
    nearest = F.array_min(F.transform(found, lambda w: F.struct(F.abs(w["y"] - centre).alias("off"), w["x"].alias("x"), w["y"].alias("y"))))
    return F.when(nearest.isNotNull(), F.struct(nearest["x"].alias("x"), nearest["y"].alias("y")))


def _touch(a: Column, b: Column) -> Column:
    """Whether two sides have a point in common."""

    def between(s: Column, p: Column) -> Column:
        return p["x"].between(F.least(s["p"]["x"], s["q"]["x"]), F.greatest(s["p"]["x"], s["q"]["x"])) & p["y"].between(F.least(s["p"]["y"], s["q"]["y"]), F.greatest(s["p"]["y"], s["q"]["y"]))

    d1, d2 = (F.signum(_left(a, b[k]["x"], b[k]["y"])) for k in "pq")
    d3, d4 = (F.signum(_left(b, a[k]["x"], a[k]["y"])) for k in "pq")
    on = ((d1 == 0) & between(a, b["p"])) | ((d2 == 0) & between(a, b["q"])) | ((d3 == 0) & between(b, a["p"])) | ((d4 == 0) & between(b, a["q"]))
    return ((d1 * d2 < 0) & (d3 * d4 < 0)) | on


def ring_crosses_itself(ring: Column) -> Column:
    """Whether sides of a closed ring meet other than neighbours in their corner.

    Sides are swept in the order of their least x: each is compared with those after it
    until one starts beyond its greatest x, so far-off sides are never compared.
    """
    plain = F.filter(sides(ring), lambda s: (s["p"]["x"] != s["q"]["x"]) | (s["p"]["y"] != s["q"]["y"]))
    numbered = F.transform(plain, lambda s, k: F.struct(F.least(s["p"]["x"], s["q"]["x"]).alias("low"), k.alias("k"), F.greatest(s["p"]["x"], s["q"]["x"]).alias("high"), s["p"].alias("p"), s["q"].alias("q")))
    swept = F.array_sort(numbered)

    def meets(all_: Column) -> Column:
        n = F.size(all_)

        def against(a: Column, place: Column) -> Column:
            reach = F.aggregate(F.slice(all_, place + 2, F.greatest(n - place - 1, F.lit(0))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, b: F.when(s["go"] & (b["low"] <= a["high"]), F.struct((s["n"] + 1).alias("n"), F.lit(True).alias("go"))).otherwise(F.struct(s["n"].alias("n"), F.lit(False).alias("go"))), lambda s: s["n"])
            near = F.slice(all_, place + 2, reach)

            def clash(b: Column) -> Column:
                apart = F.abs(a["k"] - b["k"])
                following = (apart == 1) | (apart == n - 1)
                first, second = F.when((b["k"] - a["k"] == 1) | (a["k"] - b["k"] == n - 1), a).otherwise(b), F.when((b["k"] - a["k"] == 1) | (a["k"] - b["k"] == n - 1), b).otherwise(a)
                # neighbours share a corner; they clash if the second runs back along the first
                back = (_left(first, second["q"]["x"], second["q"]["y"]) == 0) & ((second["q"]["x"] - second["p"]["x"]) * (first["q"]["x"] - first["p"]["x"]) + (second["q"]["y"] - second["p"]["y"]) * (first["q"]["y"] - first["p"]["y"]) < 0)
                return F.when(following, back).otherwise(_touch(a, b))

            return F.exists(near, clash)

        return F.exists(F.transform(all_, against), lambda m: m)

    return F.transform(F.array(swept), meets)[0]


def _finite(line: Column) -> Column:
    good = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.forall(line, lambda p: p.isNotNull() & good(p["x"]) & good(p["y"]))


def line_fault(line: Column) -> Column:
    """Why a line is not valid (one of ``REASONS``), or null: at least two different finite points."""
    same = F.forall(line, lambda p: (p["x"] == line[0]["x"]) & (p["y"] == line[0]["y"]))
    return F.when(line.isNull() | (F.size(line) == 0), "empty").when(~F.coalesce(_finite(line), F.lit(False)), "non_finite").when(same, "too_few_points")


def _ring_fault(ring: Column) -> Column:
    closed = (ring[0]["x"] == F.element_at(ring, -1)["x"]) & (ring[0]["y"] == F.element_at(ring, -1)["y"])
    return (
        F.when(ring.isNull() | (F.size(ring) == 0), "empty")
        .when(~F.coalesce(_finite(ring), F.lit(False)), "non_finite")
        .when(F.size(ring) < 4, "too_few_points")
        .when(~closed, "not_closed")
        .when(ring_crosses_itself(ring), "self_intersection")
        .when(twice_area(ring) == 0, "no_area")
    )


def polygon_fault(rings: Column) -> Column:
    """Why a polygon is not valid (one of ``REASONS``), or null.

    Rings are closed, have an area and do not meet themselves; holes lie in the shell
    without crossing it (touching corners are allowed) and not in one another.
    """
    faults = F.filter(F.transform(rings, _ring_fault), lambda f: f.isNotNull())
    holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))

    def proper(a: Column, b: Column) -> Column:
        d = [F.signum(_left(s, o[k]["x"], o[k]["y"])) for s, o in ((a, b), (b, a)) for k in "pq"]
        return (d[0] * d[1] < 0) & (d[2] * d[3] < 0)

    def crossed(one: Column, other: Column) -> Column:
        return F.exists(sides(one), lambda a: F.exists(sides(other), lambda b: proper(a, b)))

    shell = rings[0]
    outside = F.exists(holes, lambda h: F.exists(h, lambda p: ~covers(shell, p["x"], p["y"])) | crossed(h, shell))
    inner = F.transform(holes, lambda h, k: F.exists(F.slice(holes, k + 2, F.greatest(F.size(holes) - k - 1, F.lit(0))), lambda o: crossed(h, o) | F.exists(F.array(interior_point(F.array(h))), lambda p: covers(o, p["x"], p["y"])) | F.exists(F.array(interior_point(F.array(o))), lambda p: covers(h, p["x"], p["y"]))))
    return F.when(rings.isNull() | (F.size(rings) == 0), "empty").when(F.size(faults) > 0, F.get(faults, F.lit(0))).when(outside, "hole_outside_shell").when(F.exists(inner, lambda m: m), "holes_overlap")
