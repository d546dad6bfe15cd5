"""Spatial joins by grid cells: snapping, crossings, samples of lines on pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.contracts import require
from causeway.functions.geometry import clip_to_box, crosses, distance, midpoints
from causeway.staging import stage


def _nearest(points: DataFrame, nodes: DataFrame, reach: float) -> DataFrame:
    """Points with ``b``, the nearest of ``nodes(x_m, y_m, node_id)`` within ``reach``, else NULL.

    Nodes are dealt to the nine cells around them, cells being as wide as the reach, so a point looks into one.
    """
    cell = lambda c: F.floor(F.col(c) / reach).cast("bigint")
    near = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    spread = nodes.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near)).select("node_id", F.col("x_m").alias("nx"), F.col("y_m").alias("ny"), (cell("x_m") + F.col("dx")).alias("gx"), (cell("y_m") + F.col("dy")).alias("gy"))
    placed = points.withColumns({"gx": cell("x_m"), "gy": cell("y_m")})
    d = distance(F.col("x_m"), F.col("y_m"), F.col("nx"), F.col("ny"))
    met = placed.join(spread, ["gx", "gy"], "left").withColumn("d", d)
    best = F.min(F.when(F.col("d") <= reach, F.struct("d", "node_id")))
    return met.groupBy("gx", "gy", "point_id", "x_m", "y_m").agg(best.alias("b")).select("point_id", "x_m", "y_m", "b")


def snap(points: DataFrame, nodes: DataFrame, *, limit_m: float, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Nearest node of each ``point(point_id, x_m, y_m)``, the least id on ties, and whether it counts.

    A point outside ``box`` or farther than ``limit_m`` from every node keeps its
    distance but no node.  Of nodes in one place the least id stands for all.  The first
    pass looks as far as a node is to be expected, at most ``limit_m``; points that found none look twice as far in the next
    pass, so a pass meets few nodes per point, however dense they are, and the reach is bounded by the box of both
    sides.  No node at all raises, and so does a position that is not a finite number,
    of a point or a node.
    """
    if limit_m <= 0 or nodes.isEmpty():
        raise ValueError("snapping needs a limit above zero and nodes")
    finite = (F.abs(F.col("x_m")) < float("inf")) & (F.abs(F.col("y_m")) < float("inf"))  # false for NaN, which is above all
    require(points, {"points have finite positions": finite})
    require(nodes, {"nodes have finite positions": finite})
    places = stage(nodes.groupBy("x_m", "y_m").agg(F.min("node_id").alias("node_id")), "snap-places", tidy=True)
    bounds = [f(c) for c in ("x_m", "y_m") for f in (F.min, F.max)]
    own = places.agg(*bounds, F.count("*")).first()
    ends = points.select("x_m", "y_m").union(places.select("x_m", "y_m")).agg(*bounds).first()
    widest = 2 * (abs(ends[1] - ends[0]) + abs(ends[3] - ends[2])) + limit_m
    area = (own[1] - own[0]) * (own[3] - own[2])
    reach = min(limit_m, max((area / own[4]) ** 0.5, limit_m / 1024)) if area > 0 else limit_m
    found, left = None, points.select("point_id", "x_m", "y_m")
    while True:
        here = stage(_nearest(left, places, reach), "snap-found", tidy=True)
        got = here.filter("b IS NOT NULL")
        found = got if found is None else found.unionByName(got)
        left = here.filter("b IS NULL").drop("b")
        if left.isEmpty():
            break
        if reach > widest:  # not reached: within the box of both sides each point has a node
            raise ValueError("points without a node in reach")
        reach *= 2
    x, y, d = F.col("x_m"), F.col("y_m"), F.col("b.d")
    low_x, low_y, high_x, high_y = (F.lit(float(v)) for v in box) if box else (x, y, x, y)
    inside = (x >= low_x) & (x <= high_x) & (y >= low_y) & (y <= high_y)
    state = F.when(~inside, "outside_study_bbox").when(d <= limit_m, "snapped").otherwise("beyond_snap_limit")
    margin = F.when(inside, F.least(x - low_x, high_x - x, y - low_y, high_y - y)).otherwise(0.0) if box else F.lit(None).cast("double")
    out = found.withColumn("status", state)
    return out.select("point_id", "status", F.when(F.col("status") == "snapped", F.col("b.node_id")).alias("nearest_node_id"), d.alias("nearest_distance_m"), margin.alias("boundary_distance_m"))


def within_radius(points: DataFrame, x: float, y: float, radius_m: float) -> DataFrame:
    """Points within a radius of a place."""
    return points.filter(distance(F.col("x_m"), F.col("y_m"), F.lit(x), F.lit(y)) <= radius_m)


def crossings(segments: DataFrame, *, cell: float) -> DataFrame:
    """Pairs of segments that properly cross without a shared node, and whether a grade separation is tagged.

    Each segment is dealt to the cells of its box; of the cells that a pair shares
    only the one with the corner of the boxes' intersection reports it.
    """
    names = ["segment_id", "a", "b", "ax", "ay", "bx", "by_", "bridge", "tunnel", "layer"]
    boxed = segments.select(*names, F.least("ax", "bx").alias("xmin"), F.greatest("ax", "bx").alias("xmax"), F.least("ay", "by_").alias("ymin"), F.greatest("ay", "by_").alias("ymax"))
    span = lambda low, high: F.sequence(F.floor(F.col(low) / cell).cast("bigint"), F.floor(F.col(high) / cell).cast("bigint"))
    dealt = boxed.withColumn("gx", F.explode(span("xmin", "xmax"))).withColumn("gy", F.explode(span("ymin", "ymax")))
    left = dealt.select("gx", "gy", *[F.col(c).alias(f"l_{c}") for c in boxed.columns])
    right = dealt.select("gx", "gy", *[F.col(c).alias(f"r_{c}") for c in boxed.columns])
    met = left.join(right, ["gx", "gy"]).filter(F.col("l_segment_id") < F.col("r_segment_id"))
    corner = (F.floor(F.greatest("l_xmin", "r_xmin") / cell) == F.col("gx")) & (F.floor(F.greatest("l_ymin", "r_ymin") / cell) == F.col("gy"))
    ends = lambda s: tuple(F.col(f"{s}_{c}") for c in ("ax", "ay", "bx", "by_"))
    apart = ~F.arrays_overlap(F.array("l_a", "l_b"), F.array("r_a", "r_b"))
    found = met.filter(corner & apart & crosses(ends("l"), ends("r")))
    tagged = F.col("l_bridge") | F.col("r_bridge") | F.col("l_tunnel") | F.col("r_tunnel") | ~F.col("l_layer").eqNullSafe(F.col("r_layer"))
    return found.select(F.col("l_segment_id").alias("left_id"), F.col("r_segment_id").alias("right_id"), tagged.alias("grade_tagged"))


def clipped(segments: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Part of each segment inside a box: ``t0``, ``t1`` and ``within_m``; segments outside are left out."""
    cut = clip_to_box(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by_"), tuple(F.lit(float(v)) for v in box))
    out = segments.withColumn("cut", cut).filter(F.col("cut").isNotNull())
    return out.withColumns({"t0": F.col("cut.t0"), "t1": F.col("cut.t1")}).withColumn("within_m", (F.col("t1") - F.col("t0")) * F.col("length_m")).drop("cut")


def clip_audit(segments: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Every segment with ``status`` kept, outside_box or no_length, and the metres inside the box."""
    cut = clip_to_box(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by_"), tuple(F.lit(float(v)) for v in box))
    within = F.when(cut.isNotNull(), (cut["t1"] - cut["t0"]) * F.col("length_m")).otherwise(0.0)
    status = F.when(~(F.col("length_m") > 0), "no_length").when(cut.isNull(), "outside_box").otherwise("kept")
    return segments.select("segment_id", status.alias("status"), within.alias("within_m"))


def nearest_link(segments: DataFrame, x: float, y: float, *, limit: float, x_scale: float = 1.0) -> DataFrame:
    """The segment under a pointer: least distance within ``limit``, the least id on ties; ``x_scale`` shrinks degrees of longitude."""
    dx, dy = (F.col("bx") - F.col("ax")) * x_scale, F.col("by_") - F.col("ay")
    px, py = (F.lit(float(x)) - F.col("ax")) * x_scale, F.lit(float(y)) - F.col("ay")
    along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(px * dx + py * dy, dx * dx + dy * dy), F.lit(0.0))))
    gap = distance(px, py, along * dx, along * dy)
    best = segments.select("segment_id", gap.alias("gap")).filter(F.col("gap") <= limit).agg(F.min(F.struct("gap", "segment_id")).alias("b"))
    return best.filter("b IS NOT NULL").select("b.segment_id", F.col("b.gap").alias("distance"))


def line_samples(parts: DataFrame, *, step_m: float, pixel_m: float) -> DataFrame:
    """Midpoint samples of clipped segments with their weight and the pixel they fall into."""
    sampled = parts.filter(F.col("within_m") > 0).withColumn("s", F.explode(midpoints(F.col("within_m"), step_m)))
    t = F.col("t0") + (F.col("t1") - F.col("t0")) * F.col("s.t")
    placed = sampled.select("segment_id", "length_m", "within_m", F.col("s.weight").alias("weight"), (F.col("ax") + t * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + t * (F.col("by_") - F.col("ay"))).alias("y"))
    return placed.withColumns({"px_row": F.floor(F.col("y") / pixel_m).cast("bigint"), "px_col": F.floor(F.col("x") / pixel_m).cast("bigint")})


def road_evidence(parts: DataFrame, pixels: DataFrame, *, step_m: float, pixel_m: float) -> DataFrame:
    """Length-weighted overlap of segments with ``pixels(px_row, px_col, eligible, p, flags, kept, wet)``."""
    met = line_samples(parts, step_m=step_m, pixel_m=pixel_m).join(pixels, ["px_row", "px_col"], "left")
    weight = lambda where: F.sum(F.when(where, F.col("weight")).otherwise(0.0))
    known = F.coalesce("eligible", F.lit(False))
    out = met.groupBy("segment_id").agg(
        F.first("length_m").alias("length_m"),
        F.first("within_m").alias("within_tile_m"),
        weight(known).alias("supported_m"),
        weight(known & F.col("kept")).alias("retained_m"),
        weight(known & (F.col("flags") != 0)).alias("flagged_m"),
        weight(known & F.col("wet")).alias("water_m"),
        F.sum(F.when(known, F.col("weight") * F.col("p"))).alias("weighted"),
    )
    return out.withColumns(
        {
            "unknown_m": F.greatest(F.lit(0.0), F.col("length_m") - F.col("supported_m")),
            "coverage": F.least(F.lit(1.0), F.col("supported_m") / F.col("length_m")),
            "mean_score": F.try_divide(F.col("weighted"), F.nullif("supported_m", F.lit(0.0))),
        }
    ).drop("weighted")


def resample(source: DataFrame, targets: DataFrame, *, value: str) -> DataFrame:
    """Bilinear value at each ``target(target_id, x, y)`` of a unit grid ``source(px_row, px_col, value)``.

    NULL unless all four neighbours with weight are there.
    """
    grid = source.select(F.col("px_row").alias("r"), F.col("px_col").alias("c"), F.col(value).alias("v"))
    corners = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr in (0, 1) for dc in (0, 1)])
    spread = targets.withColumn("k", F.explode(corners)).withColumns({"r": F.floor("y").cast("bigint") + F.col("k.dr"), "c": F.floor("x").cast("bigint") + F.col("k.dc")})
    fy, fx = F.col("y") - F.floor("y"), F.col("x") - F.floor("x")
    weighted = spread.withColumn("w", F.when(F.col("k.dr") == 1, fy).otherwise(1 - fy) * F.when(F.col("k.dc") == 1, fx).otherwise(1 - fx)).filter("w > 0")
    met = weighted.join(grid, ["r", "c"], "left")
    return met.groupBy("target_id").agg(F.when(F.count("*") == F.count("v"), F.sum(F.col("w") * F.col("v"))).alias(value))


__all__ = ["clipped", "crossings", "line_samples", "resample", "road_evidence", "snap", "stage", "within_radius"]
