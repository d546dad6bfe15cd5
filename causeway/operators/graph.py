"""Directed road graphs: construction, components, multi-source shortest paths, path walks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from causeway.functions import roads
from causeway.functions.geometry import distance
from causeway.operators import blocks, order
from causeway.operators.blocks import NoConvergence
from causeway.staging import stage

NEAR_ZERO_M = 0.01


def judged_ways(ways: DataFrame, defaults: dict[str, float] = roads.SPEEDS_KMH) -> DataFrame:
    """``ways(way_id, nodes, tags)`` with reject reason, direction, speed and structure."""
    tags = F.col("tags")
    return ways.withColumns(
        {
            "reject_reason": roads.reject_reason(tags, defaults),
            "way_direction": roads.direction(tags),
            "way_speed": roads.speed(tags, defaults),
            "bridge": roads.is_set(tags, "bridge"),
            "tunnel": roads.is_set(tags, "tunnel"),
            "layer": roads.layer(tags),
        }
    )


def steps(ways: DataFrame) -> DataFrame:
    """Consecutive node pairs of each way, with their place ``idx``."""
    pairs = F.arrays_zip(F.slice("nodes", 1, F.greatest(F.size("nodes") - 1, F.lit(0))).alias("a"), F.slice("nodes", 2, F.greatest(F.size("nodes") - 1, F.lit(0))).alias("b"))
    return ways.select("*", F.posexplode(pairs).alias("idx", "pair")).withColumns({"a": F.col("pair.a"), "b": F.col("pair.b")}).drop("pair", "nodes")


def _unseen(rows: DataFrame, name: str, **counts: Column) -> DataFrame:
    return rows


def _observed(seen: Observation, rows: DataFrame, counts: list[Column]) -> dict[str, int]:
    """What was observed; where the plan left the observed rows out, since others it joins are empty, they are counted."""
    try:
        return seen.get
    except Py4JJavaError as problem:
        if problem.java_exception.getClass().getName() != "java.lang.AssertionError":
            raise
        return rows.agg(*counts).first().asDict()


def counted_segments(ways: DataFrame, nodes: DataFrame, defaults: dict[str, float] = roads.SPEEDS_KMH) -> tuple[DataFrame, dict[str, int]]:
    """``segments`` as a staged table, and counts of what was taken and left out.

    The counts (``ways``, ``rejected_ways``, ``steps``, ``self_loops``, ``unplaced``,
    ``near_zero``, ``segments``) are observed in the pass that writes the table, so
    nothing is read a second time.  A stage that runs again after a lost executor may
    count rows twice; exact figures then come from ``rejections``.
    """
    seen: list[tuple[Observation, DataFrame, list[Column]]] = []

    def look(rows: DataFrame, name: str, **counts: Column) -> DataFrame:
        wanted = [c.cast("bigint").alias(n) for n, c in counts.items()]
        seen.append((Observation(f"{name}-{uuid.uuid4().hex}"), rows, wanted))
        return rows.observe(seen[-1][0], *wanted)

    out = stage(segments(ways, nodes, defaults, look=look), "segments")
    told = {n: int(v or 0) for observed in seen for n, v in _observed(*observed).items()}
    told = {n: told.get(n, 0) for n in ("ways", "rejected_ways", "steps", "self_loops", "placed", "near_zero")}
    told["unplaced"] = told["steps"] - told["self_loops"] - told["placed"]
    told["segments"] = told.pop("placed") - told["near_zero"]
    return out, told


def segments(ways: DataFrame, nodes: DataFrame, defaults: dict[str, float] = roads.SPEEDS_KMH, *, look: Callable[..., DataFrame] = _unseen) -> DataFrame:
    """Physical segments of accepted ways: ends, length, and travel attributes.

    ``nodes(node_id, x_m, y_m)`` are joined twice, with rows that hold no tags any more; self-loops and near-zero steps
    are left out.  ``look`` is given the rows before each filter, with what to count.
    If ways have ``marks``, an array with a struct for each node, the fields of a segment's first node come along.
    """
    judged = look(judged_ways(ways, defaults), "judged", ways=F.count("*"), rejected_ways=F.count_if(F.col("reject_reason").isNotNull()))
    stepped = look(steps(judged.filter(F.col("reject_reason").isNull())), "stepped", steps=F.count("*"), self_loops=F.count_if(F.col("a") == F.col("b")))
    marks = [F.get("marks", "idx")[f.name].alias(f.name) for f in ways.schema["marks"].dataType.elementType.fields] if "marks" in ways.columns else []
    own = [
        F.try_element_at("tags", F.lit("highway")).alias("highway"),
        F.col("way_direction.direction").alias("direction"),
        F.col("way_direction.source").alias("direction_source"),
        F.col("way_speed.kmh").alias("speed_kmh"),
        F.col("way_speed.source").alias("speed_source"),
        "bridge",
        "tunnel",
        "layer",
        *marks,
    ]
    kept = stepped.filter(F.col("a") != F.col("b")).select("way_id", F.col("idx").cast("bigint").alias("idx"), "a", "b", *own)
    na = nodes.select(F.col("node_id").alias("a"), F.col("x_m").alias("ax"), F.col("y_m").alias("ay"))
    nb = nodes.select(F.col("node_id").alias("b"), F.col("x_m").alias("bx"), F.col("y_m").alias("by_"))
    placed = kept.join(na, "a").join(nb, "b").withColumn("length_m", distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by_")))
    placed = look(placed, "placed", placed=F.count("*"), near_zero=F.count_if(F.col("length_m") < NEAR_ZERO_M))
    return placed.filter(F.col("length_m") >= NEAR_ZERO_M).select(
        F.concat(F.lit("osm:"), F.col("way_id"), F.lit(":"), F.col("idx")).alias("segment_id"),
        "way_id",
        "idx",
        "a",
        "b",
        "ax",
        "ay",
        "bx",
        "by_",
        "length_m",
        "highway",
        "direction",
        "direction_source",
        "speed_kmh",
        "speed_source",
        (F.col("length_m") / F.col("speed_kmh") * F.lit(3.6)).alias("cost_seconds"),
        "bridge",
        "tunnel",
        "layer",
        *kept.columns[12:],
    )


def directed(segs: DataFrame) -> DataFrame:
    """Edges of segments: two for two-way segments, else one."""
    ends = F.when(F.col("direction") == 1, F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("target")))).when(
        F.col("direction") == -1, F.array(F.struct(F.col("b").alias("source"), F.col("a").alias("target")))
    ).otherwise(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("target")), F.struct(F.col("b").alias("source"), F.col("a").alias("target"))))
    return segs.withColumn("way", F.explode(ends)).select(
        F.concat(F.col("segment_id"), F.lit(":"), F.col("way.source"), F.lit(">"), F.col("way.target")).alias("edge_id"),
        "way.source",
        "way.target",
        *[c for c in segs.columns if c not in ("a", "b", "ax", "ay", "bx", "by_", "direction")],
    )


def rejections(ways: DataFrame, defaults: dict[str, float] = roads.SPEEDS_KMH) -> DataFrame:
    """Ways that stay out, by reason."""
    return judged_ways(ways, defaults).filter(F.col("reject_reason").isNotNull()).groupBy("reject_reason").agg(F.count("*").alias("ways"))


def weak_components(edges: DataFrame, *, rounds: int = 200) -> DataFrame:
    """Least node of each weak component, as ``(node, component)``.

    The least label spreads along edges, then jumps to the label's own label.
    """
    ends = edges.select(F.col("source").alias("u"), F.col("target").alias("v"))
    both = stage(ends.union(ends.select("v", "u")).distinct(), "component-edges")
    labels = stage(both.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("component")), "components")
    for _ in range(rounds):
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("component").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("u")).select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        up = labels.select(F.col("node").alias("via"), F.col("component").alias("above"))
        jumped = stage(lower.join(up, F.col("component") == F.col("via")).select("node", "old", F.least("component", "above").alias("component")), "components")
        labels = jumped.select("node", "component")
        if jumped.filter("old <> component").isEmpty():
            return labels
    raise NoConvergence(f"weak components after {rounds} rounds")


def missing_nodes(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that a way names and ``nodes(node_id, ...)`` lacks, as ``(way_id, node)``."""
    named = ways.select("way_id", F.explode("nodes").alias("node"))
    return named.join(nodes.select(F.col("node_id").alias("node")), "node", "left_anti").select("way_id", "node")


def build(ways: DataFrame, nodes: DataFrame, defaults: dict[str, float] = roads.SPEEDS_KMH) -> DataFrame:
    """Directed edges as a staged table; a missing node, a position that is no number or an empty graph raises ``ValueError``."""
    ways = stage(ways, "ways", tidy=True)
    check_places(ways, nodes)
    edges = stage(directed(segments(ways, nodes, defaults)), "edges", tidy=True)
    if edges.isEmpty():
        raise ValueError("the graph has no edge")
    return edges


def check_places(ways: DataFrame, nodes: DataFrame) -> None:
    """Raise ``ValueError`` if a way names a missing node or a position is no number."""
    lost = missing_nodes(ways, nodes).first()
    if lost is not None:
        raise ValueError(f"way {lost['way_id']} names the missing node {lost['node']}")
    if not nodes.filter(~_finite("x_m") | ~_finite("y_m")).isEmpty():
        raise ValueError("a node has no finite position")


def _finite(name: str) -> Column:
    value = F.col(name)
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def _numbered(edges: DataFrame, facilities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Both with whole-number nodes, and a table ``(node, number)`` if they had others."""
    if isinstance(edges.schema["source"].dataType, IntegralType):
        return edges, facilities, None
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).union(facilities.select("node")).distinct()
    numbers = order.placed(nodes, F.col("node"), name="number")
    for end in ("source", "target"):
        edges = edges.join(numbers.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("number", end)
    return edges, facilities.join(numbers, "node").drop("node").withColumnRenamed("number", "node"), numbers


def shut_words(closed: DataFrame, names: list[str]) -> DataFrame:
    """``(segment_id, shut)`` of ``closed(scenario_key, segment_id)``: bit ``k % 63`` of word ``k // 63`` is set if key ``names[k]`` closes it."""
    keys = closed.sparkSession.createDataFrame(list(enumerate(names)), "key int, scenario_key string")
    bit = lambda w: F.when((F.col("key") / 63).cast("int") == w, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("key") % 63)).otherwise(F.lit(0).cast("bigint"))
    words = [F.bit_or(bit(w)) for w in range((len(names) + 62) // 63)]
    return closed.join(F.broadcast(keys), "scenario_key").groupBy("segment_id").agg(F.array(*words).alias("shut"))


def reach(edges: DataFrame, facilities: DataFrame, names: list[str], *, strict: bool = True, rounds: int = 5_000) -> tuple[DataFrame, DataFrame]:
    """One row per node with its costs by key, and the facilities that the rows name by rank.

    ``edges(source, target, cost_seconds, shut)``, ``shut`` as from ``shut_words`` over the same
    ``names``; ``facilities(facility_id, node)``.  Returns ``(node, costs, ranks)`` and ``(rank, facility_id)``;
    element ``k`` of both arrays belongs to ``names[k]`` and is NULL where no facility is reached.  Costs spread
    backwards from the facilities within blocks of nodes and between them; facilities follow along
    edges of cheapest paths, equal costs going to the least facility.
    """
    edges, facilities, numbers = _numbered(edges.select("source", "target", F.col("cost_seconds").cast("double").alias("cost"), "shut"), facilities.select("facility_id", "node"))
    sources = facilities.groupBy("node").agg(F.min("facility_id").alias("facility_id"))
    ranked = stage(order.placed(sources, F.col("facility_id").asc(), F.col("node").asc(), name="rank"), "path-sources")
    out = blocks.reach(edges.withColumns({c: F.col(c).cast("bigint") for c in ("source", "target")}), ranked.select(F.col("node").cast("bigint").alias("node"), "rank"), len(names), strict=strict, rounds=rounds)
    if numbers is not None:
        out = out.withColumnRenamed("node", "number").join(numbers, "number").select("node", "costs", "ranks")
    return out, ranked.select("rank", "facility_id")


def few(df: DataFrame, *, most: int = 1_000_000) -> DataFrame:
    """``df``, marked for broadcast if it is counted to have at most so many short rows."""
    return F.broadcast(df) if df.count() <= most else df


def by_key(reached: DataFrame, facilities: DataFrame, names: list[str]) -> DataFrame:
    """``reach`` as rows ``(scenario_key, node, cost_seconds, facility_id)``, without keys that reach nothing."""
    rows = reached.select("node", F.posexplode(F.arrays_zip("costs", "ranks")).alias("key", "found")).filter("found.costs IS NOT NULL")
    rows = rows.select(F.get(F.array(*[F.lit(n) for n in names]), F.col("key")).alias("scenario_key"), "node", F.col("found.costs").alias("cost_seconds"), F.col("found.ranks").alias("rank"))
    return rows.join(few(facilities), "rank", "left").select("scenario_key", "node", "cost_seconds", "facility_id")


def nearest_facility(
    edges: DataFrame, facilities: DataFrame, *, closed: DataFrame | None = None, scenarios: DataFrame | None = None, strict: bool = True, rounds: int = 5_000
) -> DataFrame:
    """Cheapest cost and nearest facility of every node that reaches one, for all scenarios at once.

    ``edges(edge_id, segment_id, source, target, cost_seconds)``;
    ``facilities(facility_id, node)``; ``closed(scenario_key, segment_id)`` lists
    removed segments; ``scenarios(scenario_key)`` the keys to solve (a small
    parameter table), one unnamed key by default.  ``reach`` does the work; equal costs go to the least facility.  With
    ``strict`` a facility outside the graph raises ``ValueError``; else it is left out.
    No facility at all raises, and so does a cost that is negative or no finite number.
    """
    names = sorted(r[0] for r in scenarios.select("scenario_key").distinct().collect()) if scenarios is not None else ["baseline"]
    free = F.array_repeat(F.lit(0).cast("bigint"), (len(names) + 62) // 63)
    if closed is not None:
        edges = edges.join(shut_words(closed, names), "segment_id", "left").withColumn("shut", F.coalesce("shut", free))
    else:
        edges = edges.withColumn("shut", free)
    return by_key(*reach(edges, facilities, names, strict=strict, rounds=rounds), names)


def next_edges(solved: DataFrame, edges: DataFrame, *, closed: DataFrame | None = None) -> DataFrame:
    """The edge that a node's cheapest path takes, the least ``edge_id`` on ties."""
    down = solved.select("scenario_key", F.col("node").alias("target"), F.col("cost_seconds").alias("rest"), F.col("facility_id").alias("there"))
    own = solved.join(edges.select("edge_id", "segment_id", F.col("source").alias("node"), "target", F.col("cost_seconds").alias("step")), "node").join(down, ["scenario_key", "target"])
    if closed is not None:
        own = own.join(closed, ["scenario_key", "segment_id"], "left_anti")
    own = own.filter((F.col("cost_seconds") == F.col("rest") + F.col("step")) & (F.col("there") == F.col("facility_id")))
    return own.groupBy("scenario_key", "node").agg(F.min(F.struct("edge_id", "target")).alias("e")).select("scenario_key", "node", "e.edge_id", "e.target")


def path_audit(starts: DataFrame, hops: DataFrame, nodes: DataFrame, *, rounds: int = 10_000) -> DataFrame:
    """Walk from ``starts(origin_id, node)`` along ``hops(node, target)`` to the end.

    Returns hops, and the least distance to the border of the nodes' box on the way.
    """
    box = nodes.agg(F.min("x_m").alias("x0"), F.max("x_m").alias("x1"), F.min("y_m").alias("y0"), F.max("y_m").alias("y1"))
    margin = nodes.crossJoin(F.broadcast(box)).select(
        F.col("node_id").alias("node"), F.least(F.col("x_m") - F.col("x0"), F.col("x1") - F.col("x_m"), F.col("y_m") - F.col("y0"), F.col("y1") - F.col("y_m")).alias("margin")
    )
    walk = stage(starts.join(margin, "node").select("origin_id", "node", F.lit(0).cast("bigint").alias("hops"), F.col("margin").alias("border_m"), F.lit(False).alias("ended")), "walk")
    for _ in range(rounds):
        moved = (
            walk.filter("not ended")
            .join(hops, "node", "left")
            .join(margin.withColumnRenamed("node", "target"), "target", "left")
            .select(
                "origin_id",
                F.coalesce("target", "node").alias("node"),
                F.when(F.col("target").isNull(), F.col("hops")).otherwise(F.col("hops") + 1).alias("hops"),
                F.least("border_m", "margin").alias("border_m"),
                F.col("target").isNull().alias("ended"),
            )
        )
        walk = stage(walk.filter("ended").unionByName(moved), "walk")
        if walk.filter("not ended").isEmpty():
            return walk.select("origin_id", F.col("node").alias("end_node"), "hops", "border_m")
    raise NoConvergence(f"path walk after {rounds} rounds: a cycle")


def cheapest(edges: DataFrame, origin: str, facility: str, policy: str = "baseline") -> float | None:
    """Cheapest cost between two nodes of ``edges(source, target, cost, state)`` under a policy; None when unreachable."""
    states = {"baseline": [], "exposed_only": ["exposed"], "conservative": ["exposed", "unknown"]}
    if policy not in states:
        raise ValueError(f"unknown policy {policy!r}")
    cost = F.col("cost").cast("double")
    named = (F.length(F.col("source")) > 0) & (F.length(F.col("target")) > 0)
    fine = named & cost.isNotNull() & ~F.isnan(cost) & (cost >= 0) & (cost < float("inf")) & F.col("state").isin("clear", "exposed", "unknown")
    if not edges.filter(~F.coalesce(fine, F.lit(False))).isEmpty():
        raise ValueError("an edge has no endpoint, a cost that is negative or no number, or an unknown state")
    known = edges.select(F.col("source").alias("n")).union(edges.select("target")).distinct().filter(F.col("n").isin(origin, facility)).count()
    if known < len({origin, facility}):
        raise ValueError("a node is not in the graph")
    if origin == facility:
        return 0.0
    usable = edges.filter(~F.col("state").isin(states[policy])) if states[policy] else edges
    named = usable.select(F.concat_ws(">", "source", "target").alias("edge_id"), F.concat_ws(">", "source", "target").alias("segment_id"), "source", "target", F.col("cost").cast("double").alias("cost_seconds"))
    end = edges.sparkSession.createDataFrame([(facility, facility)], "facility_id string, node string")
    row = nearest_facility(named, end).filter(F.col("node") == origin).first()
    return None if row is None else row["cost_seconds"]
