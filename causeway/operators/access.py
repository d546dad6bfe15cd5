"""Evidence on road segments, closures under policies, and paired access results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.contracts import total_join
from causeway.operators import dominance

POLICIES = ("supported_overlap", "retained_overlap", "supported_plus_within_tile_unknown", "supported_plus_all_unknown")
BRIDGE_RULES = ("bridge_exempt", "bridge_candidate")
LEAST_WATER_M = 15.0


def policy_grid(spark, scenarios: list[str]) -> DataFrame:
    """All scenarios under all policies and bridge rules, with a key."""
    rows = [(f"{s}|{p}|{b}", s, p, b) for s in scenarios for p in POLICIES for b in BRIDGE_RULES]
    return spark.createDataFrame(rows, "scenario_key string, scenario_id string, policy string, bridge_rule string")


def case_grid(scenarios: DataFrame, primary: str) -> DataFrame:
    """Keys of the case study from ``scenarios(scenario_id)``: two overlap policies for each, all policies for the primary one."""
    spark = scenarios.sparkSession
    policies = spark.createDataFrame([(p, p in POLICIES[:2]) for p in POLICIES], "policy string, always boolean")
    rules = spark.createDataFrame([(b,) for b in BRIDGE_RULES], "bridge_rule string")
    rows = scenarios.select("scenario_id").distinct().crossJoin(F.broadcast(policies)).crossJoin(F.broadcast(rules)).filter(F.col("always") | (F.col("scenario_id") == primary))
    return rows.select(F.concat_ws("|", "scenario_id", "policy", "bridge_rule").alias("scenario_key"), "scenario_id", "policy", "bridge_rule")


def closures(segments: DataFrame, evidence: DataFrame, water: DataFrame, grid: DataFrame, *, least_m: float = LEAST_WATER_M) -> DataFrame:
    """Segments that each key of ``grid`` removes, with the first reason that applies.

    ``segments(segment_id, length_m, bridge, tunnel)``;
    ``evidence(segment_id, within_tile_m, retained_m)``, no row meaning unknown;
    ``water(segment_id, scenario_id, supported_water_m, retained_water_m)``.
    """
    return judged(known(segments, evidence, water), grid, least_m=least_m)


def known(segments: DataFrame, evidence: DataFrame, water: DataFrame) -> DataFrame:
    """Segments with ``seen``, ``within_tile_m``, ``retained_m`` and ``water``, a map from scenario to metres of water; one row each."""
    own = evidence.select("segment_id", "within_tile_m", "retained_m", F.lit(True).alias("seen"))
    wet = F.struct("scenario_id", F.struct(F.col("supported_water_m").alias("supported_m"), F.col("retained_water_m").alias("retained_m")).alias("m"))
    held = water.groupBy("segment_id").agg(F.map_from_entries(F.collect_list(wet)).alias("water"))
    return segments.join(own, "segment_id", "left").join(held, "segment_id", "left")


def _reason(retained: Column, tile: Column, anything: Column, bridges: Column, observed: Column, least_m: float) -> Column:
    """First reason that removes a row of ``known``, by what its policy looks at."""
    seen = F.coalesce("seen", F.lit(False))
    able = ~F.col("tunnel") & (~F.col("bridge") | bridges)
    within = tile & seen & (F.col("within_tile_m") > 0) & (F.col("retained_m") < F.col("within_tile_m") - 1e-6)
    anywhere = anything & (~seen | (F.col("retained_m") < F.col("length_m") - 1e-6))
    return (
        F.when((F.coalesce(observed, F.lit(0.0)) >= least_m) & able, F.when(retained, "retained_overlap").otherwise("supported_overlap"))
        .when(F.coalesce(within, F.lit(False)), "within_tile_unknown")
        .when(F.coalesce(anywhere, F.lit(False)), "outside_or_partial_unknown")
    )


def judged(known: DataFrame, grid: DataFrame, *, least_m: float = LEAST_WATER_M) -> DataFrame:
    """``closures`` of rows as from ``known``; each key looks at each row, and nothing is dealt anew."""
    policy, wet = F.col("policy"), F.try_element_at("water", F.col("scenario_id"))
    observed = F.when(policy == "retained_overlap", wet["retained_m"]).otherwise(wet["supported_m"])
    reason = _reason(policy == "retained_overlap", policy == "supported_plus_within_tile_unknown", policy == "supported_plus_all_unknown", F.col("bridge_rule") == "bridge_candidate", observed, least_m)
    crossed = known.crossJoin(F.broadcast(grid)).withColumn("reason", reason)
    return crossed.filter(F.col("reason").isNotNull()).select("scenario_key", "scenario_id", "policy", "bridge_rule", "segment_id", "reason")


def shut_words(known: DataFrame, grid: DataFrame, names: list[str], *, least_m: float = LEAST_WATER_M) -> DataFrame:
    """``known`` with ``shut``: bit ``k % 63`` of word ``k // 63`` is set if key ``names[k]`` of the small table ``grid`` removes the row."""
    place = {name: k for k, name in enumerate(names)}
    bits: dict[tuple, list[int]] = {}  # what removes a row, by what it looks at, and the keys that it holds for
    for r in grid.collect():
        k = place[r["scenario_key"]]
        bits.setdefault(("wet", r["scenario_id"], r["policy"] == "retained_overlap", r["bridge_rule"] == "bridge_candidate"), []).append(k)
        if r["policy"].startswith("supported_plus"):
            bits.setdefault((r["policy"],), []).append(k)
    words = []
    for start in range(0, len(names), 63):
        word = F.lit(0).cast("bigint")
        for what, keys in bits.items():
            own = sum(1 << (k - start) for k in keys if start <= k < start + 63)
            if own:
                if what[0] == "wet":
                    water = F.col("water")[what[1]]
                    reason = _reason(F.lit(what[2]), F.lit(False), F.lit(False), F.lit(what[3]), water["retained_m" if what[2] else "supported_m"], least_m)
                else:
                    reason = _reason(F.lit(False), F.lit(what[0] == "supported_plus_within_tile_unknown"), F.lit(what[0] == "supported_plus_all_unknown"), F.lit(False), F.lit(None).cast("double"), least_m)
                word = word.bitwiseOR(F.when(reason.isNotNull(), F.lit(own).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        words.append(word)
    return known.withColumn("shut", F.array(*words))


def access_rows(origins: DataFrame, keys: DataFrame, baseline: DataFrame, solved: DataFrame) -> DataFrame:
    """Cost of each origin under each key beside its baseline; unreachable is NULL, never zero.

    ``origins(origin_id, node)``; ``baseline`` and ``solved`` as from the shortest-path operator.
    """
    base = baseline.select("node", F.col("cost_seconds").alias("baseline_cost_seconds"))
    cost = solved.select("scenario_key", "node", F.col("cost_seconds").alias("estimated_cost_seconds"), F.col("facility_id").alias("nearest_facility_id"))
    return _compared(origins.crossJoin(F.broadcast(keys.select("scenario_key"))).join(base, "node", "left").join(cost, ["scenario_key", "node"], "left"))


def access_rows_of_nodes(origins: DataFrame, names: list[str], reached: DataFrame, facilities: DataFrame, *, baseline: str = "baseline") -> DataFrame:
    """``access_rows`` from one row per node, as ``graph.reach`` over ``names`` gives them; only origins meet nodes, keys are spread afterwards."""
    met = origins.select("origin_id", "node").join(reached, "node", "left")
    spread = met.withColumn("key", F.explode(F.array(*[F.lit(k) for k, n in enumerate(names) if n != baseline])))
    rows = spread.select(
        F.get(F.array(*[F.lit(n) for n in names]), F.col("key")).alias("scenario_key"),
        "origin_id",
        F.get("costs", F.lit(names.index(baseline))).alias("baseline_cost_seconds"),
        F.get("costs", F.col("key")).alias("estimated_cost_seconds"),
        F.get("ranks", F.col("key")).alias("rank"),
    )
    return _compared(rows.join(facilities.withColumnRenamed("facility_id", "nearest_facility_id"), "rank", "left"))


def _compared(rows: DataFrame) -> DataFrame:
    return rows.select(
        "scenario_key",
        "origin_id",
        "nearest_facility_id",
        "estimated_cost_seconds",
        "baseline_cost_seconds",
        (F.col("estimated_cost_seconds") - F.col("baseline_cost_seconds")).alias("cost_delta_seconds"),
        F.col("baseline_cost_seconds").isNull().alias("baseline_unreachable"),
        (F.col("baseline_cost_seconds").isNotNull() & F.col("estimated_cost_seconds").isNull()).alias("newly_disconnected"),
        F.when(F.col("estimated_cost_seconds").isNull(), "no_graph_path").alias("reason"),
    )


def summarise(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of origins and the mean and greatest paired increase.

    Closing roads cannot make a path cheaper: an increase below -1e-7 s raises, so
    ``improved`` is 0 wherever there is a result.
    """
    delta = F.col("cost_delta_seconds")
    improved = F.count_if(delta < -1e-7)
    checked = lambda value: F.when(improved > 0, F.raise_error(F.concat(improved.cast("string"), F.lit(" origins have a negative increase")))).otherwise(value)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("origins"),
        F.count_if("baseline_unreachable").alias("baseline_unreachable"),
        F.count_if("newly_disconnected").alias("newly_disconnected"),
        F.count(delta).alias("paired_reachable"),
        checked(F.avg(delta)).alias("mean_increase_seconds"),
        checked(F.max(delta)).alias("greatest_increase_seconds"),
        checked(improved).alias("improved"),
    )


def ranking_reversals(rows: DataFrame, *, relative: float = 1e-9) -> DataFrame:
    """Pairs of origins whose order by cost differs between baseline and scenario; near ties do not count.  Pairs are counted, not listed."""
    known = rows.filter(F.col("cost_delta_seconds").isNotNull())
    found = dominance.pair_orders(known.select("scenario_key", F.col("baseline_cost_seconds").alias("a"), F.col("estimated_cost_seconds").alias("c")), relative=relative)
    out = found.select("scenario_key", (F.col("same") + F.col("opposite")).alias("comparable_pairs"), F.col("opposite").alias("reversed_pairs")).filter("comparable_pairs > 0")
    return out.withColumn("reversal_fraction", F.try_divide(F.col("reversed_pairs").cast("double"), F.col("comparable_pairs").cast("double")))


def stability(rows: DataFrame) -> DataFrame:
    """Per origin over all keys: members, reachable members, cost range, disconnections."""
    return rows.groupBy("origin_id").agg(
        F.count("*").alias("members"),
        F.count("estimated_cost_seconds").alias("reachable_members"),
        F.min("estimated_cost_seconds").alias("least_cost_seconds"),
        F.max("estimated_cost_seconds").alias("greatest_cost_seconds"),
        F.count_if("newly_disconnected").alias("newly_disconnected"),
    )


def first_disconnected(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Least origin that each key newly disconnects, NULL where it disconnects none."""
    return rows.groupBy(*keys).agg(F.min(F.when(F.col("newly_disconnected"), F.col("origin_id"))).alias("origin_id"))


def origin_overview(origins: DataFrame, nodes: DataFrame, baseline: DataFrame, stability: DataFrame) -> DataFrame:
    """One row per origin: place, baseline cost and its range over all keys.

    ``origins(origin_id, node)``; ``nodes(node_id, x_m, y_m)``;
    ``baseline(node, cost_seconds)`` lacks nodes that reach nothing, which is NULL;
    ``stability`` as from ``stability``.  An origin without a node or without
    stability raises, and so do repeated ones.
    """
    placed = total_join(origins, nodes.select(F.col("node_id").alias("node"), "x_m", "y_m"), ["node"], "node of an origin")
    ranged = total_join(placed, stability, ["origin_id"], "stability of an origin")
    cost = baseline.select("node", F.col("cost_seconds").alias("baseline_cost_seconds"))
    return ranged.join(cost, "node", "left")


def length_contract(evidence: DataFrame, *, tolerance: float = 1e-5) -> DataFrame:
    """Segments whose evidence lengths do not nest: water, retained <= supported <= within <= length."""
    broken = (
        (F.col("within_tile_m") > F.col("length_m") + tolerance)
        | (F.col("supported_m") > F.col("within_tile_m") + tolerance)
        | (F.col("retained_m") > F.col("supported_m") + tolerance)
        | (F.col("water_m") > F.col("supported_m") + tolerance)
    )
    return evidence.filter(broken)


def inspection(segments: DataFrame, evidence: DataFrame, water: DataFrame, scenario: str, *, least_m: float = LEAST_WATER_M) -> DataFrame:
    """Segments worth a look, in one row: most exposed, first exposed bridge, first without evidence; NULL if there is none."""
    exposed = water.filter((F.col("scenario_id") == scenario) & (F.col("supported_water_m") >= least_m)).select("segment_id", "supported_water_m")
    rows = segments.select("segment_id", "bridge").join(exposed, "segment_id", "left").join(evidence.select("segment_id", F.lit(True).alias("seen")), "segment_id", "left")
    wet = F.col("supported_water_m").isNotNull()
    return rows.agg(
        F.min(F.when(wet, F.struct((-F.col("supported_water_m")).alias("rank"), "segment_id")))["segment_id"].alias("exposed_link"),
        F.min(F.when(wet & F.col("bridge"), F.col("segment_id"))).alias("bridge_overlap"),
        F.min(F.when(F.col("seen").isNull(), F.col("segment_id"))).alias("outside_footprint_link"),
    )


def boundary_summary(paths: DataFrame, *, guard_m: float) -> DataFrame:
    """Of ``paths(origin_id, border_m)``: how many come near the border or leave it, and the least distance."""
    return paths.agg(
        F.count("*").alias("paths"),
        F.count_if(F.col("border_m") <= guard_m).alias("within_guard"),
        F.count_if(F.col("border_m") < 0).alias("leaving"),
        F.min("border_m").alias("least_border_m"),
    )
