"""Road tags: direction, speed, access and structure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the road contract.
SPEEDS_KMH = {
    "motorway": 100.0,
    "trunk": 80.0,
    "primary": 70.0,
    "secondary": 60.0,
    "tertiary": 50.0,
    "motorway_link": 40.0,
    "trunk_link": 40.0,
    "primary_link": 35.0,
    "secondary_link": 30.0,
    "tertiary_link": 25.0,
    "unclassified": 40.0,
    "residential": 30.0,
    "living_street": 15.0,
    "service": 20.0,
}
ACCESS_KEYS = ("access", "vehicle", "motor_vehicle", "motorcar")
RESTRICTED = ("no", "private", "agricultural", "forestry")
MPH_KMH = 1.609344


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def direction(tags: Column) -> Column:
    """Struct of ``direction`` (1, -1, 0 for both, NULL unsupported) and its ``source``."""
    oneway = tag(tags, "oneway")
    one_way_class = (tag(tags, "junction") == "roundabout") | tag(tags, "highway").isin("motorway", "motorway_link")
    way = (
        F.when(oneway.isin("yes", "1", "true"), 1)
        .when(oneway.isin("-1", "reverse"), -1)
        .when(oneway.isin("no", "0", "false"), 0)
        .when(oneway.isNotNull(), None)
        .when(F.coalesce(one_way_class, F.lit(False)), 1)
        .otherwise(0)
    )
    source = (
        F.when(oneway.isin("yes", "1", "true"), "explicit_forward")
        .when(oneway.isin("-1", "reverse"), "explicit_reverse")
        .when(oneway.isin("no", "0", "false"), "explicit_two_way")
        .when(oneway.isNotNull(), F.concat(F.lit("unsupported_oneway:"), oneway))
        .when(F.coalesce(one_way_class, F.lit(False)), "inferred_one_way")
        .otherwise("assumed_two_way_unmarked")
    )
    return F.struct(way.cast("int").alias("direction"), source.alias("source"))


def _table(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def speed(tags: Column, defaults: dict[str, float] = SPEEDS_KMH) -> Column:
    """Struct of ``kmh`` and ``source``: a plain speed limit within 5 to 140, else the class."""
    pattern = r"^\s*(\d+(?:\.\d+)?)\s*(mph|km/h|kph)?\s*$"
    raw = F.lower(F.coalesce(tag(tags, "maxspeed"), F.lit("")))
    stated = F.regexp_extract(raw, pattern, 1)
    value = F.when(stated != "", stated.cast("double") * F.when(F.regexp_extract(raw, pattern, 2) == "mph", F.lit(MPH_KMH)).otherwise(F.lit(1.0)))
    fits = F.coalesce(value.between(5, 140), F.lit(False))
    default = F.try_element_at(_table(defaults), tag(tags, "highway"))
    return F.struct(F.when(fits, value).otherwise(default).alias("kmh"), F.when(fits, "explicit_maxspeed").otherwise("class_assumption").alias("source"))


def reject_reason(tags: Column, defaults: dict[str, float] = SPEEDS_KMH) -> Column:
    """Why a way stays out of the graph; the first reason counts, NULL keeps it."""
    known = F.coalesce(tag(tags, "highway").isin(*defaults), F.lit(False))
    closed = F.coalesce(tag(tags, "area") == "yes", F.lit(False))
    for key in ACCESS_KEYS:
        closed = closed | F.coalesce(tag(tags, key).isin(*RESTRICTED), F.lit(False))
    return (
        F.when(~known, "class_outside_contract")
        .when(closed, "motor_access_restricted_or_area")
        .when(direction(tags)["direction"].isNull(), "unsupported_direction")
    )


def is_set(tags: Column, key: str) -> Column:
    """Truth of a structure tag such as bridge or tunnel."""
    return F.coalesce(~tag(tags, key).isin("no", "0", "false"), F.lit(False))


def layer(tags: Column) -> Column:
    """Integer layer, 0 when untagged, NULL when not an integer."""
    raw = F.coalesce(tag(tags, "layer"), F.lit("0"))
    return F.when(raw.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(raw).try_cast("int"))
