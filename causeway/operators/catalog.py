"""Catalog of tiles: splits, overlaps and leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.contracts import require_empty, require_unique
from causeway.functions.geometry import boxes_overlap

BOX = ("xmin", "ymin", "xmax", "ymax")


def membership(catalog: DataFrame, official: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, and keys on which both sides disagree.

    ``official(key, official_split)`` against ``catalog(key, split)``.
    """
    both = catalog.select(key, "split", F.lit(True).alias("in_catalog")).join(official.select(key, "official_split", F.lit(True).alias("in_official")), key, "full_outer")
    here, there = F.coalesce("in_catalog", F.lit(False)), F.coalesce("in_official", F.lit(False))
    status = F.when(~there, "catalog_only").when(~here, "official_only").when(F.col("split") != F.col("official_split"), "split_differs").otherwise("agrees")
    return both.select(key, status.alias("status"))


def set_mismatch(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` that are missing from, or extra in, ``found``."""
    missing = expected.select(key).subtract(found.select(key)).withColumn("status", F.lit("missing"))
    return missing.unionByName(found.select(key).subtract(expected.select(key)).withColumn("status", F.lit("extra")))


def _cells(boxes: DataFrame, cell: float) -> DataFrame:
    """A row per grid cell that a box touches."""
    span = lambda low, high: F.sequence(F.floor(F.col(low) / cell).cast("bigint"), F.floor(F.col(high) / cell).cast("bigint"))
    return boxes.withColumn("gx", F.explode(span("xmin", "xmax"))).withColumn("gy", F.explode(span("ymin", "ymax")))


def overlaps(boxes: DataFrame, key: str, *, cell: float, carry: list[str] | None = None) -> DataFrame:
    """Pairs of overlapping boxes, smaller key first, found through a grid.

    ``cell`` should be about the size of a box.  A pair is kept in one cell only:
    the one with the corner of the intersection, so that no pair repeats.
    """
    names = [key, *BOX, *(carry or [])]
    dealt = _cells(boxes.select(*names), cell)
    a = dealt.select("gx", "gy", *[F.col(n).alias(f"a_{n}") for n in names])
    b = dealt.select("gx", "gy", *[F.col(n).alias(f"b_{n}") for n in names])
    met = a.join(b, ["gx", "gy"]).filter(F.col(f"a_{key}") < F.col(f"b_{key}"))
    corner = (F.floor(F.greatest("a_xmin", "b_xmin") / cell) == F.col("gx")) & (F.floor(F.greatest("a_ymin", "b_ymin") / cell) == F.col("gy"))
    return met.filter(corner & boxes_overlap(tuple(F.col(f"a_{n}") for n in BOX), tuple(F.col(f"b_{n}") for n in BOX))).drop("gx", "gy")


def leaks(pairs: DataFrame, split: str = "split") -> DataFrame:
    """Overlapping pairs whose splits differ."""
    return pairs.filter(F.col(f"a_{split}") != F.col(f"b_{split}"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def split_overlap(df: DataFrame, key: str, split: str) -> DataFrame:
    """How many keys each pair of splits shares."""
    sides = df.select(key, split).distinct()
    a, b = sides.select(key, F.col(split).alias("a_split")), sides.select(key, F.col(split).alias("b_split"))
    return a.join(b, key).filter(F.col("a_split") < F.col("b_split")).groupBy("a_split", "b_split").agg(F.count("*").alias("shared"))


def with_metadata(chips: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """``chips`` with the columns of ``metadata``; a chip without its event, or an event listed twice, raises ``ContractError``."""
    require_unique(metadata, key)
    require_empty(chips.join(metadata, key, "left_anti"), f"no metadata for {key}")
    return chips.join(metadata, key)


def inventory_audit(inventory: DataFrame, found: DataFrame, needed: DataFrame, root: str) -> DataFrame:
    """State of each path that is listed or needed.

    ``inventory(path, size)`` against ``found(path, size)`` and ``needed(path)``;
    a path that leaves ``root`` is refused before anything else is asked of it.
    """
    sides = inventory.select("path", F.col("size").alias("listed")).join(found.select("path", F.col("size").alias("real")), "path", "left")
    both = sides.join(needed.select("path", F.lit(True).alias("asked")), "path", "full_outer")
    inside = F.col("path").startswith(root.rstrip("/") + "/") & ~F.array_contains(F.split("path", "/"), "..")
    state = (
        F.when(~inside, "outside_root")
        .when(F.col("listed").isNull(), "not_listed")
        .when(F.col("real").isNull(), "missing")
        .when(F.col("listed") != F.col("real"), "size_differs")
        .when(F.col("asked").isNull(), "not_needed")
        .otherwise("complete")
    )
    return both.select("path", state.alias("state"))


def key_audit(options: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Keys of both sides with how many rows ``listed`` has for each; a key on one side only shows as such."""
    counts = listed.groupBy(key).agg(F.count("*").alias("entries"))
    both = options.select(key, F.lit(True).alias("offered")).join(counts, key, "full_outer")
    return both.select(key, F.coalesce("offered", F.lit(False)).alias("offered"), F.coalesce("entries", F.lit(0)).cast("bigint").alias("entries"))
