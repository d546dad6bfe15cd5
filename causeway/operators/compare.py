"""Replay and tolerance comparisons of tables, and set checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replay_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, copies counted, with the side they are on."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def tolerance_diff(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], *, tolerance: float = 1e-10) -> DataFrame:
    """Keys whose values differ by more than ``tolerance``, or that are on one side; NULL equals NULL."""
    a = left.select(*keys, *[F.col(v).alias(f"a_{v}") for v in values], F.lit(True).alias("in_a"))
    b = right.select(*keys, *[F.col(v).alias(f"b_{v}") for v in values], F.lit(True).alias("in_b"))
    both = a.join(b, keys, "full_outer")
    bad = F.col("in_a").isNull() | F.col("in_b").isNull()
    for v in values:
        x, y = F.col(f"a_{v}"), F.col(f"b_{v}")
        bad = bad | (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > tolerance, F.lit(False))
    return both.filter(bad).select(*keys)


def set_relation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes of two sets, of their intersection and differences, and whether the first is a subset."""
    a, b = a.distinct(), b.distinct()
    name = a.columns[0]
    both = a.withColumn("in_a", F.lit(True)).join(b.toDF(name).withColumn("in_b", F.lit(True)), name, "full_outer")
    here, there = F.col("in_a").isNotNull(), F.col("in_b").isNotNull()
    return both.agg(F.count_if(here & there).alias("shared"), F.count_if(here & ~there).alias("only_first"), F.count_if(there & ~here).alias("only_second")).withColumn(
        "is_subset", F.col("only_first") == 0
    )
