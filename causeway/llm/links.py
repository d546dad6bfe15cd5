"""Joins and connected components that keep hot keys apart.

A key may hold a third of all rows.  ``salted`` deals such a key over several
tasks; ``components`` sends labels to all tasks while they are few, and beyond
that deals the edges of a hub by the other end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.staging import stage

#: Copies of the small side of a salted join.
SALTS = 16
#: Rows of (vertex, label) that are broadcast, 16 bytes each.
FEW = 200_000
#: Edges of a vertex, or vertices of a label, above which it is dealt over tasks.
HUB = 100_000


def salted(rows: DataFrame, few: DataFrame, on: list[str], spread: str, how: str = "left") -> DataFrame:
    """Join ``few``, unique by ``on``, to ``rows``; a hot key of ``rows`` is dealt by ``spread`` over ``SALTS`` tasks."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    few = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(few, [*on, "salt"], how).drop("salt")


def is_few(table: DataFrame, most: int = FEW) -> bool:
    return table.limit(most + 1).count() <= most


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Least vertex of each connected component of ``edges(a, b)``, as ``(v, label)``.

    Vertices are integers.  Labels spread along edges and then jump to the label
    of the label; every round is a staged table.  Self-loops and repeated edges do
    no harm, a null end makes no edge, no edges give an empty table.
    """
    edges = edges.filter("a is not null and b is not null")
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{label}-edges")
    labels = stage(both.groupBy(F.col("a").alias("v")).agg(F.min(F.least("a", "b")).alias("label")), f"{label}-labels")
    few = is_few(labels)
    if not few:  # edges of hubs are dealt by their other end
        hubs = both.groupBy(F.col("b").alias("v")).agg(F.count("*").alias("n")).filter(F.col("n") > HUB)
        hubs = stage(hubs.select("v", F.ceil(F.col("n") / HUB).cast("int").alias("spread")), f"{label}-hubs")
        hubs = F.broadcast(hubs) if is_few(hubs) else hubs
        both = both.join(hubs.withColumnRenamed("v", "b"), "b", "left").withColumn("part", F.pmod(F.xxhash64("a"), F.coalesce("spread", F.lit(1)))).select("a", "b", "part")
        both = stage(both, f"{label}-dealt")
    while True:
        if few:
            sent = F.broadcast(labels)
            near = both.join(sent, F.col("b") == F.col("v")).groupBy("a").agg(F.min("label").alias("near"))
            up = F.broadcast(labels.select(F.col("v").alias("label"), F.col("label").alias("above")))
            lower = labels.join(near, F.col("v") == F.col("a")).select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
            jumped = lower.join(up, "label")
        else:
            told = labels.join(hubs, "v", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("spread", F.lit(1)).cast("long") - 1))).select(F.col("v").alias("b"), "part", "label")
            near = both.join(told, ["b", "part"]).groupBy("a").agg(F.min("label").alias("near"))
            lower = labels.join(near, F.col("v") == F.col("a")).select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
            jumped = salted(lower, labels.select(F.col("v").alias("label"), F.col("label").alias("above")), ["label"], "v", "inner")
        jumped = stage(jumped.select("v", "old", F.least("label", "above").alias("label")), f"{label}-labels")
        labels = jumped.select("v", "label")
        if jumped.filter("old <> label").isEmpty():
            return labels
