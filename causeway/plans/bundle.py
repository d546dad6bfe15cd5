"""A bundle of result tables and the keyed lookups over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.contracts import require_empty
from causeway.sources.layout import in_view, link_under, write_layout
from causeway.sources.writers import write_closures

TABLES = ("roads", "evidence", "summary", "about")


def build(path: str, *, segments: DataFrame, evidence: DataFrame, closed: DataFrame, summary: DataFrame, about: dict[str, str]) -> None:
    """Write a bundle after its reference checks: evidence and closures name known roads.

    Roads are written twice, as they come and along a curve for lookups by place.
    """
    require_empty(evidence.join(segments, "segment_id", "left_anti"), "evidence without road")
    require_empty(closed.join(segments, "segment_id", "left_anti"), "closure without road")
    spark = segments.sparkSession
    segments.write.parquet(f"{path}/roads")
    place_roads(segments, f"{path}/places")
    evidence.write.parquet(f"{path}/evidence")
    summary.write.parquet(f"{path}/summary")
    write_closures(closed.select("scenario_id", "policy", "bridge_rule", "segment_id", "reason"), f"{path}/closures")
    spark.createDataFrame(list(about.items()), "key string, value string").write.parquet(f"{path}/about")


def load(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{table}")


def road_states(roads: DataFrame, evidence: DataFrame) -> DataFrame:
    """Roads with their evidence and ``state``, whether the image saw them."""
    seen = evidence.withColumn("seen", F.lit(True)).drop("length_m")
    state = F.when(F.col("seen"), "within_image").otherwise("outside_image_unknown")
    return roads.join(seen, "segment_id", "left").withColumn("state", state).drop("seen")


def road(spark: SparkSession, path: str, segment_id: str) -> DataFrame:
    """One road with its evidence, and whether the image saw it; no row when unknown."""
    one = load(spark, path, "roads").filter(F.col("segment_id") == segment_id)
    return road_states(one, load(spark, path, "evidence").filter(F.col("segment_id") == segment_id))


def place_roads(segments: DataFrame, path: str, *, rows_per_file: int = 1_000_000) -> None:
    """Write segments along a curve by the boxes of their ends."""
    write_layout(segments, path, (F.least("ax", "bx"), F.least("ay", "by_"), F.greatest("ax", "bx"), F.greatest("ay", "by_")), rows_per_file=rows_per_file)


def roads_in_view(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Roads whose box meets a viewport; few files are opened."""
    return in_view(spark, f"{path}/places", box)


def road_under(spark: SparkSession, path: str, x: float, y: float, *, limit: float, x_scale: float = 1.0) -> DataFrame:
    """The road under a pointer with its distance; no row if none is within ``limit``."""
    return link_under(spark, f"{path}/places", x, y, limit=limit, x_scale=x_scale)


def scenario(spark: SparkSession, path: str, scenario_id: str, policy: str, bridge_rule: str) -> DataFrame:
    """Removed segments of one selection; only its folder is read."""
    own = (F.col("scenario_id") == scenario_id) & (F.col("policy") == policy) & (F.col("bridge_rule") == bridge_rule)
    return load(spark, path, "closures").filter(own).select("segment_id", "reason")


def options(spark: SparkSession, path: str, *, scenario_id: str | None = None, policy: str | None = None) -> DataFrame:
    """Selections that remain after the chosen filters."""
    rows = load(spark, path, "summary").select("scenario_id", "policy", "bridge_rule").distinct()
    for name, value in (("scenario_id", scenario_id), ("policy", policy)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    return rows


def document(names: list[str]) -> Column:
    """A JSON document of the named columns, NULL ones included."""
    return F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("document")


def export(spark: SparkSession, path: str, scenario_id: str, policy: str, bridge_rule: str) -> DataFrame:
    """One document with a selection and its counts."""
    chosen = {"scenario_id": scenario_id, "policy": policy, "bridge_rule": bridge_rule}
    counts = scenario(spark, path, scenario_id, policy, bridge_rule).agg(F.count("*").alias("closed"))
    return counts.withColumns({k: F.lit(v) for k, v in chosen.items()}).select(document([*chosen, "closed"]))
