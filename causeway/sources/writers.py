"""Writers: partitioned tables, JSON lines and run manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MANIFEST = "run_id string, status string, completed_at timestamp, fingerprint string, outputs map<string, string>"


def write_pixels(pixels: DataFrame, path: str) -> None:
    """Canonical pixels, a folder per event, so that an event is read alone."""
    pixels.repartition("event_id", F.pmod(F.xxhash64("tile_id"), F.lit(16))).write.partitionBy("event_id").parquet(path)


def write_experiment(rows: DataFrame, path: str) -> None:
    """Results in folders by budget, seed and method."""
    rows.write.partitionBy("budget", "seed", "method").mode("append").parquet(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.option("compression", "gzip").json(path)


def write_closures(closures: DataFrame, path: str) -> None:
    """Removed segments in folders by scenario, policy and bridge rule."""
    closures.write.partitionBy("scenario_id", "policy", "bridge_rule").parquet(path)


def to_feature(features: DataFrame) -> DataFrame:
    """GeoJSON text of each ``feature(id, geometry, properties)``, the geometry being JSON text."""
    name = F.to_json(F.struct("id"))
    return features.select(
        F.concat(F.lit('{"type":"Feature",'), F.substring_index(F.substr(name, F.lit(2)), "}", 1), F.lit(',"geometry":'), "geometry", F.lit(',"properties":'), F.to_json("properties"), F.lit("}")).alias("feature")
    )


def append_manifest(manifest: DataFrame, path: str) -> None:
    """Append runs to the manifest table; ``manifest`` has the columns of ``MANIFEST``."""
    manifest.write.mode("append").parquet(path)
