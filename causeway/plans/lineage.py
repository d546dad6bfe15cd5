"""Identity and integrity of runs: digests, run ids, verification and the milestone ladder."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LADDER = (
    "scaffold",
    "m1_pilot",
    "m2_pilot",
    "m3_development",
    "m4_development",
    "m5_evidence",
    "m6_accessibility_scenarios",
    "m7_analyst_application",
    "m8_final_research",
)


def run_id(prefix: str, fingerprint: dict) -> str:
    """Prefix and the first twelve digits of the digest of a canonical document."""
    text = json.dumps(fingerprint, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return f"{prefix}-{hashlib.sha256(text.encode()).hexdigest()[:12]}"


def table_digest(df: DataFrame) -> DataFrame:
    """Digest of a table's content that does not depend on row order or files: rows and two hash sums."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    part = lambda k: F.sum(F.conv(F.substring(F.sha2(row, 256), k, 12), 16, 10).cast("decimal(20,0)"))
    return df.agg(F.count("*").alias("rows"), part(1).cast("decimal(38,0)").alias("digest_a"), part(13).cast("decimal(38,0)").alias("digest_b"))


def verify_outputs(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Files of a run that are missing, extra or changed.

    ``manifest(path, sha256)`` against ``found(path, sha256)``.
    """
    both = manifest.select("path", F.col("sha256").alias("declared")).join(found.select("path", F.col("sha256").alias("actual")), "path", "full_outer")
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("declared").isNull(), "extra").when(F.col("actual") != F.col("declared"), "changed")
    return both.withColumn("status", status).filter("status IS NOT NULL").select("path", "status")


def latest_valid(runs: DataFrame) -> DataFrame:
    """Latest completed run of each milestone whose recomputed hash agrees.

    ``runs(milestone, run_id, status, completed_at, manifest_sha256, computed_sha256)``.
    """
    good = runs.filter((F.col("status") == "complete") & (F.col("manifest_sha256") == F.col("computed_sha256")))
    return good.groupBy("milestone").agg(F.max_by("run_id", F.struct("completed_at", "run_id")).alias("run_id"))


def latest_complete(runs: DataFrame, valid: Column) -> DataFrame:
    """Latest completed run of each milestone, and whether it is valid; a condition that is NULL is not met."""
    last = runs.filter("status = 'complete'").withColumn("valid", F.coalesce(valid, F.lit(False)))
    return last.groupBy("milestone").agg(F.max(F.struct("completed_at", "run_id", "valid")).alias("r")).select("milestone", "r.run_id", "r.valid")


def ladder(valid: DataFrame) -> str:
    """The highest milestone up to which every one has a valid run."""
    held = {r["milestone"] for r in valid.select("milestone").distinct().limit(len(LADDER) + 1).collect()}
    reached = LADDER[0]
    for name in LADDER[1:]:
        if name not in held:
            break
        reached = name
    return reached


def pending(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Experiments of a grid that have no finished result yet."""
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")
