"""A log of runs with commits that cannot both win, and gates over what runs rest on.

Each run has a folder with one file for each entry: its plan, that it is running, and
that it is complete or failed.  An entry is created only if its file is not there yet,
which the file system decides; so of two writers one gets ``Conflict``, and a plan
cannot change after its first write.  Tables of a run are read only through an entry
``complete`` whose manifest has the digest that the entry names.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.contracts import ContractError
from causeway.staging import stage

ENTRY = "run_id string, state string, place int, manifest_sha256 string, detail string"
#: What may follow each state; a state without followers is final.
FOLLOWING = {"running": ("complete", "failed"), "complete": (), "failed": ()}
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


class Conflict(RuntimeError):
    """Another writer was first."""


def canonical(document: object) -> str:
    """JSON text of a document that does not depend on the order of keys."""
    return json.dumps(document, sort_keys=True, separators=(",", ":"), allow_nan=False)


def digest(document: object) -> str:
    return hashlib.sha256(canonical(document).encode()).hexdigest()


class RunLog:
    """Runs below ``root``, a folder that every writer reaches through Spark's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, run_id: str, name: str):
        if not _NAME.fullmatch(run_id):
            raise ValueError(f"{run_id!r} is no run id")
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{run_id}/{name}")

    def _files(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _put(self, run_id: str, name: str, document: object) -> None:
        """Create a file that is not there yet."""
        path = self._path(run_id, name)
        files = self._files(path)
        files.mkdirs(path.getParent())
        try:
            sink = files.create(path, False)
        except Exception as problem:
            if files.exists(path):
                raise Conflict(f"{run_id}: {name} is written already") from problem
            raise
        try:
            sink.write(bytearray(canonical(document).encode()))
        finally:
            sink.close()

    def _get(self, run_id: str, name: str) -> object | None:
        path = self._path(run_id, name)
        if not self._files(path).exists(path):
            return None
        text = "".join(r["value"] for r in self.spark.read.text(path.toString(), wholetext=True).collect())  # one small document
        return json.loads(text)

    def plan(self, run_id: str, document: dict) -> None:
        """Fix a run's plan; the same plan again does nothing, another one raises ``Conflict``."""
        try:
            self._put(run_id, "plan.json", document)
        except Conflict:
            if canonical(self._get(run_id, "plan.json")) != canonical(document):
                raise

    def state(self, run_id: str) -> str | None:
        """``complete``, ``failed``, ``running``, or None for a run that has not begun."""
        last = self._get(run_id, "entry-1.json") or self._get(run_id, "entry-0.json")
        return None if last is None else last["state"]

    def begin(self, run_id: str) -> None:
        """Take a planned run; a second writer gets ``Conflict``."""
        if self._get(run_id, "plan.json") is None:
            raise ContractError(f"{run_id} has no plan")
        self._put(run_id, "entry-0.json", {"run_id": run_id, "state": "running", "place": 0, "manifest_sha256": None, "detail": None})

    def _end(self, run_id: str, state: str, manifest_sha256: str | None, detail: str | None) -> None:
        before = self.state(run_id)
        if before is None or state not in FOLLOWING[before]:
            raise Conflict(f"{run_id} is {before} and cannot become {state}")
        self._put(run_id, "entry-1.json", {"run_id": run_id, "state": state, "place": 1, "manifest_sha256": manifest_sha256, "detail": detail})

    def complete(self, run_id: str, outputs: dict[str, str]) -> None:
        """End a run with its manifest, names of outputs and their digests; the manifest is written first."""
        for name in outputs:
            if name.startswith("/") or "\\" in name or any(part in ("", ".", "..") for part in name.split("/")):
                raise ContractError(f"{name!r} leaves the run's folder")
        if self.state(run_id) != "running":
            raise Conflict(f"{run_id} is {self.state(run_id)} and cannot become complete")
        self._put(run_id, "manifest.json", outputs)
        self._end(run_id, "complete", digest(outputs), None)

    def fail(self, run_id: str, detail: str) -> None:
        self._end(run_id, "failed", None, detail)

    def outputs(self, run_id: str) -> dict[str, str]:
        """Outputs of a complete run; any other run, or a manifest that changed since, raises."""
        entry, manifest = self._get(run_id, "entry-1.json"), self._get(run_id, "manifest.json")
        if entry is None or entry["state"] != "complete":
            raise ContractError(f"{run_id} is {self.state(run_id)}, not complete")
        if manifest is None or digest(manifest) != entry["manifest_sha256"]:
            raise ContractError(f"{run_id}: the manifest is not the one that was completed")
        return manifest

    def entries(self) -> DataFrame:
        """The last entry of every run."""
        rows = self.spark.read.schema(ENTRY).option("mode", "FAILFAST").option("pathGlobFilter", "entry-*.json").option("recursiveFileLookup", True).json(self.root)
        return rows.groupBy("run_id").agg(F.max_by(F.struct("state", "manifest_sha256", "detail"), "place").alias("e")).select("run_id", "e.*")


def gates(runs: DataFrame, references: DataFrame) -> DataFrame:
    """Whether each run stands: it is sound, and so is all that it rests on, at any depth.

    ``runs(run_id, sound)``; ``references(run_id, rests_on)``.  Returns ``run_id``,
    ``valid``, and for the others ``cause``, the nearest unsound run below it (the least
    id on ties), and ``depth``, how far below (0: the run itself).  A reference to a run
    that is not there makes its run unsound.  Damage spreads from unsound runs, only
    through those that it reached last; runs that rest on each other are no trouble.
    """
    known = references.join(runs.select(F.col("run_id").alias("rests_on"), F.lit(True).alias("there")), "rests_on", "left")
    links = stage(known.filter("there").select("run_id", "rests_on").distinct(), "gate-links")
    loose = known.filter("there IS NULL").select("run_id").distinct().withColumn("loose", F.lit(True))
    own = runs.join(loose, "run_id", "left").select("run_id", (F.coalesce("sound", F.lit(False)) & F.col("loose").isNull()).alias("sound"))
    reached = stage(own.filter("NOT sound").select("run_id", F.col("run_id").alias("cause"), F.lit(0).cast("bigint").alias("depth")), "gate-reached")
    front = reached
    while not front.isEmpty():
        above = links.join(front.select(F.col("run_id").alias("rests_on"), "cause", "depth"), "rests_on").groupBy("run_id").agg(F.min("cause").alias("cause"), (F.min("depth") + 1).alias("depth"))
        front = stage(above.join(reached.select("run_id"), "run_id", "left_anti"), "gate-front")
        reached = reached.unionByName(front)
    return own.select("run_id").join(reached, "run_id", "left").select("run_id", F.col("cause").isNull().alias("valid"), "cause", "depth")
