"""Tables written to the shared folder, so that loops keep a short lineage.

An operator that reads an intermediate result more than once writes it as
Parquet under ``spark.checkpoint.dir`` and reads it back.  The files outlive
lost executors, and each is computed once.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may do without that setting; it gets a temporary folder
    for the session.  On a cluster a missing setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="causeway-")
        base = _LOCAL[app]
    return f"{base.rstrip('/')}/causeway-{app}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, *, tidy: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back.

    With ``tidy`` the shuffle files behind it go as soon as it is written.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    write(df, path, tidy=tidy)
    return spark.read.schema(df.schema).parquet(path)


def write(df: DataFrame, path: str, *, tidy: bool = False, by: str | None = None) -> None:
    """Write ``df`` as Parquet, in folders ``by`` a column; with ``tidy`` without leaving shuffle files."""
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(_TIDY, None)
    if tidy:
        conf.set(_TIDY, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        if tidy and before is None:
            conf.unset(_TIDY)
        elif tidy:
            conf.set(_TIDY, before)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
