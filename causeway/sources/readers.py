"""Readers of the exchange formats, each with a declared schema."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.contracts import ContractError, require, require_unique

GEOJSON = "type string, crs struct<type: string, properties: struct<name: string>>, features array<struct<id: string, geometry: string, properties: map<string, string>>>"
OSM = "elements array<struct<type: string, id: bigint, lon: double, lat: double, nodes: array<bigint>, tags: map<string, string>>>"


def read_splits(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Official split lists, headerless CSV of an image and a label name per chip; a chip in two lists is an error."""
    out: DataFrame | None = None
    for split, path in files.items():
        rows = spark.read.schema("image string, label string").csv(path).withColumn("official_split", F.lit(split))
        out = rows if out is None else out.unionByName(rows)
    chip = lambda c, suffix: F.regexp_replace(c, f"{suffix}$", "")
    named = out.withColumn("chip", chip("image", "_S1Hand\\.tif"))
    require(named, {"image suffix": F.col("image").endswith("_S1Hand.tif"), "label matches image": chip("label", "_LabelHand\\.tif") == F.col("chip")})
    return require_unique(named.select("chip", "official_split"), "chip")


def read_geojson(spark: SparkSession, path: str, *, crs: str | None = None) -> DataFrame:
    """Features of a collection: ``id``, ``geometry`` (JSON text), its ``geometry_type`` and ``properties``."""
    whole = spark.read.schema(GEOJSON).option("multiLine", True).json(path)
    rules = {"feature collection": F.col("type") == "FeatureCollection"}
    if crs is not None:
        rules["declared reference system"] = F.coalesce(F.col("crs.properties.name"), F.lit("")).contains(crs)
    require(whole, rules)
    rows = whole.select(F.explode("features").alias("f")).select("f.id", "f.geometry", F.col("f.properties").alias("properties"))
    return rows.withColumn("geometry_type", F.get_json_object("geometry", "$.type"))


def validate_features(features: DataFrame, geometry_type: str) -> DataFrame:
    """Features with unique, non-empty ids, the given type, and, for points, geographic coordinates."""
    rules: dict[str, Column] = {"id": F.length("id") > 0, "geometry type": F.col("geometry_type") == geometry_type}
    if geometry_type == "Point":
        place = lambda k: F.get_json_object("geometry", f"$.coordinates[{k}]").try_cast("double")
        rules |= {"longitude": place(0).between(-180, 180), "latitude": place(1).between(-90, 90)}
    return require_unique(require(features, rules), "id")


def latest_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key in ``order``."""
    return rows.groupBy(key).agg(F.max_by(F.struct("*"), order).alias("r")).select("r.*")


def read_osm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(node_id, lon, lat)`` and ways ``(way_id, nodes, tags)`` of a document of elements."""
    rows = spark.read.schema(OSM).option("multiLine", True).json(path).select(F.inline("elements"))
    nodes = rows.filter("type = 'node'").select(F.col("id").alias("node_id"), "lon", "lat")
    ways = rows.filter("type = 'way'").select(F.col("id").alias("way_id"), "nodes", F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("tags"))
    return require_unique(require(nodes, {"coordinates": F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90)}), "node_id"), ways


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, compressed or not; a line that does not parse is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def zip_members(spark: SparkSession, path: str, *, prefix: str = "", suffix: str = "") -> DataFrame:
    """Members of ZIP archives: ``archive``, ``member`` and ``content``, one archive per row of work."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for name in sorted(z.namelist()):
                        if name.startswith(prefix) and name.endswith(suffix) and not name.endswith("/"):
                            yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([name]), pa.array([z.read(name)])], names=["archive", "member", "content"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(opened, "archive string, member string, content binary")


def only_member(members: DataFrame, keyword: str) -> DataFrame:
    """The one member whose name has ``keyword``; none or several is an error."""
    found = members.filter(F.contains("member", F.lit(keyword)))
    if found.limit(2).count() != 1:
        raise ContractError(f"{keyword}: not exactly one member")
    return found


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Files under a folder with their length and SHA-256."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def valid_key(key: Column) -> Column:
    """Whether an object key is relative and stays inside its folder."""
    parts = F.split(key, "/")
    return F.coalesce((key != "") & ~key.startswith("/") & ~F.contains(key, F.lit("\\")) & F.forall(parts, lambda p: ~p.isin("", ".", "..")), F.lit(False))


def frozen_rows(catalog: DataFrame, counts: dict[str, int], *, event: str = "event_id") -> DataFrame:
    """``catalog`` when its events are exactly those of ``counts``, with exactly so many rows."""
    found = {r[event]: r["count"] for r in catalog.groupBy(event).count().limit(len(counts) + 1).collect()}
    if found != counts:
        raise ContractError(f"frozen counts differ: {found}")
    return catalog
