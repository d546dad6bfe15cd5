"""Readers, writers, lineage, bundles and the stream of counts."""

from __future__ import annotations

import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from causeway.contracts import ContractError
from causeway.operators import access, graph
from causeway.plans import bundle, lineage
from causeway.sources import readers, writers
from causeway.streaming.counts import running_confusion


def test_splits(spark, tmp_path):
    (tmp_path / "train.csv").write_text("A_1_S1Hand.tif,A_1_LabelHand.tif\n")
    (tmp_path / "test.csv").write_text("B_1_S1Hand.tif,B_1_LabelHand.tif\n")
    files = {"train": str(tmp_path / "train.csv"), "test": str(tmp_path / "test.csv")}
    assert {tuple(r) for r in readers.read_splits(spark, files).collect()} == {("A_1", "train"), ("B_1", "test")}
    (tmp_path / "test.csv").write_text("A_1_S1Hand.tif,A_1_LabelHand.tif\n")
    with pytest.raises(ContractError):
        readers.read_splits(spark, files)


def test_geojson(spark, tmp_path):
    point = lambda i, x, y: {"id": i, "geometry": {"type": "Point", "coordinates": [x, y]}, "properties": {"n": "1"}}
    doc = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "urn:EPSG::4326"}}, "features": [point("a", -0.7, 38.1), point("b", -0.8, 38.0)]}
    path = tmp_path / "f.json"
    path.write_text(json.dumps(doc))
    features = readers.validate_features(readers.read_geojson(spark, str(path), crs="4326"), "Point")
    assert features.count() == 2
    assert json.loads(writers.to_feature(features.filter("id = 'a'")).first()[0])["geometry"]["coordinates"] == [-0.7, 38.1]
    doc["features"].append(point("c", 700000, 4200000))
    path.write_text(json.dumps(doc))
    with pytest.raises(ContractError):
        readers.validate_features(readers.read_geojson(spark, str(path)), "Point")


def test_osm_and_zip_and_lines(spark, tmp_path):
    elements = [{"type": "node", "id": 1, "lon": -0.8, "lat": 38.0}, {"type": "way", "id": 5, "nodes": [1, 1], "tags": {"highway": "service"}}]
    (tmp_path / "o.json").write_text(json.dumps({"elements": elements}))
    nodes, ways = readers.read_osm(spark, str(tmp_path / "o.json"))
    assert nodes.count() == 1 and ways.first()["tags"] == {"highway": "service"}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("x/a.json", "{}")
        z.writestr("x/b.txt", "t")
    members = readers.zip_members(spark, str(tmp_path / "z.zip"), suffix=".json")
    assert readers.only_member(members, "a").first()["content"] == b"{}"
    with pytest.raises(ContractError):
        readers.only_member(members, "missing")
    with gzip.open(tmp_path / "r.jsonl.gz", "wt") as f:
        f.write('{"a": 1}\n{"a": 2}\n')
    assert readers.read_json_lines(spark, str(tmp_path / "r.jsonl.gz"), "a int").agg(F.sum("a")).first()[0] == 3


def test_keys_and_frozen_rows(spark):
    df = spark.createDataFrame([("a/b.tif",), ("../b",), ("/a",), ("a//b",), (None,)], "k string")
    assert [r[0] for r in df.select(readers.valid_key(F.col("k"))).collect()] == [True, False, False, False, False]
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "event_id string")
    assert readers.frozen_rows(rows, {"a": 2, "b": 1}).count() == 3
    with pytest.raises(ContractError):
        readers.frozen_rows(rows, {"a": 2})


def test_lineage(spark, tmp_path):
    assert lineage.run_id("M6", {"b": 1, "a": 2}) == lineage.run_id("M6", {"a": 2, "b": 1})
    df = spark.range(50).withColumn("x", F.col("id") * 2)
    a, b = lineage.table_digest(df).first(), lineage.table_digest(df.repartition(3).orderBy(F.desc("id"))).first()
    assert a == b and lineage.table_digest(df.filter("id > 0")).first() != a
    (tmp_path / "a.txt").write_text("one")
    found = readers.listing(spark, str(tmp_path))
    declared = found.select("path", F.lit("0").alias("sha256"))
    assert [r["status"] for r in lineage.verify_outputs(declared, found).collect()] == ["changed"]
    runs = [("m1_pilot", "r1", "complete", 1, "h", "h"), ("m2_pilot", "r2", "complete", 1, "h", "x"), ("m3_development", "r3", "complete", 1, "h", "h")]
    table = spark.createDataFrame(runs, "milestone string, run_id string, status string, completed_at int, manifest_sha256 string, computed_sha256 string")
    assert lineage.ladder(lineage.latest_valid(table)) == "m1_pilot"


def test_bundle(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0), (3, 200.0, 0.0)], "node_id long, x_m double, y_m double")
    ways = spark.createDataFrame([(1, [1, 2, 3], {"highway": "service"})], "way_id long, nodes array<long>, tags map<string,string>")
    segments = graph.segments(ways, nodes)
    evidence = spark.createDataFrame([("osm:1:0", 100.0, 60.0)], "segment_id string, within_tile_m double, retained_m double")
    water = spark.createDataFrame([("osm:1:0", "wet", 60.0, 45.0)], "segment_id string, scenario_id string, supported_water_m double, retained_water_m double")
    grid = access.policy_grid(spark, ["wet"])
    closed = access.closures(segments, evidence, water, grid)
    path = str(tmp_path / "bundle")
    bundle.build(path, segments=segments, evidence=evidence, closed=closed, summary=grid, about={"id": "t"})
    assert bundle.road(spark, path, "osm:1:0").first()["state"] == "within_image"
    assert bundle.road(spark, path, "osm:1:1").first()["state"] == "outside_image_unknown"
    assert bundle.road(spark, path, "none").count() == 0
    assert [r["segment_id"] for r in bundle.scenario(spark, path, "wet", "supported_overlap", "bridge_exempt").collect()] == ["osm:1:0"]
    assert bundle.options(spark, path, policy="retained_overlap").count() == 2
    assert json.loads(bundle.export(spark, path, "wet", "supported_overlap", "bridge_exempt").first()[0])["closed"] == 1
    assert bundle.roads_in_view(spark, path, (150.0, -1.0, 300.0, 1.0)).count() == 1
    with pytest.raises(ContractError):
        bundle.build(path + "2", segments=segments, evidence=evidence.withColumn("segment_id", F.lit("x")), closed=closed, summary=grid, about={})


def test_stream_of_counts(spark, tmp_path):
    rows = spark.createDataFrame([("e", 1, 0.9, True), ("e", 0, 0.8, True), ("e", 1, 0.1, True)], "event_id string, label int, p double, eligible boolean")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = running_confusion(stream, F.col("p") >= 0.5, ["event_id"]).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    row = spark.table("counts").first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (1, 1, 1, 0)
