"""GeoTIFF scan and sink, and tiles on another grid."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.contracts import ContractError
from causeway.operators import regrid
from causeway.sources import geotiff, tiff

NAN = float("nan")


def _values(dtype: str, height: int, width: int, bands: int) -> np.ndarray:
    rng = np.random.default_rng(height * width + bands)
    if dtype[0] == "f":
        out = rng.normal(size=(height, width, bands)).astype(dtype)
        out[0, 0], out[-1, -1, 0] = np.nan, -np.inf
        return out
    info = np.iinfo(dtype)
    return rng.integers(info.min, info.max, (height, width, bands), dtype=dtype, endpoint=True)


def _file(layout: tiff.Layout, values: np.ndarray) -> bytes:
    high, wide = layout.block
    blocks = [tiff.encoded(layout, values[r : r + high, c : c + wide]) for r in range(0, layout.height, high) for c in range(0, layout.width, wide)]
    return tiff.assembled(layout, blocks)


def _reader(data: bytes):
    return lambda at, size: data[at : at + size]


def _whole(data: bytes) -> np.ndarray:
    layout = tiff.directory(_reader(data))
    out = np.zeros((layout.height, layout.width, layout.bands), layout.dtype)
    for r, c, part in tiff.window(layout, _reader(data), (0, layout.height), (0, layout.width), list(range(layout.bands))):
        out[r : r + part.shape[0], c : c + part.shape[1]] = part
    return out


@pytest.mark.parametrize(("dtype", "predictor"), [("u1", 2), ("i2", 2), ("u4", 2), ("i2", 1), ("f4", 3), ("f8", 3), ("f4", 1)])
@pytest.mark.parametrize("bands", [1, 3])
def test_blocks_come_back_bit_equal(dtype, predictor, bands):
    values = _values(dtype, 37, 50, bands)
    layout = tiff.Layout(50, 37, bands, dtype, (16, 32), (0.5, 0.0, 10.0, 0.0, -0.25, 40.0), 4326, NAN if dtype[0] == "f" else 0.0, tuple(f"band <{k}>" for k in range(bands)), predictor)
    data = _file(layout, values)
    found = tiff.directory(_reader(data))
    assert (found.width, found.height, found.bands, found.dtype, found.block, found.transform, found.epsg, found.descriptions, found.predictor) == (50, 37, bands, dtype, (16, 32), layout.transform, 4326, layout.descriptions, predictor)
    assert _whole(data).tobytes() == values.tobytes()


def _strips(order: str, big: bool, separate: bool, values: np.ndarray, rows: int, compression: int) -> bytes:
    """A file in strips, written here without the library."""
    height, width, bands = values.shape
    kind, word = np.dtype(values.dtype).newbyteorder(order), "Q" if big else "I"
    planes = [values[:, :, [b]] for b in range(bands)] if separate else [values]
    blocks = [np.ascontiguousarray(p[r : r + rows]).astype(kind).tobytes() for p in planes for r in range(0, height, rows)]
    blocks = [zlib.compress(b) if compression == 8 else b for b in blocks]
    head = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 16) if big else struct.pack(order + "HI", 42, 8))
    offsets_kind = 16 if big else 4
    tags = [(256, 4, [width]), (257, 4, [height]), (258, 3, [kind.itemsize * 8] * bands), (259, 3, [compression]), (273, offsets_kind, None), (277, 3, [bands]), (278, 4, [rows]), (279, offsets_kind, [len(b) for b in blocks]), (284, 3, [2 if separate else 1]), (339, 3, [{"u": 1, "i": 2, "f": 3}[kind.kind]] * bands), (33550, 12, [2.0, 3.0, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 100.0, 200.0, 0.0])]
    code = {3: "H", 4: "I", 12: "d", 16: "Q"}
    inline, entry = (8, 20) if big else (4, 12)
    table_at = len(head)
    extra_at = table_at + (8 if big else 2) + entry * len(tags) + (8 if big else 4)
    sizes = [struct.calcsize(order + code[k]) * (len(v) if v is not None else len(blocks)) for _, k, v in tags]
    data_at = extra_at + sum(s for s in sizes if s > inline)
    offsets = [data_at + sum(len(b) for b in blocks[:k]) for k in range(len(blocks))]
    table, extra = b"", b""
    for (tag, kind_, value), size in zip(tags, sizes, strict=True):
        value = offsets if value is None else value
        raw = struct.pack(f"{order}{len(value)}{code[kind_]}", *value)
        table += struct.pack(order + "HH" + word, tag, kind_, len(value)) + (raw.ljust(inline, b"\0") if size <= inline else struct.pack(order + word, extra_at + len(extra)))
        extra += raw if size > inline else b""
    return head + struct.pack(order + ("Q" if big else "H"), len(tags)) + table + struct.pack(order + word, 0) + extra + b"".join(blocks)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("separate", [False, True])
@pytest.mark.parametrize("compression", [1, 8])
def test_strips_of_other_writers(order, big, separate, compression):
    values = _values("i2", 23, 9, 2)
    data = _strips(order, big, separate, values, 5, compression)
    assert (_whole(data) == values).all()
    assert tiff.directory(_reader(data)).transform == (2.0, 0.0, 100.0, 0.0, -3.0, 200.0)


def test_broken_files_raise():
    values = _values("f4", 40, 40, 1)
    data = _file(tiff.Layout(40, 40, 1, "f4", (16, 16), predictor=3), values)
    for cut in range(0, len(data), 97):
        with pytest.raises(tiff.TiffError):
            _whole(data[:cut])
    with pytest.raises(tiff.TiffError, match="not a TIFF"):
        _whole(b"PK" + data[2:])
    with pytest.raises(tiff.TiffError, match="broken block"):
        _whole(data[:12] + b"\xff" * 20 + data[32:])
    with pytest.raises(tiff.TiffError, match="unsupported compression 5"):
        _whole(_strips("<", False, False, _values("i2", 4, 4, 1), 4, 5))


@pytest.fixture
def rasters(spark, tmp_path):
    """Two written files and their values."""
    layout = tiff.Layout(70, 45, 3, "f4", (16, 32), (1.0, 0.0, 5.0, 0.0, -1.0, 9.0), 25830, NAN, ("VV", "VH", "x"), 3)
    tables = {n: _values("f4", 45, 70, 3) * k for k, n in ((1, "one"), (-2, "two"))}
    rows = [(n, r, c, v[r, c].astype(float).tolist()) for n, v in tables.items() for r in range(45) for c in range(70) if (r, c) != (20, 20)]
    pixels = spark.createDataFrame(rows, "name string, px_row long, px_col long, values array<double>").repartition(7)
    root = str(tmp_path / "tiles")
    geotiff.write_rasters(pixels, root, layout)
    for v in tables.values():
        v[20, 20] = np.nan
    return root, layout, tables, pixels


def _scanned(df, tables, bands=(0, 1, 2)):
    seen = 0
    for row in df.collect():
        want = tables[row["path"].rsplit("/", 1)[1].removesuffix(".tif")][row["px_row"], row["px_col"], list(bands)].astype(float)
        assert np.array_equal(np.array(row["values"]), want, equal_nan=True)
        seen += 1
    return seen


def test_round_trip(spark, rasters):
    root, layout, tables, pixels = rasters
    geotiff.register(spark)
    assert _scanned(spark.read.format("geotiff").load(root), tables) == 2 * 45 * 70
    info = spark.read.format("geotiff_info").load(root).collect()
    assert [(r["width"], r["height"], r["bands"], r["dtype"], tuple(r["transform"]), r["epsg"], r["descriptions"]) for r in info] == [(70, 45, 3, "f4", layout.transform, 25830, ["VV", "VH", "x"])] * 2
    with pytest.raises(Exception, match="exist"):
        geotiff.write_rasters(pixels, root, layout)
    geotiff.write_rasters(pixels, root, layout, mode="overwrite")
    assert len(geotiff.files(root)) == 2
    with pytest.raises(Exception, match="one pixel twice"):
        geotiff.write_rasters(pixels.union(pixels), root + "-twice", layout)
    with pytest.raises(Exception, match="outside the grid"):
        geotiff.write_rasters(pixels.withColumn("px_col", F.col("px_col") + 1), root + "-outside", layout)
    assert not os.path.exists(root + "-outside") or geotiff.files(root + "-outside") == []


def test_bands_windows_and_filters(spark, rasters, monkeypatch):
    root, _, tables, _ = rasters
    geotiff.register(spark)
    assert _scanned(spark.read.format("geotiff").option("bands", "3,1").option("window", "10,30,7,20").load(root), tables, (2, 0)) == 2 * 7 * 20
    some = spark.read.format("geotiff").load(root).filter("px_row >= 16 and px_row < 20 and px_col = 33")
    assert _scanned(some, tables) == 2 * 4
    # few blocks are read: filters narrow the window before any block is opened
    reader = geotiff._PixelReader({"path": root})
    left = list(reader.pushFilters([geotiff.GreaterThanOrEqual(("px_row",), 16), geotiff.LessThan(("px_row",), 20), geotiff.EqualTo(("px_col",), 33), geotiff.EqualTo(("path",), "x")]))
    assert [f.attribute for f in left] == [("path",)]
    opened_blocks = []
    plain = tiff.decoded
    monkeypatch.setattr(tiff, "decoded", lambda *a: opened_blocks.append(1) or plain(*a))
    rows = sum(b.num_rows for part in reader.partitions() for b in reader.read(part))
    assert rows == 8 and len(opened_blocks) == 2
    monkeypatch.setattr(geotiff, "SPLIT_BYTES", 2_000)
    assert len(geotiff._PixelReader({"path": root}).partitions()) > 2
    assert _scanned(spark.read.format("geotiff").load(root), tables) == 2 * 45 * 70


def test_truncated_file_fails_the_scan(spark, rasters):
    root = rasters[0]
    geotiff.register(spark)
    with pytest.raises(Exception, match="3 bands"):
        spark.read.format("geotiff").option("bands", "4").load(root).count()
    path = geotiff.files(root)[0][0]
    data = open(path, "rb").read()
    with open(path, "wb") as f:
        f.write(data[: len(data) // 2])
    with pytest.raises(Exception, match="truncated"):
        spark.read.format("geotiff").load(root).count()


# tiles on another grid -----------------------------------------------------

LABEL = regrid.Grid(23, 17, (1.0, 0.0, 100.0, 0.0, -1.0, 50.0))


def _bilinear(values: np.ndarray, source: regrid.Grid, target: regrid.Grid) -> tuple[np.ndarray, np.ndarray]:
    """Pixel by pixel."""
    out, valid = np.full((target.height, target.width), np.nan), np.zeros((target.height, target.width), bool)
    sa, _, sc, _, se, sf = source.transform
    ta, _, tc, _, te, tf = target.transform
    for r in range(target.height):
        for c in range(target.width):
            y, x = (tf + (r + 0.5) * te - sf) / se - 0.5, (tc + (c + 0.5) * ta - sc) / sa - 0.5
            total = weight = 0.0
            for i in (int(np.floor(y)), int(np.floor(y)) + 1):
                for j in (int(np.floor(x)), int(np.floor(x)) + 1):
                    if 0 <= i < source.height and 0 <= j < source.width and np.isfinite(values[i, j]):
                        w = (1 - abs(y - i)) * (1 - abs(x - j))
                        total, weight = total + w * values[i, j] if w > 0 else total, weight + w
            i, j = int(np.floor(y + 0.5)), int(np.floor(x + 0.5))
            if 0 <= i < source.height and 0 <= j < source.width and np.isfinite(values[i, j]) and weight > 0:
                out[r, c], valid[r, c] = total / weight, True
    return out, valid


def _rows(values: np.ndarray, tile: str, *, drop: float = 0.1) -> list[tuple]:
    rng = np.random.default_rng(1)
    values[rng.random(values.shape) < drop] = np.nan
    return [(tile, r, c, None if (r + c) % 2 and np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(values)]


@pytest.mark.parametrize(
    "source",
    [
        regrid.Grid(23, 17, (1.0, 0.0, 100.3, 0.0, -1.0, 50.4)),  # moved
        regrid.Grid(14, 11, (1.7, 0.0, 99.5, 0.0, -1.6, 50.2)),  # coarser
        regrid.Grid(60, 50, (0.4, 0.0, 99.9, 0.0, -0.4, 51.0)),  # finer
        regrid.Grid(23, 17, (1.0, 0.0, 100.0, 0.0, 1.0, 33.0)),  # upside down
        regrid.Grid(23, 17, (1.0, 0.0, 100.5, 0.0, -1.0, 50.5)),  # centres on corners
        regrid.Grid(5, 5, (1.0, 0.0, 110.2, 0.0, -1.0, 40.0)),  # a part only
    ],
)
@pytest.mark.parametrize("block", [5, 128])
def test_regridding_equals_pixel_by_pixel(spark, source, block):
    values = {t: np.random.default_rng(k).normal(size=(source.height, source.width)) for k, t in enumerate("ab")}
    rows = [row for t, v in values.items() for row in _rows(v, t)]
    pixels = spark.createDataFrame(rows, "tile_id string, px_row int, px_col int, v double").withColumn("valid", F.lit("clash")).repartition(5)
    got = regrid.on_grid(pixels, source, LABEL, ["v"], block=block).collect()
    seen = {(r["tile_id"], r["px_row"], r["px_col"]): r for r in got}
    assert len(seen) == len(got)
    for t, v in values.items():
        want, valid = _bilinear(v, source, LABEL)
        for (r, c), fine in np.ndenumerate(valid):
            row = seen.get((t, r, c))
            assert (row is not None and row["valid"]) == fine
            if fine:
                assert row["v"] == pytest.approx(want[r, c], abs=1e-9)
            elif row is not None:
                assert row["v"] is None


def test_canonical_tiles(spark):
    grids = {"label": LABEL, "radar": regrid.Grid(23, 17, (1.0, 0.0, 100.0, 0.0, -1.0, 50.0)), "optical": regrid.Grid(14, 11, (1.7, 0.0, 99.8, 0.0, -1.6, 50.3))}
    labels = [("t", r, c, (r * c) % 3 - 1) for r in range(17) for c in range(23)]
    radar, optical = np.random.default_rng(0).normal(size=(17, 23)), np.random.default_rng(1).normal(size=(11, 14)) * 1e4
    made = lambda rows, name: spark.createDataFrame(rows, f"tile_id string, px_row int, px_col int, {name} {'int' if name == 'label' else 'double'}")
    tables = made(labels, "label"), made(_rows(radar, "t"), "vh"), made(_rows(optical, "t"), "b3")
    out = regrid.canonical(*tables, grids, radar_bands=["vh"], optical_bands=["b3"], block=6)
    rows = {(r["px_row"], r["px_col"]): r for r in out.collect()}
    assert len(rows) == 17 * 23
    want, valid = _bilinear(optical, grids["optical"], LABEL)
    for (r, c), row in rows.items():
        code = (r * c) % 3 - 1
        assert row["label"] == (None if code < 0 else code)
        assert row["radar_valid"] == np.isfinite(radar[r, c]) and row["optical_valid"] == valid[r, c]
        assert row["paired_valid"] == (row["radar_valid"] and row["optical_valid"]) and row["supervised"] == (row["paired_valid"] and code >= 0)
        if valid[r, c]:
            assert row["b3"] == pytest.approx(want[r, c] / 1e4)
        if row["radar_valid"]:
            assert row["vh"] == radar[r, c]
    counts = regrid.quality(out).first()
    assert counts["paired_sensor_valid"] == sum(r["paired_valid"] for r in rows.values()) and counts["cloud_known"] == 0
    with pytest.raises(ContractError, match="too little"):
        regrid.canonical(*tables, {**grids, "radar": regrid.Grid(5, 5, (1.0, 0.0, 110.0, 0.0, -1.0, 40.0))}, radar_bands=["vh"], optical_bands=["b3"])
    with pytest.raises(ContractError, match="label codes"):
        regrid.canonical(tables[0].withColumn("label", F.lit(2)), *tables[1:], grids, radar_bands=["vh"], optical_bands=["b3"])
    with pytest.raises(Exception, match="given twice"):
        regrid.canonical(tables[0], tables[1], tables[2].union(tables[2]), grids, radar_bands=["vh"], optical_bands=["b3"]).count()
    with pytest.raises(ContractError, match="no rotation"):
        regrid.Grid(3, 3, (1.0, 0.1, 0.0, 0.0, -1.0, 0.0))
