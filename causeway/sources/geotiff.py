"""GeoTIFF files as a data source: ``geotiff`` to scan and write, ``geotiff_info`` for directories.

    register(spark)
    spark.read.format("geotiff").option("bands", "1,3").load(folder).filter("px_row < 512")

A scan gives a row per pixel: ``path``, ``px_row``, ``px_col`` and ``values``, an array
of the chosen bands.  Files are listed on the driver and split by rows of blocks if
they are large; tasks read the directory and then only the blocks that the window
meets.  Comparisons of ``px_row`` and ``px_col`` with numbers narrow the window, and so
does the option ``window`` ("row,column,height,width").

Writing takes encoded blocks (``write_rasters`` makes them of pixels, a task for each
block) and puts the blocks of a file together, in memory, so a file's compressed size
must fit in a task.  Files get their names only when all tasks are done.

Paths are those that ``pyarrow.fs`` can open (local or shared folders, object stores,
HDFS); every executor opens them itself.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from causeway.sources import tiff

PIXELS = "path string, px_row bigint, px_col bigint, values array<double>"
INFO = "path string, width int, height int, bands int, dtype string, block_height int, block_width int, transform array<double>, epsg int, nodata double, descriptions array<string>, predictor int"
BLOCKS = "name string, place int, content binary"
#: Bytes of a file beyond which its rows of blocks are dealt over several partitions.
SPLIT_BYTES = 64 << 20
#: Small files that one task reads at most.
TOGETHER = 32
_FAR = 1 << 40


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system of a path with or without a scheme."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[str, int]]:
    """TIFF files at or below a path with their sizes, by name."""
    system, inner = opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [i for i in system.get_file_info(fs.FileSelector(inner, recursive=True)) if i.is_file and i.extension in ("tif", "tiff") and "/_" not in i.path[len(inner) :]]
    return sorted((i.path, i.size) for i in found)


class _File:
    """An open file that reads byte ranges."""

    def __init__(self, root: str, path: str):
        self.stream = opened(root)[0].open_input_file(path)

    def __enter__(self) -> _File:
        return self

    def __exit__(self, *_: object) -> None:
        self.stream.close()

    def read(self, at: int, size: int) -> bytes:
        self.stream.seek(min(at, self.stream.size()))
        return self.stream.read(size)


@dataclass
class _Part(InputPartition):
    """Files with the rows to read of each."""

    pieces: list[tuple[str, int, int]]


class _PixelReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.bands = [int(b) - 1 for b in options["bands"].split(",")] if options.get("bands") else None
        row, column, height, width = (int(v) for v in options["window"].split(",")) if options.get("window") else (0, 0, _FAR, _FAR)
        self.rows, self.columns = (row, row + height), (column, column + width)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute in (("px_row",), ("px_col",)) and isinstance(f.value, int):
                name = "rows" if f.attribute == ("px_row",) else "columns"
                low, stop = getattr(self, name)
                if isinstance(f, (EqualTo, GreaterThanOrEqual)):
                    low = max(low, f.value)
                if isinstance(f, GreaterThan):
                    low = max(low, f.value + 1)
                if isinstance(f, (EqualTo, LessThanOrEqual)):
                    stop = min(stop, f.value + 1)
                if isinstance(f, LessThan):
                    stop = min(stop, f.value)
                setattr(self, name, (low, stop))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        out: list[InputPartition] = []
        small, held = [], 0
        for path, size in files(self.root):
            low, stop = self.rows
            if size > SPLIT_BYTES:
                with _File(self.root, path) as file:
                    layout = tiff.directory(file.read)
                low, stop = max(low, 0), min(stop, layout.height)
                high = layout.block[0]
                step = max(1, layout.down * SPLIT_BYTES // size) * high
                out += [_Part([(path, max(low, top), min(stop, top + step))]) for top in range(low // high * high, stop, step)]
            else:
                if small and (held + size > SPLIT_BYTES or len(small) == TOGETHER):
                    out.append(_Part(small))
                    small, held = [], 0
                small.append((path, low, stop))
                held += size
        return [*out, *([_Part(small)] if small else [])] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        for piece in partition.pieces:
            yield from self._pixels(*piece)

    def _pixels(self, path: str, first: int, stop: int) -> Iterator[pa.RecordBatch]:
        with _File(self.root, path) as file:
            layout = tiff.directory(file.read)
            bands = list(range(layout.bands)) if self.bands is None else self.bands
            if any(not 0 <= b < layout.bands for b in bands):
                raise tiff.TiffError(f"{path} has {layout.bands} bands")
            for top, left, values in tiff.window(layout, file.read, (first, stop), self.columns, bands):
                high, wide = values.shape[:2]
                n = high * wide
                flat = pa.array(np.ascontiguousarray(values, np.float64).reshape(-1))
                listed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(bands)), flat)
                rows = np.repeat(np.arange(top, top + high, dtype=np.int64), wide)
                columns = np.tile(np.arange(left, left + wide, dtype=np.int64), high)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(rows), pa.array(columns), listed], names=["path", "px_row", "px_col", "values"])


class _InfoReader(DataSourceReader):
    #: Files whose directories one task reads.
    EACH = 256

    def __init__(self, options: dict[str, str]):
        self.root = options["path"]

    def partitions(self) -> Sequence[InputPartition]:
        listed = [path for path, _ in files(self.root)]
        return [InputPartition(listed[k : k + self.EACH]) for k in range(0, len(listed), self.EACH)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.value:
            with _File(self.root, path) as file:
                x = tiff.directory(file.read)
            yield (path, x.width, x.height, x.bands, x.dtype, *x.block, list(x.transform), x.epsg, x.nodata, list(x.descriptions), x.predictor)


@dataclass
class _Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    """Puts blocks together; rows come ordered by file and place."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.root, self.overwrite = options["path"], overwrite
        self.layout = layout_of(options["layout"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, inner = opened(self.root)
        system.create_dir(inner, recursive=True)
        done: list[tuple[str, str]] = []

        def finish(name: str, blocks: list[bytes]) -> None:
            temporary = f"{inner}/_{uuid.uuid4().hex}"
            with system.open_output_stream(temporary) as sink:
                sink.write(tiff.assembled(self.layout, blocks))
            done.append((temporary, f"{inner}/{name}.tif"))

        name, blocks = None, []
        for batch in iterator:
            for n, place, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if n != name:
                    if name is not None:
                        finish(name, blocks)
                    name, blocks = n, []
                if place != len(blocks):
                    raise tiff.TiffError(f"{n}: block {len(blocks)} is missing or out of order")
                blocks.append(content.as_py())
        if name is not None:
            finish(name, blocks)
        return _Written(done)

    def commit(self, messages: list[_Written | None]) -> None:
        system, inner = opened(self.root)
        pairs = [p for m in messages if m is not None for p in m.names]
        names = [final for _, final in pairs]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise tiff.TiffError("a file was written by two tasks")
        there = [i.path for i in system.get_file_info(names) if i.type != fs.FileType.NotFound] if names else []
        if there and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{there[0]} exists")
        for temporary, final in pairs:
            system.move(temporary, final)

    def abort(self, messages: list[_Written | None]) -> None:
        system = opened(self.root)[0]
        for temporary, _ in (p for m in messages if m is not None for p in m.names):
            if system.get_file_info(temporary).is_file:
                system.delete_file(temporary)


class GeoTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema: object) -> DataSourceReader:
        return _PixelReader(dict(self.options))

    def writer(self, schema: object, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


class GeoTiffInfo(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff_info"

    def schema(self) -> str:
        return INFO

    def reader(self, schema: object) -> DataSourceReader:
        return _InfoReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make both sources known to the session, with filters pushed down to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiff)
    spark.dataSource.register(GeoTiffInfo)


def layout_of(text: str) -> tiff.Layout:
    """A layout from its JSON text."""
    said = json.loads(text)
    return tiff.Layout(**{k: tuple(v) if isinstance(v, list) else v for k, v in said.items()})


def layout_text(layout: tiff.Layout) -> str:
    names = ("width", "height", "bands", "dtype", "block", "transform", "epsg", "nodata", "descriptions", "predictor")
    return json.dumps({k: getattr(layout, k) for k in names})


def write_rasters(pixels: DataFrame, path: str, layout: tiff.Layout, *, name: str = "name", mode: str = "append") -> None:
    """Write ``pixels(<name>, px_row, px_col, values)`` as a tiled deflate file for each name, all of one layout.

    Pixels that are not there get the nodata value, or 0; repeated ones or ones
    outside the grid raise.  Blocks without any pixel are written too.
    """
    high, wide = layout.block
    spark = pixels.sparkSession
    register(spark)
    rows = pixels.select(F.col(name).cast("string").alias("name"), "px_row", "px_col", F.transform("values", lambda v: v.cast("double")).alias("values"))
    placed = rows.withColumn("place", (F.floor(F.col("px_row") / high) * layout.across + F.floor(F.col("px_col") / wide)).cast("int"))

    def block(table: pa.Table) -> pa.Table:
        place = table.column("place")[0].as_py()
        top, left = place // layout.across * high, place % layout.across * wide
        r, c = (table.column(k).to_numpy() - start for k, start in (("px_row", top), ("px_col", left)))
        if (r < 0).any() or (c < 0).any() or (r >= min(high, layout.height - top)).any() or (c >= min(wide, layout.width - left)).any() or len(np.unique(r * wide + c)) < len(r):
            raise tiff.TiffError("pixels outside the grid, or one pixel twice")
        full = np.full((high, wide, layout.bands), 0 if layout.nodata is None else layout.nodata, np.dtype(layout.dtype))
        flat = table.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        full[r, c] = flat.reshape(-1, layout.bands).astype(full.dtype)
        return pa.table({"name": table.column("name").slice(0, 1), "place": pa.array([place], pa.int32()), "content": pa.array([tiff.encoded(layout, full)], pa.binary())})

    blocks = placed.groupBy("name", "place").applyInArrow(block, BLOCKS)
    blank = tiff.encoded(layout, np.full((high, wide, layout.bands), 0 if layout.nodata is None else layout.nodata, np.dtype(layout.dtype)))
    places = rows.select("name").distinct().select("name", F.explode(F.sequence(F.lit(0), F.lit(layout.across * layout.down - 1))).alias("place"), F.lit(None).cast("binary").alias("content"))
    whole = blocks.unionByName(places).groupBy("name", "place").agg(F.coalesce(F.max("content"), F.lit(blank)).alias("content"))
    ordered = whole.repartition("name").sortWithinPartitions("name", "place")
    ordered.write.format("geotiff").option("layout", layout_text(layout)).mode(mode).save(path)
