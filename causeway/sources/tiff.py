"""Blocks and directories of GeoTIFF files, with zlib and NumPy.

Both byte orders, classic and large files, strips and tiles, interleaved and
separate bands, no compression or deflate, and predictors 1, 2 and 3 are read;
tiled interleaved deflate files are written.  Anything else raises, as does a
file that ends before its directory says so.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import numpy as np

# Fixed values of the format: tag numbers, sizes of field types, codes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, EXTRA, FORMAT = 317, 322, 323, 324, 325, 338, 339
PIXEL_SCALE, TIE_POINT, AFFINE, GEO_KEYS, METADATA, NODATA = 33550, 33922, 34264, 34735, 42112, 42113
_FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_KINDS = {1: "u", 2: "i", 3: "f"}
_DEFLATE = (8, 32946)
GEOGRAPHIC_KEY, PROJECTED_KEY = 2048, 3072

Read = Callable[[int, int], bytes]


class TiffError(ValueError):
    """A file that is broken or of an unsupported kind."""


@dataclass(frozen=True)
class Layout:
    """What the directory of a file says; ``transform`` maps (column, row) to (x, y)."""

    width: int
    height: int
    bands: int
    dtype: str
    block: tuple[int, int] = (256, 256)
    transform: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0, -1.0, 0.0)
    epsg: int | None = None
    nodata: float | None = None
    descriptions: tuple[str, ...] = ()
    predictor: int = 1
    deflated: bool = True
    separate: bool = False
    tiled: bool = True
    order: str = "<"
    offsets: tuple[int, ...] = field(default=(), repr=False)
    sizes: tuple[int, ...] = field(default=(), repr=False)

    @property
    def across(self) -> int:
        return -(-self.width // self.block[1])

    @property
    def down(self) -> int:
        return -(-self.height // self.block[0])


def _exactly(read: Read, at: int, size: int) -> bytes:
    data = read(at, size)
    if len(data) < size:
        raise TiffError(f"truncated: {size} bytes at {at} wanted, {len(data)} there")
    return data


def _entries(read: Read) -> tuple[str, dict[int, tuple]]:
    """Byte order and the fields of the first directory."""
    head = _exactly(read, 0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None:
        raise TiffError("not a TIFF file")
    (version,) = struct.unpack(order + "H", head[2:4])
    if version == 42:
        (at,) = struct.unpack(order + "I", head[4:8])
        count_kind, entry, word, inline = "H", 12, "I", 4
    elif version == 43:
        (at,) = struct.unpack(order + "Q", _exactly(read, 8, 8))
        count_kind, entry, word, inline = "Q", 20, "Q", 8
    else:
        raise TiffError("not a TIFF file")
    (count,) = struct.unpack(order + count_kind, _exactly(read, at, struct.calcsize(count_kind)))
    at += struct.calcsize(order + count_kind)
    table = _exactly(read, at, entry * count)
    out: dict[int, tuple] = {}
    for k in range(count):
        tag, kind, n = struct.unpack_from(order + "HH" + word, table, entry * k)
        if kind not in _FIELDS:
            continue
        code = _FIELDS[kind]
        size = struct.calcsize(order + code) * n
        place = entry * k + 4 + inline
        raw = table[place : place + size] if size <= inline else _exactly(read, struct.unpack_from(order + word, table, place)[0], size)
        out[tag] = (raw.rstrip(b"\0").decode("utf-8", "replace"),) if code == "s" else struct.unpack(f"{order}{n}{code}", raw)
    return order, out


def directory(read: Read) -> Layout:
    """Layout of a file, of which ``read(offset, size)`` returns bytes."""
    order, tags = _entries(read)
    for tag, name in ((WIDTH, "width"), (HEIGHT, "height"), (BITS, "bits")):
        if tag not in tags:
            raise TiffError(f"no {name}")
    width, height, bands = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, (1,))[0]
    bits, kinds = set(tags[BITS]), set(tags.get(FORMAT, (1,)))
    if len(bits) > 1 or len(kinds) > 1 or min(bits) % 8 or not kinds <= set(_KINDS):
        raise TiffError("bands of several or unsupported types")
    compression, predictor = tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0]
    if compression not in (1, *_DEFLATE) or predictor not in (1, 2, 3):
        raise TiffError(f"unsupported compression {compression} or predictor {predictor}")
    tiled = TILE_OFFSETS in tags
    block = (tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]) if tiled else (min(tags.get(ROWS_PER_STRIP, (height,))[0], height), width)
    offsets, sizes = (tags.get(t) for t in ((TILE_OFFSETS, TILE_BYTES) if tiled else (STRIP_OFFSETS, STRIP_BYTES)))
    if AFFINE in tags:
        m = tags[AFFINE]
        transform = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif PIXEL_SCALE in tags and TIE_POINT in tags:
        (sx, sy), (i, j, _, x, y, *_) = tags[PIXEL_SCALE][:2], tags[TIE_POINT]
        transform = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    else:
        transform = Layout.transform
    keys = tags.get(GEO_KEYS, ())
    named = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    said: dict[int, str] = {}
    if METADATA in tags:
        for item in ElementTree.fromstring(tags[METADATA][0]).iter("Item"):
            if item.get("role") == "description":
                said[int(item.get("sample", 0))] = item.text or ""
    out = Layout(
        width, height, bands, f"{_KINDS[kinds.pop()]}{bits.pop() // 8}", block, tuple(map(float, transform)), named.get(PROJECTED_KEY, named.get(GEOGRAPHIC_KEY)),
        float(tags[NODATA][0]) if NODATA in tags else None, tuple(said.get(k, "") for k in range(bands)) if said else (), predictor, compression != 1, tags.get(PLANAR, (1,))[0] == 2, tiled, order, offsets or (), sizes or (),
    )
    if len(out.offsets) != len(out.sizes) or len(out.offsets) != out.across * out.down * (bands if out.separate else 1):
        raise TiffError("truncated: the directory lacks blocks")
    return out


def decoded(layout: Layout, data: bytes, rows: int, samples: int) -> np.ndarray:
    """Values of a block as (rows, columns, samples)."""
    dtype = np.dtype(layout.order + layout.dtype)
    wide = layout.block[1]
    size = rows * wide * samples * dtype.itemsize
    if layout.deflated:
        try:
            data = zlib.decompress(data)
        except zlib.error as problem:
            raise TiffError(f"broken block: {problem}") from problem
    if len(data) < size:
        raise TiffError(f"truncated: a block of {size} bytes has {len(data)}")
    raw = np.frombuffer(data, np.uint8, size)
    if layout.predictor == 3:
        summed = np.cumsum(raw.reshape(rows, -1, samples), axis=1, dtype=np.uint8)
        planes = summed.reshape(rows, dtype.itemsize, wide * samples)  # the highest byte first
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(rows, wide, samples).astype(dtype.newbyteorder("="))
    values = raw.view(dtype).reshape(rows, wide, samples).astype(dtype.newbyteorder("="))
    if layout.predictor == 2:
        kind = np.dtype(f"u{dtype.itemsize}")
        values = np.cumsum(values.view(kind), axis=1, dtype=kind).view(values.dtype)
    return values


def encoded(layout: Layout, values: np.ndarray) -> bytes:
    """Deflated block of values (rows, columns, samples), filled up to the block's size with the nodata value or 0."""
    dtype = np.dtype("<" + layout.dtype)
    high, wide = layout.block
    full = np.full((high, wide, layout.bands), 0 if layout.nodata is None else layout.nodata, dtype)
    full[: values.shape[0], : values.shape[1]] = values
    if layout.predictor == 3:
        planes = full.astype(dtype.newbyteorder(">")).reshape(high, -1).view(np.uint8).reshape(high, wide * layout.bands, dtype.itemsize).transpose(0, 2, 1)
        flat = np.ascontiguousarray(planes).reshape(high, -1, layout.bands)
        flat = np.concatenate([flat[:, :1], flat[:, 1:] - flat[:, :-1]], axis=1)
    elif layout.predictor == 2:
        flat = full.view(np.dtype(f"<u{dtype.itemsize}"))
        flat = np.concatenate([flat[:, :1], flat[:, 1:] - flat[:, :-1]], axis=1)
    else:
        flat = full
    return zlib.compress(np.ascontiguousarray(flat).tobytes(), 6)


def window(layout: Layout, read: Read, rows: tuple[int, int], columns: tuple[int, int], bands: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Blocks inside half-open ranges of rows and columns: first row, first column, values (rows, columns, chosen bands)."""
    rows, columns = (max(rows[0], 0), min(rows[1], layout.height)), (max(columns[0], 0), min(columns[1], layout.width))
    if rows[0] >= rows[1] or columns[0] >= columns[1]:
        return
    high, wide = layout.block
    plane = layout.across * layout.down
    for down in range(rows[0] // high, (rows[1] - 1) // high + 1):
        for across in range(columns[0] // wide, (columns[1] - 1) // wide + 1):
            k = down * layout.across + across
            tall = high if layout.tiled else min(high, layout.height - down * high)
            if layout.separate:
                got = np.concatenate([decoded(layout, _exactly(read, layout.offsets[k + b * plane], layout.sizes[k + b * plane]), tall, 1) for b in bands], axis=2)
            else:
                got = decoded(layout, _exactly(read, layout.offsets[k], layout.sizes[k]), tall, layout.bands)[:, :, bands]
            top, left = down * high, across * wide
            r0, r1, c0, c1 = max(rows[0], top), min(rows[1], top + high), max(columns[0], left), min(columns[1], left + wide)
            yield r0, c0, got[r0 - top : r1 - top, c0 - left : c1 - left]


def assembled(layout: Layout, blocks: list[bytes]) -> bytes:
    """A whole file of encoded blocks in order; one of 4 GB or more raises."""
    if len(blocks) != layout.across * layout.down:
        raise TiffError(f"{len(blocks)} blocks for {layout.across * layout.down} places")
    offsets, at = [], 8
    for block in blocks:
        offsets.append(at)
        at += len(block) + len(block) % 2
    bits, kind = int(layout.dtype[1:]) * 8, {"u": 1, "i": 2, "f": 3}[layout.dtype[0]]
    a, b, c, d, e, f = layout.transform
    short, long, double = "H", "I", "d"
    tags: list[tuple[int, str, list | bytes]] = [
        (WIDTH, long, [layout.width]), (HEIGHT, long, [layout.height]), (BITS, short, [bits] * layout.bands), (COMPRESSION, short, [8]), (PHOTOMETRIC, short, [1]),
        (SAMPLES, short, [layout.bands]), (PLANAR, short, [1]), (PREDICTOR, short, [layout.predictor]), (TILE_WIDTH, long, [layout.block[1]]), (TILE_HEIGHT, long, [layout.block[0]]),
        (TILE_OFFSETS, long, offsets), (TILE_BYTES, long, [len(x) for x in blocks]), (FORMAT, short, [kind] * layout.bands),
        (AFFINE, double, [a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]),
    ]
    if layout.bands > 1:
        tags.append((EXTRA, short, [0] * (layout.bands - 1)))
    if layout.epsg is not None:
        geographic = 4000 <= layout.epsg < 5000
        tags.append((GEO_KEYS, short, [1, 1, 0, 2, 1024, 0, 1, 2 if geographic else 1, GEOGRAPHIC_KEY if geographic else PROJECTED_KEY, 0, 1, layout.epsg]))
    if layout.descriptions:
        items = "".join(f'<Item name="DESCRIPTION" sample="{k}" role="description">{escape(text)}</Item>' for k, text in enumerate(layout.descriptions))
        tags.append((METADATA, "s", f"<GDALMetadata>{items}</GDALMetadata>".encode() + b"\0"))
    if layout.nodata is not None:
        tags.append((NODATA, "s", (repr(layout.nodata) if layout.nodata == layout.nodata else "nan").encode() + b"\0"))
    tags.sort(key=lambda t: t[0])
    codes = {"H": 3, "I": 4, "d": 12, "s": 2}
    extra = at + 2 + 12 * len(tags) + 4
    table, tail = b"", b""
    for tag, code, values in tags:
        raw = values if isinstance(values, bytes) else struct.pack(f"<{len(values)}{code}", *values)
        n = len(raw) if code == "s" else len(values)
        place = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", extra + len(tail))
        if len(raw) > 4:
            tail += raw + b"\0" * (len(raw) % 2)
        table += struct.pack("<HHI", tag, codes[code], n) + place
    if extra + len(tail) >= 1 << 32:
        raise TiffError("a file of 4 GB or more")
    body = b"".join(x + b"\0" * (len(x) % 2) for x in blocks)
    return struct.pack("<2sHI", b"II", 42, at) + body + struct.pack("<H", len(tags)) + table + b"\0\0\0\0" + tail
