"""Operator 5: Zstandard-compressed WARC archives, written and read back.

An archive is a file ``*.warc.zst``: a skippable frame with the compression
dictionary, then one Zstandard frame per record.  Equal payloads of at least
``LEAST_BYTES`` are stored once; the record of the largest page is the response
and the others revisit it.

Writing tasks hold pages in a fixed order and name files by task, so a task that
runs again replaces its own files.  Reading loads whole archives (at most
about ``ARCHIVE_BYTES`` before compression) and checks every header and length.

Cases
* null html is an empty payload; null url is an empty target;
* rows with the same id and payload are all responses when they are the largest;
* a null id sorts below all others and is written as ``null``;
* extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.staging import new_path

LEAST_BYTES = 1000
ARCHIVE_BYTES = 8_000_000
DICTIONARY_BYTES = 16_384
#: Records of an archive on which its dictionary is trained, and bytes of each.
DICTIONARY_RECORDS, DICTIONARY_PREFIX = 256, 4_096
SALTS = 16

# Fixed values of the archive format.
SKIPPABLE_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class ArchiveError(ValueError):
    """An archive, a record or a length is not as the format demands."""


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    text = name.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "null" else int(text)


def record_bytes(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record; a revisit has the response's HTTP head, with the payload's length, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _name(page_id)),
        ("WARC-Target-URI", target),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields += [("WARC-Refers-To", _name(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def pack(records: list[bytes]) -> bytes:
    """An archive of ``records`` with a dictionary trained on its first ones, if they allow one."""
    trained = None
    samples = [r[:DICTIONARY_PREFIX] for r in records[:DICTIONARY_RECORDS]]
    if len(samples) >= 16:
        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8)
        except zstandard.ZstdError:  # too little or too uniform a sample; the format allows none
            trained = None
    out = io.BytesIO()
    if trained is not None:
        body = trained.as_bytes()
        out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
    coder = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True)
    for record in records:
        out.write(coder.compress(record))
    return out.getvalue()


def unpack(archive: bytes) -> Iterator[bytes]:
    """Records of an archive, one per frame."""
    view, at, trained = memoryview(archive), 0, None
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == SKIPPABLE_MAGIC:
        size = struct.unpack_from("<I", view, 4)[0]
        body = bytes(view[8 : 8 + size])
        if len(body) != size:
            raise ArchiveError("the dictionary frame is cut short")
        if body[:4] == FRAME_MAGIC:
            body = zstandard.ZstdDecompressor().decompress(body)
        trained, at = zstandard.ZstdCompressionDict(body), 8 + size
    coder = zstandard.ZstdDecompressor(dict_data=trained) if trained else zstandard.ZstdDecompressor()
    while at < len(view):
        frame, parts = coder.decompressobj(), []
        while not frame.eof:
            if at >= len(view):
                raise ArchiveError("a record's frame is cut short")
            fed = view[at : at + 16_384]
            parts.append(frame.decompress(fed))
            at += len(fed) - (len(frame.unused_data) if frame.eof else 0)
        yield b"".join(parts)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record, after checks of version, fields, length and end."""
    head, found, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] != VERSION:
        raise ArchiveError("no record head")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or name in fields:
            raise ArchiveError(f"bad header line {line[:60]!r}")
        fields[name] = value.strip()
    for name in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"):
        if name not in fields:
            raise ArchiveError(f"no {name}")
    size = int(fields["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ArchiveError("a record's length is not its Content-Length")
    return fields, rest[:size]


def summary(record: bytes) -> tuple[int | None, int, str, str, int | None]:
    """Page, payload length and digest, type and referred page of a record."""
    fields, block = parse(record)
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found:
        raise ArchiveError("no HTTP head")
    declared = next((int(line[15:]) for line in head.split(b"\r\n") if line[:15].lower() == b"content-length:"), None)
    kind = fields["WARC-Type"]
    scheme, _, text = fields.get("WARC-Payload-Digest", "").partition(":")
    if declared is None or scheme != "sha1":
        raise ArchiveError("no payload length or digest")
    digest = base64.b32decode(text).hex()
    if kind == "response":
        if declared != len(payload) or hashlib.sha1(payload).hexdigest() != digest:
            raise ArchiveError("a payload is not as long, or not the one, that its headers say")
    elif kind != "revisit" or payload or "WARC-Refers-To" not in fields:
        raise ArchiveError("neither a response nor a revisit")
    refers = _page(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return _page(fields["WARC-Record-ID"]), declared, digest, kind, refers


def _filesystem(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _writer(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _filesystem(path)
        store.create_dir(folder, recursive=True)
        part = TaskContext.get().partitionId()
        held: list[bytes] = []
        size = files = 0

        def close() -> pa.RecordBatch:
            nonlocal held, size, files
            name = f"{folder}/part-{part:06d}-{files:05d}.warc.zst"
            attempt = f"{folder}/_{uuid.uuid4().hex}.tmp"
            with store.open_output_stream(attempt) as out:
                out.write(pack(held))
            store.move(attempt, name)
            done = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64())], names=["file", "records"])
            held, size, files = [], 0, files + 1
            return done

        for batch in batches:
            ids, urls, pages, revisit, refers = (batch.column(k) for k in range(5))
            for i in range(batch.num_rows):
                payload = pages[i].as_py().encode()
                held.append(record_bytes(ids[i].as_py(), urls[i].as_py(), payload, refers[i].as_py(), revisit[i].as_py()))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
        if held:
            yield close()

    return run


def write(pages: DataFrame, path: str, *, id_column: str = "page_id", url: str = "url", html: str = "html") -> int:
    """Write an archive folder from ``pages``; returns the number of records."""
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_column).cast("long").alias("page"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("target"), body.alias("body"))
    keyed = rows.select("page", F.sha1(F.col("body").cast("binary")).alias("digest"), F.octet_length("body").alias("size")).filter(F.col("size") >= LEAST_BYTES).drop("size")
    groups = keyed.groupBy("digest").agg(F.max("page").alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(SALTS)).cast("int"))
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    revisits = salted.join(spread, ["digest", "salt"]).filter(~F.col("page").eqNullSafe(F.col("first"))).select(F.col("page").alias("r_page"), F.col("digest").alias("r_digest"), "first").distinct()
    joined = rows.join(revisits, F.col("page").eqNullSafe(F.col("r_page")) & (F.sha1(F.col("body").cast("binary")) == F.col("r_digest")), "left")
    laid = joined.select("page", "target", "body", F.col("r_digest").isNotNull().alias("revisit"), "first").sortWithinPartitions("page", "body", "target")
    written = laid.mapInArrow(_writer(path), "file string, records long")
    return written.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n")).first()["n"]


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for i in range(batch.num_rows):
            rows = [summary(r) for r in unpack(batch.column(0)[i].as_py())]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Checked records of all archives in a folder: page, payload length and digest, type and reference."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path)
    return files.select("content").mapInArrow(_reader, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = new_path(spark, "op5-archives")
    if write(pages, path, **columns) == 0:
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read(spark, path)
