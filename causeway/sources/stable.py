"""Compressed JSON lines whose files and bytes depend on the rows alone.

File borders are places in a total order, not tasks; lines have sorted keys and the
compressed stream no time.  So the same rows give equal files whatever the number of
partitions, and a task that runs again writes the same bytes.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators.order import placed
from causeway.sources.geotiff import opened
from causeway.staging import stage

_MANIFEST = "file string, rows long, content_sha256 string, file_sha256 string"


def write_stable_lines(rows: DataFrame, path: str, order: list[str], *, rows_per_file: int = 20_000) -> DataFrame:
    """Write ``rows`` sorted by ``order`` as ``part-000000.jsonl.gz`` and so on; returns ``(file, rows, content_sha256, file_sha256)``.

    NULL sorts first and is written as null; rows equal in ``order`` are sorted by
    their lines.  A file's rows must fit in a task.  ``path`` must hold no part yet;
    an empty table writes none.  Files appear under their names only when whole.
    """
    if rows_per_file < 1:
        raise ValueError("rows_per_file must be at least 1")
    system, inner = opened(path)
    if any(i.base_name.startswith("part-") for i in system.get_file_info(fs.FileSelector(inner, allow_not_found=True))):
        raise FileExistsError(f"{path} holds parts already")
    system.create_dir(inner, recursive=True)
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})
    keyed = rows.select(*[F.col(f"`{c}`").alias(f"o{k}") for k, c in enumerate(order)], line.alias("line"))
    ranked = placed(keyed, *[F.col(f"o{k}").asc_nulls_first() for k in range(len(order))], F.col("line").asc(), name="place")
    dealt = ranked.select(F.floor((F.col("place") - 1) / rows_per_file).alias("number"), "place", "line")

    def written(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        name = f"part-{table['number'][0].as_py():06d}.jsonl.gz"
        content = "".join(f"{text}\n" for text in table["line"].to_pylist()).encode()
        packed = gzip.compress(content, compresslevel=6, mtime=0)
        files, folder = opened(path)
        half = f"{folder}/.{name}-{uuid.uuid4().hex}"
        with files.open_output_stream(half) as sink:
            sink.write(packed)
        files.move(half, f"{folder}/{name}")
        return pa.table({"file": [name], "rows": pa.array([table.num_rows], pa.int64()), "content_sha256": [hashlib.sha256(content).hexdigest()], "file_sha256": [hashlib.sha256(packed).hexdigest()]})

    return stage(dealt.groupBy("number").applyInArrow(written, _MANIFEST), "stable-manifest")
