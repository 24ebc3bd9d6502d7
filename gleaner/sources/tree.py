"""Listing and reading a source tree where the files are.

Spark's own file sources leave out every name that begins with a dot or an
underscore, so packages would lose their `__init__.py`; and they list folders
that are dropped afterwards.  Here tasks list folders: a task walks down from the
folders it is given, never opens a skipped one, and after a number of entries
hands the folders that are left back, which are dealt out anew.  Small trees take
one round, large ones fan out.  Links to folders are not followed.

Files are reached through pyarrow: local paths, and the schemes it knows (hdfs,
s3, gs, abfs).
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.joins import stack
from gleaner.session import checkpointed

#: Entries that a task lists before it hands folders back.
ENTRIES = 10_000
#: Bytes of content in a batch, and in a partition, of files that are read.
BATCH_BYTES = 32 << 20
PART_BYTES = 128 << 20


def system(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified root, and the path in it."""
    local = re.match(r"file:(?://)?(/.*)", root)
    if local or root.startswith("/"):
        return fs.LocalFileSystem(), local[1] if local else root
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", root))


def walk(files: fs.FileSystem, base: str, folder: str, skip: Sequence[str], entries: int = ENTRIES) -> Iterator[tuple[str, int | None]]:
    """(path below base, bytes) of the files in a folder; bytes are None for a folder that was not opened any more."""
    todo, seen, local = [folder], 0, isinstance(files, fs.LocalFileSystem)
    while todo:
        here = todo.pop()
        if seen >= entries:
            yield here, None
            continue
        for info in files.get_file_info(fs.FileSelector(f"{base}/{here}".rstrip("/") or "/")):
            seen += 1
            path = f"{here}/{info.base_name}".lstrip("/")
            if info.type == fs.FileType.File:
                yield path, info.size
            elif info.type == fs.FileType.Directory and info.base_name not in skip and not (local and os.path.islink(info.path)):
                todo.append(path)


def list_files(spark: SparkSession, root: str, skip: Sequence[str] = (), entries: int = ENTRIES) -> DataFrame:
    """(path below root, size) of all files outside of skipped folders."""
    skip = tuple(skip)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = system(root)
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                rows = list(walk(files, base, folder, skip, entries))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p for p, _ in rows], pa.string()), pa.array([s for _, s in rows], pa.int64())], names=["path", "size"]
                    )

    folders, levels = spark.createDataFrame([("",)], "path string"), []
    while True:
        found = checkpointed(folders.mapInArrow(run, "path string, size long"))
        levels.append(found.where("size IS NOT NULL"))
        folders = found.where("size IS NULL").select("path")
        left = folders.count()
        if not left:
            return stack(*levels)
        folders = folders.repartition(min(left, 4 * spark.sparkContext.defaultParallelism), "path")


def read_files(spark: SparkSession, root: str, listed: DataFrame) -> DataFrame:
    """listed(path, size, ...) with the `content` of every file; files are dealt out by size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = system(root)
        for batch in batches:
            at, held, size = 0, [], 0
            for i, path in enumerate(batch.column("path").to_pylist()):
                with files.open_input_stream(f"{base}/{path}", compression=None) as stream:
                    held.append(stream.read())
                size += len(held[-1])
                if size >= BATCH_BYTES or i + 1 == batch.num_rows:
                    columns = [*batch.slice(at, len(held)).columns, pa.array(held, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "content"])
                    at, held, size = i + 1, [], 0

    total = listed.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    least = min(total["files"], spark.sparkContext.defaultParallelism)
    parts = max(1, least, -(-total["bytes"] // PART_BYTES))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in listed.schema.fields)
    return listed.repartition(parts, "path").mapInArrow(run, f"{fields}, content binary")
