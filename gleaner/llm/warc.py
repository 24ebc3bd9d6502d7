"""Web archives: writing, and normalising whole-file gzip to a member per record.

`write` puts records into archives that are one gzip stream each, as some
crawlers leave them; such an archive can only be read from its start.
`normalise` inflates each stream once and writes every record as a gzip member
of its own, and beside the archive an index with the offset and length of each
member.  `read` goes by the index: a record is inflated on its own.

Payloads of at least `smallest` bytes that are equal are stored once: the
record with the largest page id is the response, the others are revisits that
name it.  Rows that repeat the largest id with the same payload are responses,
too; null ids count as smallest, and a payload that only null ids have is kept
as responses.  A null page is an empty payload.  A null url leaves the header
out; control characters in it are escaped.  An empty table gives no archives.

Tasks write new files under names of their own, and only the names that a
successful task handed on are read, so a lost task can run again.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import durable, whole
from gleaner.llm.texts import Unpack, packed
from gleaner.session import checkpoint_dir

SMALLEST = 0
RAW_LEVEL = 1
LEVEL = 6
_CHUNK = 1 << 20
_GZIP = 31
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: When the pages were fetched is not known.
DATE = "1970-01-01T00:00:00Z"
_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def folder(spark) -> str:
    """A new folder on the storage that all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"


def _open(root: str) -> tuple[fs.FileSystem, str]:
    files, path = fs.FileSystem.from_uri(root)
    files.create_dir(path, recursive=True)
    return files, path


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# -- records --------------------------------------------------------------------


def record(
    page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE
) -> bytes:
    """One record, headers and block, uncompressed.

    Every record has an id of its own, also where rows repeat; the page id, and
    of a revisit that of its response, are headers beside it.
    """
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"X-Refers-To-Page: {refers_to}", f"WARC-Refers-To-Date: {date}", f"WARC-Profile: {_REVISIT}"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return dict(line.split(": ", 1) for line in lines[1:] if line)


def inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of a gzip stream of one member or several."""
    stream = zlib.decompressobj(_GZIP)
    for chunk in chunks:
        while chunk:
            yield stream.decompress(chunk)
            chunk = stream.unused_data
            if stream.eof and chunk:
                stream = zlib.decompressobj(_GZIP)
    if not stream.eof:
        raise ValueError("the archive ends within a gzip member")


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Cut inflated bytes into records; at most one record and a chunk are held."""
    held = bytearray()
    chunks = iter(chunks)

    def until(have) -> bool:
        while not have():
            more = next(chunks, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while until(lambda: b"\r\n\r\n" in held):
        ends = held.index(b"\r\n\r\n") + 4
        size = ends + int(headers(bytes(held[: ends - 4]))["Content-Length"]) + 4
        if not until(lambda: len(held) >= size):
            break
        yield bytes(held[:size])
        del held[:size]
    if held:
        raise ValueError("the archive ends within a record")


# -- archives -------------------------------------------------------------------


def planned(pages: DataFrame, smallest: int = SMALLEST) -> DataFrame:
    """Which record each page becomes: `packed` payload, `revisit` and `refers_to`."""
    html = whole("html")
    rows = pages.select(
        "page_id", "url", F.sha1(html.cast("binary")).alias("sha1"), (F.octet_length(html) >= smallest).alias("large"), "html"
    )
    first = (
        rows.where("large")
        .groupBy("sha1")
        .agg(F.max("page_id").alias("first"), F.count("*").alias("rows"))
        .where("rows > 1")
        .drop("rows")
    )
    revisit = F.col("large") & F.coalesce(F.col("first") != F.coalesce("page_id", F.col("first") - 1), F.lit(False))
    return (
        packed(rows)
        .join(first, "sha1", "left")
        .withColumn("revisit", revisit)
        .select("page_id", "url", "packed", F.when(F.col("revisit"), F.col("first")).alias("refers_to"), "revisit")
    )


def write(plan: DataFrame, root: str, level: int = RAW_LEVEL, date: str = DATE) -> DataFrame:
    """Write one monolithic archive per partition; (archive, records) of each.  `date` is that of all records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, unpack = None, Unpack()
        for batch in batches:
            for row, payload in zip(batch.drop_columns("packed").to_pylist(), batch.column("packed")):
                if out is None:
                    files, path = _open(f"{root}/whole")
                    name, count = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(f"{path}/{name}", compression=None)
                    stream = zlib.compressobj(level, zlib.DEFLATED, _GZIP)
                one = record(row["page_id"], row["url"], unpack(payload), row["refers_to"], row["revisit"], date)
                out.write(stream.compress(one))
                count += 1
        if out is not None:
            out.write(stream.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [f"{root}/whole/{name}"], "records": [count]})

    return durable(plan.mapInArrow(run, "archive string, records long"))


def _chunks(archive: str) -> Iterator[bytes]:
    files, path = fs.FileSystem.from_uri(archive)
    with files.open_input_stream(path, compression=None) as stream:
        while chunk := stream.read(_CHUNK):
            yield chunk


def normalise(archives: DataFrame, root: str, level: int = LEVEL) -> DataFrame:
    """Rewrite archives with a member per record and an index beside each; (archive, index, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                files, path = _open(f"{root}/members")
                name, at, count = uuid.uuid4().hex, 0, 0
                with (
                    files.open_output_stream(f"{path}/{name}.warc.gz", compression=None) as out,
                    files.open_output_stream(f"{path}/{name}.idx", compression=None) as index,
                ):
                    for one in records(inflated(_chunks(source))):
                        squeeze = zlib.compressobj(level, zlib.DEFLATED, _GZIP)
                        member = squeeze.compress(one) + squeeze.flush()
                        out.write(member)
                        index.write(json.dumps([at, len(member)]).encode() + b"\n")
                        at, count = at + len(member), count + 1
                base = f"{root}/members/{name}"
                yield pa.RecordBatch.from_pydict({"archive": [f"{base}.warc.gz"], "index": [f"{base}.idx"], "records": [count]})

    return durable(_one_each(archives).mapInArrow(run, "archive string, index string, records long"))


def _one_each(archives: DataFrame) -> DataFrame:
    """A task per archive or few: the list of names is short, its files are long."""
    spark = archives.sparkSession
    parts = max(1, min(archives.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return archives.repartition(parts)


def _page(number: str | None) -> int | None:
    return int(number) if number else None


def read(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, by the index.

    Payloads of responses are measured anew and held against their headers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = []
                files, path = fs.FileSystem.from_uri(row["archive"])
                lines = b"".join(_chunks(row["index"])).splitlines()
                with files.open_input_file(path) as stream:
                    for at, size in map(json.loads, lines):
                        stream.seek(at)
                        one = zlib.decompress(stream.read(size), _GZIP)
                        head, _, block = one.partition(b"\r\n\r\n")
                        named = headers(head)
                        found, length = named["WARC-Payload-Digest"].removeprefix("sha1:"), int(named["X-Payload-Length"])
                        if named["WARC-Type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2][:-4]
                            if (digest(payload), len(payload)) != (found, length):
                                raise ValueError(f"a payload differs from its header at {at} in {row['archive']}")
                        rows.append((_page(named.get("X-Page-ID")), length, found, named["WARC-Type"], _page(named.get("X-Refers-To-Page"))))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))]
                if rows:
                    yield pa.RecordBatch.from_arrays(columns, names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return _one_each(archives).mapInArrow(run, _RECORDS)
