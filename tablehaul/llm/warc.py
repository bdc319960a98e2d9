"""WARC files: writing them, and rewriting whole-file gzip streams record by record.

``write_archives`` puts one record per page into files that are each a single gzip stream,
the form that can't be read from the middle. ``normalise`` inflates such a file once, as a
stream, rewrites every record as a gzip member of its own, and writes a sidecar index of
offsets. ``read_records`` reads any record by its place in the index. One file is one task, no
task holds more than a record, and the offsets also come back as a DataFrame. A file gets a name
of its own in every attempt, and only the names that finished tasks report are used, so a
task that runs twice leaves an unused file, not a mixed one.

Defined results: a null payload is empty; of equal payloads of at least ``LEAST`` bytes the one
with the smallest page_id is a response (each row, if that page_id is there repeatedly), all others, null
ids among them, are revisits of it; if all ids are null, all are responses; a null url is
written as an empty target; an empty table gives no files.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehaul.llm.shared import stored, table
from tablehaul.session import fresh_dir

LEAST = 100
PIECE = 1 << 20
_FILES = "path string, records long, bytes long"
_INDEX = "path string, offset long, length long, record_type string, page_id long"


def filesystem(path: str):
    """The file system of a path in the shared folder, as tasks see it, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if path.startswith("s3a:"):
        path = "s3:" + path[4:]
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _target(url: str | None) -> str:
    return quote(url or "", safe=":/?#[]@!$&'()*+,;=%-._~")


def build(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record. A revisit names its response and the payload's size, and holds no payload."""
    http = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]
    block = b"\r\n".join(http) + b"\r\n\r\n" + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_target(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_id(refers_to, digest)}",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def inflate(read, piece: int = PIECE) -> Iterator[bytes]:
    """Bytes of a gzip stream of one or more members, a bounded piece at a time; a cut stream is an error."""
    member = None
    while data := read(piece):
        while data:
            member = member or zlib.decompressobj(31)
            out = member.decompress(data, 4 * piece)
            if out:
                yield out
            data = member.unused_data if member.eof else member.unconsumed_tail
            if member.eof:
                member = None
        while member is not None and (out := member.decompress(b"", 4 * piece)):
            yield out
    if member is not None:
        raise ValueError("the gzip stream ends early")


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Each record's headers and its bytes, from pieces cut anywhere."""
    held = bytearray()
    more = True

    def fill(n: int) -> bool:
        nonlocal more
        parts = []
        have = len(held)
        while more and have < n:
            piece = next(pieces, None)
            if piece is None:
                more = False
            else:
                parts.append(piece)
                have += len(piece)
        held.extend(b"".join(parts))
        return len(held) >= n

    while True:
        end = held.find(b"\r\n\r\n")
        seen = 0
        while end < 0 and fill(len(held) + 1):
            end = held.find(b"\r\n\r\n", max(seen - 3, 0))
            seen = len(held)
        if end < 0:
            if held.strip():
                raise ValueError("the file ends inside a record's headers")
            return
        fields = headers(bytes(held[:end]))
        size = end + 4 + int(fields["content-length"]) + 4
        if not fill(size):
            raise ValueError("the file ends inside a record")
        yield fields, bytes(held[:size])
        del held[:size]


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """pages: page_id, url, payload, digest, refers_to. Each partition becomes one gzip stream; returns path, records, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        sink = path = None
        count = size = 0
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, payload, digest, refers_to = (column[row].as_py() for column in batch.columns)
                if sink is None:
                    store.create_dir(root, recursive=True)
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    sink = store.open_output_stream(path, compression=None)
                count += 1
                size += sink.write(packer.compress(build(page_id, url, payload, digest, refers_to)))
        if sink is not None:
            size += sink.write(packer.flush())
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{path.rsplit('/', 1)[1]}"], "records": [count], "bytes": [size]})

    return stored(pages.mapInArrow(run, _FILES), "warc-files")


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """files: path of gzip streams. Returns the index: path (of the new file), offset, length, record_type, page_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store.create_dir(root, recursive=True)
                name = f"{uuid.uuid4().hex}.warc.gz"
                source, at = filesystem(path)
                index, offset = [], 0
                with source.open_input_stream(at, compression=None) as stream, store.open_output_stream(f"{root}/{name}", compression=None) as sink, store.open_output_stream(f"{root}/{name}.index") as side:
                    for fields, record in records(inflate(stream.read)):
                        packer = zlib.compressobj(3, zlib.DEFLATED, 31)
                        member = packer.compress(record) + packer.flush()
                        sink.write(member)
                        page = fields.get("x-page-id")
                        entry = {"offset": offset, "length": len(member), "record_type": fields["warc-type"], "page_id": None if page is None else int(page)}
                        side.write(json.dumps(entry | {"id": fields["warc-record-id"]}).encode() + b"\n")
                        index.append({"path": f"{folder}/{name}"} | entry)
                        offset += len(member)
                        if len(index) >= 10_000:
                            yield pa.RecordBatch.from_pylist(index, _schema())
                            index = []
                if index:
                    yield pa.RecordBatch.from_pylist(index, _schema())

    n = max(files.count(), 1)
    return stored(files.select("path").repartition(n).mapInArrow(run, _INDEX), "warc-index")


def _schema() -> pa.Schema:
    return pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64())])


def read_records(index: DataFrame) -> DataFrame:
    """Each indexed record, read from its place: page_id, url, record_type, payload (null for a revisit), payload_bytes, payload_digest, refers_to.

    A response whose payload does not have the stated digest or size is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, path = None, None
        for batch in batches:
            out, held = [], 0
            for row in batch.to_pylist():
                if row["path"] != path:
                    if opened is not None:
                        opened.close()
                    path = row["path"]
                    store, at = filesystem(path)
                    opened = store.open_input_file(at)
                opened.seek(row["offset"])
                record = zlib.decompress(opened.read(row["length"]), 31)
                head, _, rest = record.partition(b"\r\n\r\n")
                fields = headers(head)
                payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")[2]
                revisit = fields["warc-type"] == "revisit"
                size, digest = int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha256:")
                if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"damaged payload in {path} at {row['offset']}")
                refers = fields.get("x-refers-to-page-id")
                page = fields.get("x-page-id")
                out.append(
                    (None if page is None else int(page), fields["warc-target-uri"], fields["warc-type"], None if revisit else payload, size, digest, None if refers is None else int(refers))
                )
                held += len(payload)
                if held > PIECE:
                    yield _read(out)
                    out, held = [], 0
            if out:
                yield _read(out)
        if opened is not None:
            opened.close()

    return index.select("path", "offset", "length").mapInArrow(
        run, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
    )


def _read(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())
    names = ("page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=list(names))


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """page_id, url, payload, digest, refers_to: what ``write_archives`` takes."""
    payload = F.coalesce(pages[html_col].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    # Only digests and ids are shuffled to find the repeated payloads, counted before the shuffle.
    short = rows.where(F.octet_length("payload") >= least).select("digest", "page_id")
    repeated = short.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    joined = rows.join(repeated.select("digest", "first"), "digest", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def round_trip(spark: SparkSession, pages: DataFrame, **names: str) -> DataFrame:
    """Pages to archives, archives normalised, and every record read back."""
    files = write_archives(with_revisits(pages, **names), fresh_dir(spark, "warc-streams"))
    return read_records(normalise(files, fresh_dir(spark, "warc-records")))


def op7_normalised_warc(spark, sf_dir):
    return round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM m
"""
