"""WARC archives: write with an index first, then read back by coalesced byte ranges.

Writing yields, per record, the archive's path, offset, length, url and digest. That index is a table of its own, and
every read starts from it: the selected records are sorted by (path, offset), neighbours are coalesced into one byte
range, and each range is read once.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_path, small, stored, table

_IDS = uuid.UUID("8c1f0a52-6d0e-5a39-9b52-0d7f1c6f7a11")
#: Payloads below so many bytes are never stored as revisits.
LEAST_PAYLOAD = 1000
#: An archive is closed beyond so many bytes; ranges closer than GAP are read as one, up to MOST_RANGE.
MOST_ARCHIVE, GAP, MOST_RANGE = 1 << 30, 64 << 10, 8 << 20

INDEX_SCHEMA = "path string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_IDS, f'page/{page_id}')}>"


def encode_record(page_id, url, payload: bytes, digest: bytes, record_type: str, refers_to) -> bytes:
    """One record as a gzip member. A revisit carries the HTTP header only, and the digest and size of what it stands for."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if record_type == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url))
    if record_type == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to)}",
            f"X-Refers-To-Page: {refers_to}",
        ]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def decode_record(member: bytes) -> dict:
    """The record in a gzip member; raises ValueError where sizes or digests don't hold."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    response = fields["WARC-Type"] == "response"
    payload = block.partition(b"\r\n\r\n")[2] if response else None
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    if response and (hashlib.sha1(payload).digest() != digest or len(payload) != int(fields["X-Payload-Length"])):
        raise ValueError(f"payload differs from its digest in {fields['WARC-Record-ID']}")
    page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page")
    return {
        "page_id": page and int(page), "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": digest.hex(),
        "record_type": fields["WARC-Type"], "refers_to": refers and int(refers), "url": fields.get("WARC-Target-URI"), "payload": payload,
    }


def plan_records(pages: DataFrame, id_col="page_id", url_col="url", payload_col="html") -> DataFrame:
    """Which rows are stored and which revisit: page_id, url, html, digest, record_type, refers_to.

    Only digests, sizes and ids are aggregated (with partial aggregates, so a payload shared by a third of the rows
    is no hot task). What is shared goes to the rows while it is small, and payloads then stay where they are read.
    Beyond that bound both are shuffled: payloads that can't be revisits get a join key of their own row, and the join is
    one that adaptive execution splits where a digest is hot.
    """
    html = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    p = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"),
        F.sha1(F.encode(html, "UTF-8")).alias("digest"), F.octet_length(html).cast("long").alias("n"),
    )
    shared = (
        p.where(F.col("n") >= LEAST_PAYLOAD).groupBy(F.col("digest").alias("_key"), F.col("n").alias("_n"))
        .agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    )
    shared = small(stored(shared.drop("_copies"), "warc-shared"), 80)
    own = F.concat(F.lit("row "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(" "), F.coalesce(F.col("url"), F.lit("")))
    keyed = p.withColumn("_key", F.when(F.col("n") >= LEAST_PAYLOAD, F.col("digest")).otherwise(own)).withColumn("_n", F.col("n"))
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return keyed.join(shared, ["_key", "_n"], "left").select(
        "page_id", "url", "html", "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_first")).alias("refers_to"),
    )


def _writer(directory: str):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(directory)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, digest, kind, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "record_type", "refers_to"))):
                    if out is not None and at >= MOST_ARCHIVE:
                        out.close()
                        out = None
                    if out is None:
                        # a name of its own for each attempt: the index has the paths of committed tasks only
                        name, at = f"records-{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    data = encode_record(page_id, url, html.encode("utf-8"), bytes.fromhex(digest), kind, refers)
                    out.write(data)
                    rows.append((f"{directory}/{name}", at, len(data), url, digest, page_id, kind))
                    at += len(data)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()))],
                        ["path", "offset", "length", "url", "digest", "page_id", "record_type"],
                    )
        finally:
            if out is not None:
                out.close()

    return write


def write_archives(pages: DataFrame, directory: str | None = None, **columns) -> DataFrame:
    """Write the archives and return their index (see INDEX_SCHEMA), itself stored in the shared folder.

    directory: a folder that all executors reach (any file system pyarrow can open); made in the shared folder if
    not given. The archives are written once, here; a task that is run again writes a file of another name, and only
    files of tasks whose index rows were committed are in the index.
    """
    spark = pages.sparkSession
    directory = directory or shared_path(spark, "warc")
    fs, root = _filesystem(directory)
    fs.create_dir(root, recursive=True)
    return stored(plan_records(pages, **columns).mapInArrow(_writer(directory), INDEX_SCHEMA), "warc-index")


def _read_ranges(batches: Iterable[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    opened: tuple[str, object] = ("", None)

    def read(run: list[tuple[str, int, int]]) -> pa.RecordBatch:
        nonlocal opened
        path, first = run[0][:2]
        if opened[0] != path:
            if opened[1] is not None:
                opened[1].close()
            fs, p = _filesystem(path)
            opened = (path, fs.open_input_file(p))
        data = opened[1].read_at(run[-1][1] + run[-1][2] - first, first)
        found = [decode_record(data[o - first : o - first + n]) for _, o, n in run]
        if not with_payload:
            for r in found:
                r["payload"] = None
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in zip(names, types)], names)

    run: list[tuple[str, int, int]] = []
    for batch in batches:
        for item in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length"))):
            if run and (item[0] != run[0][0] or item[1] - (run[-1][1] + run[-1][2]) > GAP or item[1] + item[2] - run[0][1] > MOST_RANGE):
                yield read(run)
                run = []
            run.append(item)
    if run:
        yield read(run)
    if opened[1] is not None:
        opened[1].close()


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that the rows of an index stand for (RECORD_SCHEMA), verified against their digests.

    The rows are range-partitioned and sorted by (path, offset), so that a task reads each archive forwards and
    neighbours as one range.
    """
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = index.select("path", "offset", "length").repartitionByRange(n, "path", "offset").sortWithinPartitions("path", "offset")
    return ordered.mapInArrow(lambda batches: _read_ranges(batches, with_payload), RECORD_SCHEMA)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record, and all archives read back.

    Null html: the empty payload. Null url: a record without target URI. Null page_id: loses to any other; equal
    payloads that all have null ids are all responses. Rows that repeat the largest page_id of their payload are all
    responses. Empty table: no archive, no row. Very long payloads are one record, read as one range. Other columns of
    the input are ignored.
    """
    index = write_archives(table(spark, sf_dir, "pages"))
    return read_records(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY d, n) AS m FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> m THEN m END AS refers_to
FROM w
"""
