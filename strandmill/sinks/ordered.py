"""One named file of many rows: parts written by all executors in order, then put together by the Hadoop file system.

Rows are dealt to tasks by ranges of their order and sorted there; a task writes its part and tells its name, rows and bytes,
which is all that reaches the driver. Parts of an attempt that didn't count have names of their own and are deleted with
the folder. Compressed parts are BGZF, whose blocks may follow one another and can be read in ranges again.
"""

from __future__ import annotations

import struct
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text in a block of BGZF, which must be below 2**16 compressed.
BLOCK = 0xFF00
# The block without text that ends a BGZF file.
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def block(data: bytes, level: int = 6) -> bytes:
    """A gzip member of its own, whose extra field tells its length."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    if len(body) > 0xFFFF - 26:
        return block(data, 0) if level else block(data[: len(data) // 2], 6) + block(data[len(data) // 2 :], 6)
    return struct.pack("<4BIBBH2sHH", 31, 139, 8, 4, 0, 0, 255, 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def in_blocks(pieces: Iterable[bytes]) -> Iterator[bytes]:
    held = bytearray()
    for p in pieces:
        held += p
        while len(held) >= BLOCK:
            yield block(bytes(held[:BLOCK]))
            del held[:BLOCK]
    if held:
        yield block(bytes(held))


def open_to_write(path: str):
    if "://" in path:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return system.open_output_stream(inner)
    return open(path, "wb")


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, without files of checksums beside local ones, and Hadoop's form of the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path if "://" in path else Path(path).absolute().as_uri())
    system = p.getFileSystem(spark._jsc.hadoopConfiguration())
    system.setWriteChecksum(False)
    return system, p


def shared_folder(spark: SparkSession, beside: str | None = None) -> str:
    """A name for a new folder that all executors see: in the session's ``spark.checkpoint.dir``, or else beside a target.

    Without either, a local session gets a temporary folder; on a cluster that is an error.
    """
    shared = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = shared.get() if shared.isDefined() else spark.sparkContext.getConf().get("spark.checkpoint.dir") or beside
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="strandmill-")
    if base.startswith("file:"):
        base = "/" + base[5:].lstrip("/")
    return f"{base}/parts-{uuid.uuid4().hex}"


def make_folder(spark: SparkSession, path: str) -> None:
    system, inner = _hadoop(spark, path)
    system.mkdirs(inner)


def write_file(df: DataFrame, order: list[str], target: str | Path, texts: Callable[[pa.RecordBatch], Iterable[bytes]], head: bytes = b"", compress: bool = False, made: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """The rows' texts, in the given order, as one file; how many rows. texts: the texts of a batch's rows.

    made: what texts takes, row by row from the dealt and sorted rows. What is worked out before rows are dealt is worked
    out twice, as their ranges are found first, and is exchanged.
    """
    spark, target = df.sparkSession, str(target)
    folder = shared_folder(spark, target.rpartition("/")[0] or ".")
    make_folder(spark, folder)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, size = TaskContext.get().partitionId(), 0, 0
        path = f"{folder}/{number:06d}-{uuid.uuid4().hex}"

        def pieces() -> Iterator[bytes]:
            nonlocal rows
            for b in batches:
                rows += b.num_rows
                yield from texts(b)

        with open_to_write(path) as out:
            for piece in in_blocks(pieces()) if compress else pieces():
                out.write(piece)
                size += len(piece)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (number, path, rows, size)], ["number", "path", "rows", "size"])

    try:
        # with a number of its own the engine doesn't join parts whose rows are small until they are made
        parts = [max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)] if made else []
        dealt = df.repartitionByRange(*parts, *order).sortWithinPartitions(*order)
        done = (made(dealt) if made else dealt).mapInArrow(write, "number long, path string, rows long, size long").collect()
        concatenate(spark, [r.path for r in sorted(done)], target, (block(head) if compress and head else head), END_BLOCK if compress else b"")
        return sum(r.rows for r in done)
    finally:
        system, inner = _hadoop(spark, folder)
        system.delete(inner, True)


def concatenate(spark: SparkSession, parts: list[str], target: str, head: bytes = b"", tail: bytes = b"") -> None:
    """Files one after the other as one, streamed by the JVM."""
    system, path = _hadoop(spark, target)
    copy, out = spark._jvm.org.apache.hadoop.io.IOUtils, system.create(path, True)
    try:
        out.write(bytearray(head))
        for part in parts:
            source, p = _hadoop(spark, part)
            opened = source.open(p)
            try:
                copy.copyBytes(opened, out, 1 << 20, False)
            finally:
                opened.close()
        out.write(bytearray(tail))
    finally:
        out.close()
