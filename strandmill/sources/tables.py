"""SAM and BAM tags, whitelists, and records held in memory."""

from __future__ import annotations

import gzip
import math
import struct
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from strandmill.operators.tags import parse_tags
from strandmill.sources import bgzf
from strandmill.sources.fastq import RANGE, byte_ranges, open_binary

#: The sizes of BAM's numeric tag types and their struct formats.
_NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Records of a SAM text: one column ``tags``; header lines and lines of fewer than 11 fields are left out."""
    fields = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").startswith("@")).select(fields.alias("f")).where(F.size("f") >= 11)
    return lines.select(parse_tags(F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0)))).alias("tags"))


def _length(tag: str, value):
    """A length in ``pt`` that is given as a float is cut to a whole number, as its type isn't known later."""
    return int(value) if tag == "pt" and isinstance(value, float) and math.isfinite(value) else value


def bam_tags(data: bytes) -> dict[str, str]:
    """Tags of one BAM record's tail, values as text."""
    tags, at = {}, 0
    while at < len(data):
        tag, kind = data[at : at + 2].decode("ascii"), chr(data[at + 2])
        at += 3
        if kind in _NUMBERS:
            (value,) = struct.unpack_from("<" + _NUMBERS[kind], data, at)
            at += struct.calcsize("<" + _NUMBERS[kind])
            value = _length(tag, value)
        elif kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind in "ZH":
            end = data.index(0, at)
            value, at = data[at:end].decode("utf-8", "replace"), end + 1
        elif kind == "B":
            item = "<" + _NUMBERS[chr(data[at])]
            (n,) = struct.unpack_from("<i", data, at + 1)
            size = struct.calcsize(item)
            value = ",".join(str(struct.unpack_from(item, data, at + 5 + k * size)[0]) for k in range(n))
            at += 5 + n * size
        else:
            raise ValueError(f"BAM tag {tag}: unknown type {kind!r}")
        tags[tag] = str(value)
    return tags


def _take(handle, n: int) -> bytes:
    data = handle.read(n)
    if len(data) < n:
        raise ValueError("truncated BAM file")
    return data


def skip_header(handle) -> None:
    if _take(handle, 4) != b"BAM\1":
        raise ValueError("not a BAM file")
    _take(handle, struct.unpack("<i", _take(handle, 4))[0])
    for _ in range(struct.unpack("<i", _take(handle, 4))[0]):
        _take(handle, struct.unpack("<i", _take(handle, 4))[0] + 4)


def _tail(body: bytes) -> bytes:
    name, cigar, length = body[8], struct.unpack_from("<H", body, 12)[0], struct.unpack_from("<i", body, 16)[0]
    return body[32 + name + 4 * cigar + (length + 1) // 2 + length :]


def bam_records(handle, stop: int | None = None) -> Iterator[dict[str, str]]:
    """The tags of every record, mapped or not, from the handle's place on; stop: start none from there."""
    while stop is None or handle.tell() < stop:
        if not (head := handle.read(4)):
            return
        yield bam_tags(_tail(_take(handle, struct.unpack("<i", head)[0])))


#: Most bytes of a record, and records in a row that must look like ones.
LARGEST_RECORD, ALIKE = 1 << 28, 3


def _looks_like_record(body: bytes) -> bool:
    """Whether numbers, name, lengths and tags fit together."""
    reference, place, name, cigar, length, mate, mate_place = (*struct.unpack_from("<iiB", body), *struct.unpack_from("<H2xiii", body, 12))
    if min(reference, place, mate, mate_place) < -1 or not name or length < 0 or 32 + name + 4 * cigar + (length + 1) // 2 + length > len(body):
        return False
    title = body[32 : 32 + name]
    if title[-1] or not all(33 <= c <= 126 for c in title[:-1]):
        return False
    try:
        tags = bam_tags(_tail(body))
    except (ValueError, KeyError, IndexError, struct.error):
        return False
    return all(len(t) == 2 and t.isalnum() for t in tags)


def first_in_blocks(reader: bgzf.BlockReader) -> int:
    """The place of the first record after a block's first byte: the first from which ALIKE records follow, or the file's end does.

    Starts are tried in a text that grows as records found in it turn out to be longer.
    """
    held = bytearray()

    def have(n: int) -> bool:
        while len(held) < n:
            block, rest = reader.tell(), len(reader.text) - reader.at
            if not (part := reader.read(rest)):
                return False
            starts.append((len(held), block))
            held.extend(part)
        return True

    starts: list[tuple[int, int]] = []
    at = 1
    while have(at + 4):
        k, seen = at, 0
        while seen < ALIKE and have(k + 4):
            n = struct.unpack_from("<i", held, k)[0]
            if not 33 <= n <= LARGEST_RECORD or not have(k + 4 + min(n, 32)) or not have(k + 4 + n) or not _looks_like_record(bytes(held[k + 4 : k + 4 + n])):
                break
            k, seen = k + 4 + n, seen + 1
        if seen == ALIKE or seen and k == len(held) and not have(k + 1):
            begin, block = next((b, p) for b, p in reversed(starts) if b <= at)
            return block + at - begin
        at += 1
    return reader.tell()


#: A header without text and without references.
HEADER = b"BAM\1" + bytes(8)


def unmapped_record(name: str, tags: Mapping[str, str | int]) -> bytes:
    """A BAM record without bases, whose tags are texts or whole numbers."""
    title = name.encode() + b"\0"
    tail = b"".join(k.encode() + (b"i" + struct.pack("<i", v) if isinstance(v, int) else b"Z" + v.encode() + b"\0") for k, v in tags.items())
    body = struct.pack("<iiBBHHHiiii", -1, -1, len(title), 0, 0, 0, 4, 0, -1, -1, 0) + title + tail
    return struct.pack("<i", len(body)) + body


class _BamReader(DataSourceReader):
    def __init__(self, paths: list[str], size: int):
        self.paths, self.size = paths, size

    def partitions(self):
        return byte_ranges(self.paths, self.size, lambda path: True)

    def read(self, part):
        def parsed(reader, stop):
            if part.lo == 0:
                skip_header(reader)
            return bam_records(reader, stop)

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.map_(pa.string(), pa.string()))], ["tags"])

        with open_binary(part.path) as raw:
            if part.size is None:
                raw.seek(0)
                records = parsed(gzip.GzipFile(fileobj=raw), None)
            else:
                records = bgzf.records(raw, part.lo, part.hi, part.size, first_in_blocks, parsed)
            rows = []
            for tags in records:
                rows.append(list(tags.items()))
                if len(rows) == 10_000:
                    yield batch(rows)
                    rows = []
            yield batch(rows)


class BamSource(DataSource):
    """Options: path (or several joined by newlines), rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "bamtags"

    def schema(self) -> str:
        return "tags map<string,string>"

    def reader(self, schema) -> _BamReader:
        return _BamReader(self.options["path"].split("\n"), int(self.options.get("rangebytes") or self.options.get("rangeBytes") or RANGE))


def read_bam(spark: SparkSession, *paths: str, range_bytes: int = RANGE) -> DataFrame:
    """Records of BAM files, in ranges of their blocks: one column ``tags``. A file that isn't in blocks is one task."""
    spark.dataSource.register(BamSource)
    return spark.read.format("bamtags").option("rangeBytes", range_bytes).load("\n".join(map(str, paths)))


def tag_records(spark: SparkSession, records: Iterable[Mapping]) -> DataFrame:
    """Records from memory."""
    return spark.createDataFrame([({k: str(_length(k, v)) for k, v in r.items()},) for r in records], "tags map<string,string>")


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    """The distinct barcodes of a text, upper case; blank lines and lines that start with # are left out."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    found = lines.select(F.upper(F.trim(F.regexp_replace("value", r"\s+", " "))).alias("barcode")).where("barcode <> ''").distinct()
    if found.isEmpty():
        raise ValueError(f"Barcode whitelist is empty: {path}")
    return found
