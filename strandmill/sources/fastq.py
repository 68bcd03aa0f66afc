"""FASTQ as a Spark data source: ``spark.read.format("fastq").load(path)``.

Plain files are read in byte ranges that start at records, block-compressed ones (BGZF) in ranges of blocks; other gzipped
ones, which can't be split, as one range each.
read_index sorts records as the files have them: the range's number, then the record's number in it.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandmill.sources import bgzf

SCHEMA = "read_index long, read_id string, sequence string, quality string, path string"
#: Bytes of a range; records of a range are numbered below 2**RECORD_BITS.
RANGE, RECORD_BITS = 64 << 20, 36


def open_binary(path: str):
    """A file to read: through pyarrow where the path is a URI, else on this machine."""
    if "://" in path:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return open(path, "rb")


def file_size(path: str) -> int:
    if "://" in path:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return system.get_file_info(inner).size
    return Path(path).stat().st_size


class FastqError(ValueError):
    """A record that is no FASTQ."""


def parse_records(handle, first_number: int = 1, stop: int | None = None) -> Iterator[tuple[str, str, str]]:
    """(id, sequence, quality) of strict four-line records, from the handle's place on; stop: start none from there."""
    number = first_number
    while stop is None or handle.tell() < stop:
        header = handle.readline()
        if not header:
            return
        name = header.decode("utf-8").strip()
        if not header.startswith(b"@"):
            raise FastqError(f"Malformed FASTQ header at record #{number}: {name!r}")
        sequence, plus, quality = handle.readline(), handle.readline(), handle.readline()
        if not (sequence and plus and quality):
            raise FastqError(f"Malformed FASTQ record #{number}: incomplete 4-line record for {name}")
        if not plus.startswith(b"+"):
            raise FastqError(f"Malformed FASTQ record for {name}")
        seq, q = (x.rstrip(b"\r\n").decode("utf-8") for x in (sequence, quality))
        if len(seq) != len(q):
            raise FastqError(f"Malformed FASTQ record #{number} for {name}: sequence and quality lengths differ")
        yield name[1:], seq, q
        number += 1


def next_record(handle, at: int) -> int:
    """The first record's place from ``at`` on.

    ``@`` may start a quality line too: a record is a line with ``@``, two lines on one with ``+``, and between and
    after them lines of one length, followed by the file's end or another ``@``.
    """
    handle.seek(at)
    if at:
        handle.seek(at - 1)
        handle.readline()
    start = handle.tell()
    lines = [handle.readline() for _ in range(9)]
    for k in range(5):
        a, b, c, d = lines[k : k + 4]
        after = lines[k + 4]
        if a.startswith(b"@") and c.startswith(b"+") and len(b.rstrip(b"\r\n")) == len(d.rstrip(b"\r\n")) and (not after or after.startswith(b"@")):
            return start + sum(map(len, lines[:k]))
    return start


def first_in_blocks(reader: bgzf.BlockReader) -> int:
    """The place of the first record after a block's first line, which may be cut, as :func:`next_record` tells them; the end if there is none."""
    reader.readline()
    places, lines = [reader.tell()], []
    for _ in range(9):
        lines.append(reader.readline())
        places.append(reader.tell())
    for k in range(5):
        a, b, c, d, after = lines[k : k + 5]
        if a.startswith(b"@") and c.startswith(b"+") and d and len(b.rstrip(b"\r\n")) == len(d.rstrip(b"\r\n")) and (not after or after.startswith(b"@")):
            return places[k]
    return places[0] if lines[-1] else places[-1]


class _Range(InputPartition):
    def __init__(self, number: int, path: str, lo: int, hi: int | None, size: int | None = None):
        super().__init__(number)
        self.number, self.path, self.lo, self.hi, self.size = number, path, lo, hi, size


def byte_ranges(paths: list[str], size: int, compressed) -> list[_Range]:
    """Ranges of files; of those that compressed() holds for only where they are in blocks, with the file's size."""
    out: list[_Range] = []
    for path in paths:
        n, blocks = file_size(path), None
        if compressed(path):
            with open_binary(path) as raw:
                blocks = n if bgzf.is_bgzf(raw) else None
            if blocks is None:
                out.append(_Range(len(out), path, 0, None))
                continue
        for lo in range(0, max(n, 1), size):
            out.append(_Range(len(out), path, lo, min(n, lo + size), blocks))
    return out


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], size: int):
        self.paths, self.size = paths, size

    def partitions(self):
        return byte_ranges(self.paths, self.size, lambda path: path.endswith(".gz"))

    def read(self, part: _Range):
        base = part.number << RECORD_BITS
        with open_binary(part.path) as raw:
            if part.hi is None:
                records = parse_records(io.BufferedReader(gzip.GzipFile(fileobj=raw)))
            elif part.size is not None:
                records = bgzf.records(raw, part.lo, part.hi, part.size, first_in_blocks, lambda reader, stop: parse_records(reader, stop=stop))
            else:
                lo = next_record(raw, part.lo) if part.lo else 0
                raw.seek(lo)
                records = parse_records(raw, stop=part.hi)
            for k, (name, sequence, quality) in enumerate(records):
                yield base + k, name, sequence, quality, part.path


class FastqSource(DataSource):
    """Options: path (or several joined by newlines), rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"].split("\n"), int(self.options.get("rangebytes") or self.options.get("rangeBytes") or RANGE))


def read_fastq(spark: SparkSession, *paths: str, range_bytes: int = RANGE) -> DataFrame:
    """The reads of FASTQ files, gzipped if they end in ``.gz``, in the files' order by read_index. ValueError: no such file."""
    for path in map(str, paths):
        if "://" not in path and not Path(path).is_file():
            raise ValueError(f"There is no FASTQ file at {path}")
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").option("rangeBytes", range_bytes).load("\n".join(map(str, paths)))


def spread(df: DataFrame) -> DataFrame:
    """A scan's rows over all cores, where it has fewer partitions than there are (a gzipped file has one).

    Only for scans, whose partitions are known without running anything.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def list_fastq(source: str | Path, pattern: str = "*.fastq*") -> list[Path]:
    """The files of a folder that match, or those that a text file lists, one a line, relative to it."""
    source = Path(source)
    if source.is_dir():
        return sorted(source.glob(pattern))
    if not source.is_file():
        raise ValueError(f"There is no folder and no list of files at {source}")
    listed = (line.strip() for line in source.read_text(encoding="utf-8").splitlines())
    return [Path(x) if Path(x).is_absolute() else source.parent / x for x in listed if x]
