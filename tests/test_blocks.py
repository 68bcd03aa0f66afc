"""Block-compressed files read in ranges, and single files written in parts."""

import gzip
import io
import random
import struct

import pytest

from strandmill.sinks import files, ordered
from strandmill.sources import bgzf, fastq, tables


def blocks(data, rng, most=300):
    """The data as BGZF with blocks of many sizes, empty ones too."""
    out, at = [], 0
    while at < len(data):
        n = rng.choice([0, rng.randrange(1, most), most])
        out.append(ordered.block(data[at : at + n]))
        at += n
    return b"".join([*out, ordered.END_BLOCK])


def reads(rng, n):
    text = lambda k, of: "".join(rng.choice(of) for _ in range(k))
    return [(f"r{i} @+", text(k := rng.randrange(0, 80), "ACGT"), text(k, "@+I\x20")) for i in range(n)]


def bam(rng, n):
    out = [b"BAM\1", struct.pack("<i", 5), b"@HD\n\0", struct.pack("<i", 2)]
    out += [struct.pack("<i", 5) + name + struct.pack("<i", 1000) for name in (b"chr1\0", b"chr2\0")]
    want = []
    for i in range(n):
        name, length = f"read{i}".encode() + b"\0", rng.randrange(0, 60)
        tags = {"CR": "".join(rng.choice("ACGT") for _ in range(8)), "pt": str(rng.randrange(100))}
        tail = b"CRZ" + tags["CR"].encode() + b"\0ptC" + bytes([int(tags["pt"])])
        body = struct.pack("<iiBBHHHiiii", rng.choice([-1, 0, 1]), rng.randrange(-1, 900), len(name), 0, 0, 1, 4, length, -1, -1, 0) + name + struct.pack("<I", length << 4)
        body += bytes(rng.randrange(256) for _ in range((length + 1) // 2)) + bytes(rng.randrange(40) for _ in range(length)) + tail
        out.append(struct.pack("<i", len(body)) + body)
        want.append(tags)
    return b"".join(out), want


@pytest.mark.parametrize("size", [150, 700, 5000, 1 << 20])
def test_fastq_in_blocks_is_the_whole_file(spark, tmp_path, size):
    rng = random.Random(size)
    some = reads(rng, 150)
    (tmp_path / "a.fastq.gz").write_bytes(blocks("".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in some).encode(), rng))
    df = fastq.read_fastq(spark, str(tmp_path / "a.fastq.gz"), range_bytes=size)
    assert [tuple(r)[1:4] for r in df.orderBy("read_index").collect()] == some
    assert (df.rdd.getNumPartitions() > 3) == (size < 5000)


@pytest.mark.parametrize("size", [150, 900, 1 << 20])
def test_bam_in_blocks_is_the_whole_file(spark, tmp_path, size):
    rng = random.Random(size)
    data, want = bam(rng, 120)
    (tmp_path / "a.bam").write_bytes(blocks(data, rng))
    df = tables.read_bam(spark, str(tmp_path / "a.bam"), range_bytes=size)
    key = lambda t: (t["CR"], t["pt"])
    assert sorted((r.tags for r in df.collect()), key=key) == sorted(want, key=key)
    assert (df.rdd.getNumPartitions() > 3) == (size < 1000)


def test_damaged_files_are_told(spark, tmp_path):
    rng = random.Random(3)
    data = blocks("".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in reads(rng, 50)).encode(), rng)
    (tmp_path / "a.fastq.gz").write_bytes(data[: len(data) // 2])
    with pytest.raises(Exception, match="cut off|No BGZF|incomplete"):
        fastq.read_fastq(spark, str(tmp_path / "a.fastq.gz")).collect()


def test_block_reader_tells_places():
    text = b"".join(f"line {i}\n".encode() * (i % 3) for i in range(300))
    data = blocks(text, random.Random(4), 50)
    reader = bgzf.BlockReader(io.BytesIO(data), 0, len(data))
    places, lines = [], []
    while True:
        places.append(reader.tell())
        if not (line := reader.readline()):
            break
        lines.append(line)
    assert b"".join(lines) == text and places == sorted(set(places))
    for place, line in list(zip(places, lines))[::7]:
        reader.seek(place)
        assert reader.readline() == line


@pytest.mark.parametrize("compress", [False, True])
def test_one_file_of_many_parts(spark, tmp_path, compress):
    rng = random.Random(5)
    some = reads(rng, 400)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(some)], "read_index long, read_id string, sequence string, quality string").repartition(7)
    assert files.write_fastq_file(df, tmp_path, "x", compress) == 400
    path = tmp_path / f"x.fastq{'.gz' if compress else ''}"
    data = gzip.open(path).read() if compress else path.read_bytes()
    assert data == "".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in some).encode()
    assert [p.name for p in tmp_path.iterdir()] == [path.name]
    assert fastq.read_fastq(spark, str(path), range_bytes=2000).count() == 400
    assert files.write_fastq_file(df.limit(0), tmp_path, "none", compress) == 0
    assert (gzip.open if compress else open)(tmp_path / f"none.fastq{'.gz' if compress else ''}").read() in (b"", "")


def test_rows_are_made_after_they_are_dealt(spark, tmp_path):
    """What is written of a row is worked out once: the search for ranges sees only what rows are sorted by."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    keys = spark.createDataFrame([(k,) for k in random.Random(7).sample(range(5000), 2000)], "k long").repartition(3)
    n = ordered.write_file(keys, ["k"], tmp_path / "x", lambda b: (f"{k}\n".encode() for k in b.column("k").to_pylist()), made=lambda df: df.mapInArrow(counted, "k long"))
    assert [int(x) for x in (tmp_path / "x").read_text().split()] == sorted(r.k for r in keys.collect())
    assert n == made.value == 2000


def test_tags_of_customers_are_made_once(spark, tmp_path, monkeypatch):
    from strandmill.plans import registry

    spark.range(50, 350).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    dealt, write = [], registry.write_file
    monkeypatch.setattr(registry, "write_file", lambda df, *args, **options: dealt.append(df.columns) or write(df, *args, **options))
    (got,) = registry.block_tags(spark, str(tmp_path)).collect()
    assert dealt == [["c_custkey"]]
    n = lambda fits: sum(map(fits, range(50, 350)))
    assert got.asDict() == {"total_reads": 300, "CR": n(lambda k: k % 7 > 0), "CB": n(lambda k: k % 3 > 0), "CY": 0, "UR": 300, "UB": 150, "UY": 0, "pt": 75, "ambiguous": n(lambda k: k % 11 == 0)}
