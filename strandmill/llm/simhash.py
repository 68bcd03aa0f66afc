"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked where few bits differ.

Candidates come from the pigeonring principle: with b bits to differ in m segments on a ring, some segment starts a
chain in which the first l segments differ in at most l * b / m bits together, for every l. Fingerprints meet by a
first segment that is equal, and only those whose chain keeps to the budgets go on to the full Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, free_name, table

#: The query's contract: four words a shingle, four bits. The pipeline's near-duplicates are found otherwise: see keep_one.
SHINGLE, BITS, SEED = 4, 4, 42
#: Ends of the segments: BITS + 1 of them, of 13 or 12 bits, so that at least one is equal.
SEGMENTS = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))
#: Fingerprints of a bucket that are compared as one block, and how many a bucket may have before it is split.
BLOCK, MOST_IN_BUCKET = 1024, 8192


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hash of each of the text's shingles in turn; of fewer words than a shingle, that of all."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    hash_ = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([hash_(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    lo, hi = starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist()
    return np.array([hash_(joined[a:b], SEED) for a, b in zip(lo, hi)], np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The text's fingerprint, of all its shingles."""
    return print_of(shingle_hashes(text, shingle))


def print_of(hashes: np.ndarray) -> int:
    """The fingerprint of hashed shingles; bit k of 64 is set if set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, _fp) of every row; the fingerprint as a signed long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t, shingle) for t in b.column("_text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.int64())], [id_col, "_fp"])

    typed = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("_text"))
    return typed.mapInArrow(run, f"`{id_col}` long, _fp long")


def _segment(fp: np.ndarray, k: int) -> np.ndarray:
    lo, hi = SEGMENTS[k % len(SEGMENTS)]
    return (fp >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)


def pairs_within(left: np.ndarray, right: np.ndarray, first: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs that differ in at most ``bits`` bits, of fingerprints equal in segment ``first``.

    The chain from that segment on must keep to its budgets; a pair that breaks them has another segment that starts
    one that does, so no pair is lost over all segments.
    """
    m = len(SEGMENTS)
    at = np.zeros((len(left), len(right)), np.uint8)
    keep = np.ones_like(at, bool)
    for length in range(2, m):
        k = first + length - 1
        at += np.bitwise_count(_segment(left, k)[:, None] ^ _segment(right, k)[None, :])
        keep &= at <= length * bits // m
    i, j = np.nonzero(keep)
    near = np.bitwise_count(left[i] ^ right[j]) <= bits
    return i[near], j[near]


def bucket_links(fp: np.ndarray, first: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the distinct fingerprints of a bucket as all their pairs would, at most one a fingerprint."""
    parent = np.arange(len(fp))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    u, v = [], []
    for a in range(0, len(fp), BLOCK):
        for b in range(0, a + 1, BLOCK):
            for i, j in zip(*(x.tolist() for x in pairs_within(fp[a : a + BLOCK], fp[b : b + BLOCK], first, bits))):
                p, q = root(a + i), root(b + j)
                if p != q:
                    parent[p] = q
                    u.append(a + i)
                    v.append(b + j)
    return fp[u], fp[v]


def _links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_k, _value, _fp) sorted by the first two, bucket by bucket, to links (u, v)."""
    held: list[np.ndarray] = []

    def out(bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(bucket) > 1:
            u, v = bucket_links(bucket[:, 2].copy().view(np.uint64), int(bucket[0, 0]))
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    for b in batches:
        rows = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_k", "_value", "_fp")], axis=1)
        rows = np.concatenate([*held, rows]) if held else rows
        if not len(rows):
            continue
        cuts = np.nonzero((np.diff(rows[:, :2], axis=0) != 0).any(1))[0] + 1
        parts = np.split(rows, cuts)
        for part in parts[:-1]:
            yield from out(part)
        held = [parts[-1]]
    if held:
        yield from out(held[0])


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links (u, v) that connect the distinct values of column _fp as all pairs within BITS bits would.

    Copies have one fingerprint and so meet once. Within a bucket only links that join what isn't joined yet are
    given: at most one a fingerprint and bucket, not all pairs.
    """
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = lambda k: F.shiftrightunsigned("_fp", SEGMENTS[k][0]).bitwiseAND(F.lit((1 << (SEGMENTS[k][1] - SEGMENTS[k][0])) - 1).cast("long"))
    m = len(SEGMENTS)
    segments = [
        F.struct(F.lit(k).cast("long").alias("_k"), value(k).alias("_value"), value((k + 1) % m).alias("_next"), F.lit(SEGMENTS[(k + 1) % m][1] - SEGMENTS[(k + 1) % m][0]).alias("_width"))
        for k in range(m)
    ]
    rows = prints.select("_fp").distinct().select("_fp", F.explode(F.array(*segments)).alias("_s")).select("_fp", "_s.*")
    # at most a row for each value of each segment, so under 2^16 of them, however many fingerprints there are
    full = rows.groupBy("_k", "_value").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > MOST_IN_BUCKET).select("_k", "_value", F.lit(True).alias("_full"))
    # by the chain's second budget the next segment differs in one bit at most: a full bucket is split by that segment, and
    # each fingerprint is also in the parts that are one bit away
    one_away = F.transform(F.sequence(F.lit(-1), F.col("_width") - 1), lambda i: F.when(i < 0, F.col("_next")).otherwise(F.col("_next").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    rows = rows.join(F.broadcast(full), ["_k", "_value"], "left").select("_k", "_value", "_fp", F.explode(F.when(F.col("_full"), F.transform(one_away, lambda x: x + 1)).otherwise(F.array(F.lit(0).cast("long")))).alias("_part"))
    rows = rows.select("_k", (F.col("_part") * (1 << 16) + F.col("_value")).alias("_value"), "_fp")
    return rows.repartition(n, "_k", "_value").sortWithinPartitions("_k", "_value", "_fp").mapInArrow(_links, "u long, v long")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fingerprint, component_id) of every row: 16 lower-case hex digits, and the smallest id that links reach.

    Null text: as the empty text, fingerprint zero, which links like any other; so do texts without words. Fewer words
    than a shingle: the whole sequence is the one shingle. Null id: a row of its component that never names it, unless
    all ids in it are null (then null). Repeated rows: all are returned. Very long texts are hashed whole. Empty
    table: empty result. Other columns are ignored.
    """
    prints = with_fingerprints(docs, id_col, text_col, shingle).checkpoint()  # 16 bytes a row; hashed once
    by_print = _named(prints, fingerprint_links(prints), id_col)
    return prints.join(by_print, "_fp").select(
        id_col, F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _named(prints: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    """(_fp, component_id) of every distinct _fp: the smallest id that links reach."""
    # a node for each distinct fingerprint, under the order of fingerprints; ids come in at the end
    nodes = prints.select(F.col("_fp").alias("node")).distinct()
    rooted = connected_components(nodes, links)
    least = prints.groupBy(F.col("_fp").alias("node")).agg(F.min(id_col).alias("_least"))
    named = rooted.join(least, "node")
    component = named.groupBy("root").agg(F.min("_least").alias("component_id"))
    return named.select(F.col("node").alias("_fp"), "root").join(component, "root").select("_fp", "component_id")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    from .common import shared_dir

    shared_dir(spark)
    return components(table(spark, sf_dir, "documents"))


def keep_one(spark, docs: DataFrame, sf_dir: str, shingle: int = 5) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest id stays, unchanged.

    Rows are linked if their sets of five-word shingles have a Jaccard similarity of at least 0.8. Sets meet by their
    fingerprints, as in :func:`components`, and what meets is verified; as at that similarity fingerprints may differ in
    more bits than they meet by, an exact join then finds all other such pairs. Texts without a word have
    the empty set and are one group; fewer words than a shingle are one shingle. Rows with a null id all stay, and
    group no others. Of rows that repeat an id all stay or none. Null text: as the empty one. Very long texts are taken
    whole. Empty table: empty result. Columns of any name pass through.
    """
    from .common import shared_dir
    from .shingle_sets import sets_of, shingle_links

    shared_dir(spark)
    typed = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = sets_of(typed, "doc_id", "text", shingle).checkpoint()
    by_print = _named(prints, shingle_links(typed, prints, "doc_id", "text", shingle), "doc_id")
    drop = prints.join(by_print, "_fp").where(F.col("doc_id") != F.col("component_id"))
    name = free_name(docs, "_drop")
    drop = drop.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(drop, docs["doc_id"] == drop[name], "left_anti")
