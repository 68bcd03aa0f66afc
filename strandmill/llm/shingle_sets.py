"""Near copies by exact Jaccard similarity of shingle sets.

Sets are joined on their prefixes: of a set of n shingles in one global order, the first n - ceil(t * n) + 1; two sets
with a Jaccard similarity of at least t share one of those. Length, positional and parity bounds drop pairs, the rest
is verified on the whole sets. First sets meet whose SimHash fingerprints the pigeonring links, and each set meets two
others of a bucket, and what is similar is connected; then only pairs of different components meet, so a large group of
near copies isn't paired with itself.

Texts stay where they are read, but for those of pairs that all bounds let through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, give_back, small
from .simhash import SEED, fingerprint_links, print_of, shingle_hashes

#: The similarity, as a fraction, so that all bounds are integers.
SIMILARITY = (4, 5)
#: Documents from which common shingles are learnt, and how many of those are known. They only order prefixes.
SAMPLE, COMMON = 20_000, 1 << 17
#: Sets of a bucket that are compared as one block, and rows whose texts are Python objects at a time.
BLOCK, ROWS = 256, 256
#: Ids of at most so many bytes are broadcast.
BROADCAST_BYTES = 32 << 20


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The text's different shingles, as sorted hashes."""
    return np.unique(shingle_hashes(text, shingle))


def set_hash(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63)


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared * (num + den) >= (len(a) + len(b)) * num


def parities(s: np.ndarray) -> bytes:
    """Whether an odd number of the shingles end in each value of some last bits: at least as many values as half the shingles."""
    bits = 64
    while bits * 2 < len(s):
        bits *= 2
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """In how many parities two sets differ, at the smaller one's number of them: no more than shingles that only one has."""
    if len(a) > len(b):
        a, b = b, a
    x, y, size = int.from_bytes(a, "little"), int.from_bytes(b, "little"), len(b) * 8
    while size > len(a) * 8:
        size //= 2
        y = (y >> size) ^ (y & ((1 << size) - 1))
    return (x ^ y).bit_count()


def prefix(s: np.ndarray, common: np.ndarray, rank: np.ndarray, num: int, den: int) -> np.ndarray:
    """The rarest shingles that a similar set must share one of: by rank among the common ones (0: not one), then by hash."""
    if not len(s):
        return s
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        s = s[np.lexsort((s, np.where(common[at] == s, rank[at], 0)))]
    return s[: len(s) - -(-len(s) * num // den) + 1]


def may_be(xn, xp, yn, yp, num: int, den: int):
    """Whether sets of xn and yn shingles that share those at xp and yp can be similar."""
    return (xn * den >= yn * num) & (yn * den >= xn * num) & ((np.minimum(xp, yp) + np.minimum(xn - xp, yn - yp)) * (num + den) >= (xn + yn) * num)


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts, so that few of their texts and sets are held at a time."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def _batch(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _grouped(names: list[str], each: Callable[[np.ndarray], Iterator[pa.RecordBatch]]):
    """A mapInArrow function over rows sorted by the first column; each gets whole groups, many at once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            rows = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names], axis=1)
            if not len(rows):
                continue
            if held and held[0][0, 0] == rows[-1, 0]:
                held.append(rows)
                continue
            rows = np.concatenate([*held, rows])
            cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            held = [rows[cut:]]
            if cut:
                yield from each(rows[:cut])
        if held:
            yield from each(np.concatenate(held))

    return run


def _shared(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    same = rows[1:, 0] == rows[:-1, 0]
    kept = rows[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
    if len(kept):
        yield _batch(list(kept.T), ["_s", "_fp", "_n", "_pos"])


def _parts(rows: np.ndarray) -> list[np.ndarray]:
    return np.split(rows, np.nonzero(np.diff(rows[:, 0]))[0] + 1)


def _pairs(u: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(u):
        yield _batch([np.minimum(u, v), np.maximum(u, v)], ["u", "v"])


def _star(num: int, den: int):
    """Each set of a bucket with the bucket's first, and with the one before it."""

    def each(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.concatenate(([True], np.diff(rows[:, 0]) != 0))
        first = np.maximum.accumulate(np.where(start, np.arange(len(rows)), 0))
        for other in (first, np.maximum(np.arange(len(rows)) - 1, first)):
            x, y = rows[other], rows
            keep = (x[:, 1] != y[:, 1]) & may_be(x[:, 2], x[:, 3], y[:, 2], y[:, 3], num, den)
            yield from _pairs(x[keep, 1], y[keep, 1])

    return each


def _across(num: int, den: int):
    """All pairs of a bucket's sets that are of different components."""

    def each(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for part in _parts(rows):
            if (part[:, 4] == part[0, 4]).all():
                continue
            for a in range(0, len(part), BLOCK):
                for b in range(0, a + 1, BLOCK):
                    y, x = part[a : a + BLOCK, None], part[None, b : b + BLOCK]
                    i, j = np.nonzero((x[..., 4] != y[..., 4]) & may_be(x[..., 2], x[..., 3], y[..., 2], y[..., 3], num, den))
                    yield from _pairs(part[a + i, 1], part[b + j, 1])

    return each


def sets_of(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, _fp, _n, _print, _odd) of every row: the hash of its shingle set, its size, SimHash fingerprint and parities.

    Equal sets are one class from here on.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sets = [shingle_set(t, shingle) for t in b.column(1).to_pylist()]
            prints = np.array([print_of(s) for s in sets], np.uint64).view(np.int64)
            found = [pa.array([set_hash(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.int64()), pa.array([parities(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *found], [id_col, "_fp", "_n", "_print", "_odd"])
        give_back()

    return docs.mapInArrow(run, f"`{id_col}` long, _fp long, _n long, _print long, _odd binary")


def print_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (u, v) of classes _fp that the pigeonring links by their fingerprints _print, classes of one fingerprint among them.

    Of classes with one fingerprint each is paired with the least, which is also that of the fingerprint's links.
    """
    least = classes.groupBy("_print").agg(F.min("_fp").alias("_first")).checkpoint()
    same = classes.join(least, "_print").where(F.col("_fp") != F.col("_first")).select(F.col("_first").alias("u"), F.col("_fp").alias("v"))
    links = fingerprint_links(least.select(F.col("_print").alias("_fp")))
    across = links.join(least.toDF("u", "_u"), "u").join(least.toDF("v", "_v"), "v").select(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v"))
    return same.unionByName(across)


def near_pairs(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v, _uid, _vid) of the pairs whose sizes and parities don't rule out that the sets are similar, and documents that have them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, *odd = (b.column(c) for c in ("_un", "_vn", "_uodd", "_vodd"))
            x, y = x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False)
            differ = np.array([apart(p, q) for p, q in zip(*(c.to_pylist() for c in odd))], np.int64)
            keep = (x * den >= y * num) & (y * den >= x * num) & ((x + y - differ) * (num + den) >= (x + y) * 2 * num)
            yield b.select(["u", "v", "_uid", "_vid"]).filter(pa.array(keep))

    sides = [classes.select(F.col("_fp").alias(c), F.col("_least").alias(f"_{c}id"), F.col("_n").alias(f"_{c}n"), F.col("_odd").alias(f"_{c}odd")) for c in "uv"]
    both = pairs.join(sides[0], "u").join(sides[1], "v")
    return both.select("u", "v", "_uid", "_vid", "_un", "_vn", "_uodd", "_vodd").mapInArrow(run, "u long, v long, _uid long, _vid long")


def common_shingles(docs: DataFrame, rows: int, text_col: str, id_col: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of shingles that several documents of a sample have, and their ranks from 1, rarest first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            for t in b.column(0).to_pylist():
                yield _batch([shingle_set(t, shingle).view(np.int64)], ["_s"])

    some = docs.where(F.pmod(F.xxhash64(id_col), F.lit(max(1, rows // SAMPLE))) == 0).select(text_col)
    counted = some.mapInArrow(run, "_s long").groupBy("_s").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 3")
    found = counted.orderBy(F.desc("_n"), "_s").limit(COMMON).toArrow()
    hashes = found["_s"].to_numpy().view(np.uint64)[::-1]
    order = np.argsort(hashes)
    return hashes[order], order + 1


def shingle_links(docs: DataFrame, prints: DataFrame, id_col: str, text_col: str, shingle: int, similarity=SIMILARITY) -> DataFrame:
    """Links (u, v) that connect the classes _fp as all pairs of similarity at least num / den would."""
    num, den = similarity
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = prints.count()
    common, rank = (spark.sparkContext.broadcast(x) for x in common_shingles(docs, rows, text_col, id_col, shingle))
    classes = prints.groupBy("_fp").agg(F.min(id_col).alias("_least"), *(F.first(c).alias(c) for c in ("_n", "_print", "_odd"))).checkpoint()
    # documents that are copies of one with a smaller id, and first of no set
    copies = prints.select(F.col(id_col).alias("_least")).distinct().join(classes, ["_least"], "left_anti").withColumnRenamed("_least", "_copy").checkpoint()
    if copies.count() * 32 <= BROADCAST_BYTES:
        copies = F.broadcast(copies)

    def postings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            for t in b.column(0).to_pylist():
                s = shingle_set(t, shingle)
                p = prefix(s, common.value, rank.value, num, den)
                yield _batch([p.view(np.int64), np.full(len(p), set_hash(s)), np.full(len(p), len(s)), np.arange(len(p))], ["_s", "_fp", "_n", "_pos"])
        give_back()

    kind = "_s long, _fp long, _n long, _pos long"
    dealt = lambda df: df.repartition(n, "_s").sortWithinPartitions("_s", "_fp")
    firsts = docs.join(copies, F.col(id_col) == F.col("_copy"), "left_anti").select(text_col)
    # most shingles are of one document only; the few others are kept
    buckets = dealt(firsts.mapInArrow(postings, kind)).mapInArrow(_grouped(["_s", "_fp", "_n", "_pos"], _shared), kind).checkpoint()

    def verified(pairs: DataFrame) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last = (None, None)
            for b in _slices(batches):
                u, v, texts, others = (c.to_pylist() for c in b.columns)
                found = []
                for p, q, t, o in zip(u, v, texts, others):
                    if last[0] != t:
                        last = (t, shingle_set(t, shingle))
                    x, y = last[1], shingle_set(o, shingle)
                    # an id may have several texts
                    if set_hash(x) == p and set_hash(y) == q and similar(x, y, num, den):
                        found.append((p, q))
                if found:
                    yield _batch(list(np.array(found, np.int64).T), ["u", "v"])
            give_back()

        named = near_pairs(pairs, classes, num, den).checkpoint()
        # those that the bounds let through are few beside all documents: up to a size they go to the texts
        needed = small(named.select(F.explode(F.array("_uid", "_vid")).alias("_need")).distinct(), 32)
        texts = docs.join(needed, F.col(id_col) == F.col("_need"), "left_semi").select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        both = named.join(texts.toDF("_uid", "_utext"), "_uid").join(texts.toDF("_vid", "_vtext"), "_vid")
        return both.select("u", "v", "_utext", "_vtext").mapInArrow(run, "u long, v long").distinct().checkpoint()

    met = dealt(buckets).mapInArrow(_grouped(["_s", "_fp", "_n", "_pos"], _star(num, den)), "u long, v long")
    tried = print_pairs(classes).unionByName(met).distinct().checkpoint()
    good = verified(tried)
    roots = connected_components(buckets.select(F.col("_fp").alias("node")).distinct(), good)
    placed = buckets.join(roots.select(F.col("node").alias("_fp"), F.col("root").alias("_root")), "_fp")
    rest = dealt(placed).mapInArrow(_grouped(["_s", "_fp", "_n", "_pos", "_root"], _across(num, den)), "u long, v long").distinct()
    return good.unionByName(verified(rest.join(tried, ["u", "v"], "left_anti").checkpoint()))
