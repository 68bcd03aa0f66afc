"""Suffix-array dedup: every byte of a 200-byte string that also starts elsewhere goes.

Three steps. (1) Each 200-byte window of a document picks an anchor, the least hash of the k-byte strings in it; equal
windows pick equal anchors, so only regions around anchors that occur twice can hold repeats, and the rest of the
corpus goes no further. (2) Regions meet by anchor, copies of a region once with their number, and each task sorts the
suffixes of its regions by a difference-cover algorithm: triples at two of three offsets are sorted and named, the
names sorted recursively, the remaining suffixes merged in, and adjacent suffixes' 200-byte prefixes compared. (3)
Repeated windows go back to all documents that have the region, and the bytes they cover are taken out.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, table

WINDOW, GRAM = 200, 56
#: Bytes of text handled as one array (anchors take some hundred times as many), and anchors a task holds back to merge copies.
CHUNK, HELD = 1 << 18, 1 << 18
#: Bytes of regions whose suffixes are sorted together (small enough for a core's cache); an anchor's regions stay together.
SORT_BYTES = 12 << 10
#: An anchor with more distinct regions than this has them split by windows' distance to it, in steps of STEP, and by
#: what the windows of a step have in common.
MOST_REGIONS, STEP = 1 << 14, 16

_BASE = 0x9E3779B97F4A7C15 | 1
_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)


# ---------------------------------------------------------------- difference cover


def _named(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks from 1 of the keys, equal ones alike, and how many there are."""
    order = np.argsort(keys)
    ordered = keys[order]
    step = np.empty(len(keys), np.int64)
    if len(keys):
        step[0] = 1
        np.not_equal(ordered[1:], ordered[:-1], out=step[1:], casting="unsafe")
    names = np.empty(len(keys), np.int64)
    names[order] = np.cumsum(step)
    return names, int(step.sum())


def _pair(high: np.ndarray, low: np.ndarray, low_most: int) -> np.ndarray:
    return high * np.int64(low_most + 1) + low


def _ranks(s: np.ndarray, most: int, cover: int, depth: int) -> tuple[np.ndarray, int]:
    """Ranks from 1 of all suffixes of s, by at least their first ``depth`` characters; each symbol covers ``cover``.

    Suffixes that agree on so many may share a rank, or have neighbouring ones in any order. Symbols are from 1 to most.
    """
    n = len(s)
    padded = np.concatenate([s, np.zeros(4, np.int64)])
    one, two = np.arange(1, n + 1, 3), np.arange(2, n + 2, 3)
    sample = np.concatenate([one, two])
    last_two, k = _named(_pair(padded[sample + 1], padded[np.minimum(sample + 2, n + 3)], most))
    names, count = _named(_pair(padded[sample], last_two, k))
    if count < len(sample) and cover * 3 < depth:
        # the two halves are read one after the other; a symbol 0 in a triple ends the first
        names, count = _ranks(names, count, cover * 3, depth)
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = names
    # the suffixes at multiples of three: by their first character and the rank of the next
    zero = np.arange(0, n, 3)
    key0 = _pair(padded[zero], rank[zero + 1], count)
    in1, in2 = one[one < n], two[two < n]
    key1 = np.sort(_pair(padded[in1], rank[in1 + 1], count))
    # against suffixes at two mod three: by two characters and the rank after them
    heads, k = _named(np.concatenate([_pair(padded[zero], padded[zero + 1], most), _pair(padded[in2], padded[in2 + 1], most)]))
    key02 = _pair(heads[: len(zero)], rank[zero + 2], count)
    key2 = np.sort(_pair(heads[len(zero):], rank[in2 + 2], count))
    before = np.searchsorted(key1, key0) + np.searchsorted(key2, key02)
    # a suffix of the sample stands after as many others of it as have lower ranks
    kept = np.concatenate([in1, in2])
    order = kept[np.argsort(rank[kept], kind="stable")]
    by0 = zero[np.lexsort((key0, before))]
    at = np.sort(before)
    merged = np.insert(order, at, by0)
    out = np.empty(n, np.int64)
    out[merged] = np.arange(1, n + 1)
    return out, n


def suffix_order(text: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Starts of the suffixes of a byte string, sorted by at least their first ``depth`` bytes."""
    if not len(text):
        return np.zeros(0, np.int64)
    ranks, _ = _ranks(text.astype(np.int64) + 1, 256, 1, depth)
    order = np.empty(len(text), np.int64)
    order[ranks - 1] = np.arange(len(text))
    return order


def repeated_windows(regions: list[bytes], copies: list[int], starts: list[int], window: int = WINDOW) -> list[np.ndarray]:
    """For each region which of its first ``starts`` windows occur twice, in it, in another, or in a copy of it."""
    lengths = np.array([len(r) for r in regions])
    at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    text = np.frombuffer(b"".join(regions), np.uint8)
    n_starts = np.array(starts)
    weight = np.zeros(len(text), np.int64)
    owner = np.repeat(np.arange(len(regions)), n_starts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(n_starts) - n_starts, n_starts)
    weight[at[owner] + within] = np.array(copies)[owner]
    order = suffix_order(text, window)
    order = order[weight[order] > 0]
    # adjacent suffixes: are their first `window` bytes the same? by 8 bytes at a time, those still equal only
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        words = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(8, np.uint8)]), 8)
        i = np.arange(1, len(order))
        for off in [*range(0, window - 7, 8), *([window - 8] if window % 8 and window >= 8 else [])]:
            a = np.ascontiguousarray(words[order[i] + off]).view(np.uint64).ravel()
            b = np.ascontiguousarray(words[order[i - 1] + off]).view(np.uint64).ravel()
            i = i[a == b]
        if window < 8:
            view = np.lib.stride_tricks.sliding_window_view(text, window)
            i = i[(view[order[i]] == view[order[i - 1]]).all(1)]
        same[i] = True
    repeated = np.zeros(len(text), bool)
    hit = same | np.append(same[1:], False) if len(order) else same
    repeated[order[hit | (weight[order] > 1)]] = True
    return [repeated[a : a + k] for a, k in zip(at.tolist(), n_starts.tolist())]


# ---------------------------------------------------------------- anchors


class _Powers:
    """Powers of the hash's base and of its inverse, as far as they have been needed."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, CHUNK + 1)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def anchors(texts: list[bytes], window: int = WINDOW, gram: int = GRAM):
    """(text, first window, windows, anchor's distance to the first, hash) of each anchor, as arrays.

    An anchor's windows are those in which it is the leftmost of the least hashes; they follow one another.
    """
    w = window - gram + 1
    sizes = np.array([len(t) for t in texts], np.int64)
    empty = np.zeros(0, np.int64)
    if not len(sizes) or sizes.max() < window:
        return empty, empty, empty, empty, empty.astype(np.uint64)
    b = np.frombuffer(b"".join(texts), np.uint8)
    n = len(b)
    up, down = _POWERS.to(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[b] * up[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    bits = max(1, int(n).bit_length())
    least = (h >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < w:
        least = np.minimum(least[: len(least) - (w - size)], least[w - size :])
    pos = (least & np.uint64((1 << bits) - 1)).astype(np.int64)
    ends = np.cumsum(sizes)
    valid = np.ones(len(pos), bool)
    for e in ends.tolist():  # windows that run over a text's end
        valid[max(0, e - window + 1) : e] = False
    p = np.nonzero(valid)[0]
    a = pos[p]
    first = np.nonzero(np.concatenate([[True], (np.diff(a) != 0) | (np.diff(p) != 1)]))[0]
    lo = p[first]
    count = np.diff(np.append(first, len(p)))
    text = np.searchsorted(ends, lo, side="right")
    return text, lo - (ends - sizes)[text], count, a[first] - lo, h[a[first]]


def row_key(ident: int | None, text: bytes) -> int:
    """A row's key: rows of one id and one text share it, and so does all that is found for them."""
    return xxhash.xxh3_64_intdigest(b"-" if ident is None else struct.pack("<q", ident), xxhash.xxh3_64_intdigest(text)) - (1 << 63)


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in parts, so that few of its texts are Python objects at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[bytes]]]:
    keys, texts, held = [], [], 0
    for part in _slices(batch):
        for ident, text in zip(part.column("_id").to_pylist(), part.column("_text").to_pylist()):
            keys.append(row_key(ident, text))
            texts.append(text)
            held += len(text)
            if held >= CHUNK:
                yield keys, texts
                keys, texts, held = [], [], 0
    if keys:
        yield keys, texts


def _rows_of(keys: list[int], texts: list[bytes], window: int) -> np.ndarray:
    text, lo, count, off, h = anchors(texts, window)
    out = np.empty((len(text), 6), np.int64)
    digest = xxhash.xxh3_64_intdigest
    out[:, 0] = h.view(np.int64)
    out[:, 1] = np.array([digest(texts[t][a : a + c + window - 1], o) for t, a, c, o in zip(text.tolist(), lo.tolist(), count.tolist(), off.tolist())], np.uint64).view(np.int64)
    out[:, 2] = np.array(keys, np.int64)[text]
    out[:, 3], out[:, 4], out[:, 5] = lo, count, off
    return out


ROWS = T.StructType([T.StructField("_row", T.LongType(), False), T.StructField("_id", T.LongType()), T.StructField("_text", T.BinaryType(), False)])
_ANCHOR = "_anchor long, _region long, _row long, _lo int, _windows int, _off int"


def _anchor_batch(rows: np.ndarray, copies: np.ndarray | None = None) -> pa.RecordBatch:
    names = ["_anchor", "_region", "_row", "_lo", "_windows", "_off"]
    arrays = [pa.array(rows[:, k]) for k in range(3)] + [pa.array(rows[:, k].astype(np.int32)) for k in range(3, 6)]
    if copies is not None:
        arrays.append(pa.array(copies.astype(np.int64)))
        names = [*names, "_copies"]
    return pa.RecordBatch.from_arrays(arrays, names)


def _anchor_rows(window: int, merge: bool):
    def merged(parts: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(parts)
        parts.clear()
        order = np.lexsort((rows[:, 1], rows[:, 0]))
        rows = rows[order]
        first = np.nonzero(np.concatenate([[True], (np.diff(rows[:, :2], axis=0) != 0).any(1)]))[0] if len(rows) else np.zeros(0, np.int64)
        return _anchor_batch(rows[first], np.diff(np.append(first, len(rows))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for keys, texts in _chunks(batch):
                rows = _rows_of(keys, texts, window)
                if not merge:
                    yield _anchor_batch(rows)
                    continue
                parts.append(rows)
                held += len(rows)
                if held >= HELD:
                    yield merged(parts)
                    parts, held = [], 0
        if parts:
            yield merged(parts)
        give_back()

    return run


# ---------------------------------------------------------------- regions


def _cut_regions(window: int):
    """Rows with a text and its regions to the regions' bytes, an anchor's too many ones split."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in _slices(b)):
            out: list[tuple] = []
            for text, regions in zip(batch.column("_text").to_pylist(), batch.column("_regions").to_pylist()):
                for r in regions:
                    lo, n = r["_lo"], r["_windows"]
                    body = text[lo : lo + n + window - 1]
                    if not r["_many"]:
                        out.append((r["_anchor"], r["_anchor"], r["_region"], r["_copies"], 0, n, body))
                        continue
                    # window x is at distance off - x before the anchor; those of one step have these bytes in common
                    s = 0
                    while s < n:
                        near = (r["_off"] - s) // STEP * STEP
                        e = min(n, r["_off"] - near + 1)
                        core = body[r["_off"] - near : r["_off"] - near - STEP + 1 + window]
                        key = _signed(xxhash.xxh3_64_intdigest(core, near))
                        out.append((r["_anchor"], key, r["_region"], r["_copies"], s, e - s, body[s : e + window - 1]))
                        s = e
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                ["_anchor", "_key", "_region", "_copies", "_from", "_windows", "_bytes"],
            )

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _sort_regions(window: int):
    """Rows sorted by _anchor and _key to the repeated windows of each region, as runs."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated_windows([r[6] for r in rows], [r[3] for r in rows], [r[5] for r in rows], window)
        out: list[tuple] = []
        for r, mask in zip(rows, found):
            if mask.any():
                edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
                for s, e in zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist()):
                    out.append((r[0], r[2], r[4] + s, r[4] + e))
        return pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["_anchor", "_region", "_start", "_end"]
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("_anchor", "_key", "_region", "_copies", "_from", "_windows", "_bytes"))):
                if size >= SORT_BYTES and row[:2] != held[-1][:2]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
        if held:
            yield solve(held)
        give_back()

    return run


# ---------------------------------------------------------------- removal


def removed_spans(n: int, starts: list[tuple[int, int]], window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by windows that start in the given ranges."""
    spans: list[list[int]] = []
    for s, e in sorted(starts):
        lo, hi = s, min(n, e - 1 + window)
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], hi)
        else:
            spans.append([lo, hi])
    return [tuple(x) for x in spans]


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, finish: tuple[Callable, str] | None = None) -> DataFrame:
    """(id, _text, _spans) of every row: its text as bytes, and the maximal runs of bytes that go, as [start, end).

    finish: a function of batches of these and the schema of what it gives, which is returned instead. It runs in the same
    Python workers, so that texts aren't sent to others.

    See :func:`op1_suffix_dedup` for what goes. Null text: empty. Texts below ``window`` bytes: nothing goes. Null and
    repeated ids are allowed: every row is returned. Empty table: empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in _slices(whole)):
            ids, texts = b.column("_id"), b.column("_text")
            rows = [row_key(i, t) for i, t in zip(ids.to_pylist(), texts.to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), ids, texts],
                schema=pa.schema([pa.field("_row", pa.int64(), False), pa.field("_id", pa.int64()), pa.field("_text", pa.binary(), False)]),
            )

    bytes_ = docs.select(F.col(id_col).cast("long").alias("_id"), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("_text"))
    rows = bytes_.mapInArrow(keyed, ROWS)
    slim = bytes_.where(F.length("_text") >= window)

    # distinct regions of anchors that occur at least twice. A task's copies have been merged, so that a hot region is
    # a row a task; one exchange, by anchor, serves both aggregates
    merged = slim.mapInArrow(_anchor_rows(window, True), _ANCHOR + ", _copies long").repartition(n, "_anchor")
    regions = merged.groupBy("_anchor", "_region").agg(
        F.sum("_copies").alias("_copies"), F.first("_row").alias("_row"), F.first("_lo").alias("_lo"), F.first("_windows").alias("_windows"), F.first("_off").alias("_off")
    )
    by_anchor = Window.partitionBy("_anchor")
    shared = (
        regions.withColumn("_all", F.sum("_copies").over(by_anchor)).withColumn("_many", F.count(F.lit(1)).over(by_anchor) > MOST_REGIONS)
        .where("_all > 1")
    )
    wanted = shared.groupBy("_row").agg(F.collect_list(F.struct("_anchor", "_region", "_copies", "_lo", "_windows", "_off", "_many")).alias("_regions"))
    texts = rows.repartition(n, "_row")
    # with the same columns and filters as the other use of the texts below, so that both read one exchange
    cut = texts.join(wanted, "_row").mapInArrow(
        _cut_regions(window), "_anchor long, _key long, _region long, _copies long, _from int, _windows int, _bytes binary"
    )
    runs = (
        cut.repartition(n, "_anchor", "_key").sortWithinPartitions("_anchor", "_key")
        .mapInArrow(_sort_regions(window), "_anchor long, _region long, _start int, _end int")
    ).distinct()

    # back to all documents that have the region
    every = slim.mapInArrow(_anchor_rows(window, False), _ANCHOR).select("_anchor", "_region", "_row", "_lo")
    starts = every.join(runs, ["_anchor", "_region"]).select("_row", (F.col("_lo") + F.col("_start")).alias("_s"), (F.col("_lo") + F.col("_end")).alias("_e"))
    per_row = starts.groupBy("_row").agg(F.collect_set(F.struct("_s", "_e")).alias("_starts"))

    def spans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in _slices(whole)):
            texts = b.column("_text")
            found = [
                [{"start": s, "end": e} for s, e in removed_spans(len(t), [(x["_s"], x["_e"]) for x in (r or ())], window)]
                for t, r in zip(texts.to_pylist(), b.column("_starts").to_pylist())
            ]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("_id"), texts, pa.array(found, kind)], [id_col, "_text", "_spans"])

    found = texts.join(per_row, "_row", "left")
    if finish:
        return found.mapInArrow(lambda batches: finish[0](spans(batches)), finish[1])
    return found.mapInArrow(spans, f"`{id_col}` long, _text binary, _spans array<struct<start:long,end:long>>")


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 200-byte strings that start more than once in the corpus.

    Texts are UTF-8 bytes; matches don't cross documents; strings are judged on the input, and one that starts twice
    in the same document, overlaps included, goes at both places.
    """
    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, spans in zip(b.column("_text").to_pylist(), b.column("_spans").to_pylist()):
                kept, at = [], 0
                for s in spans:
                    kept.append(t[at : s["start"]])
                    at = s["end"]
                kept.append(t[at:])
                left = b"".join(kept)
                rows.append((len(t), len(t) - len(left), len(spans), hashlib.sha256(left).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string())))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return find_repeats(table(spark, sf_dir, "documents"), finish=(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


#: On hexadecimal text, two characters a byte. Equal strings are found by their digests.
OP1_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT r, h, unnest(range(0, greatest(n - 199, 0))) AS i FROM d)),
twice AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
hit AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200, true) AS fresh FROM w SEMI JOIN twice USING (k)),
numbered AS (SELECT r, i, sum(fresh::INTEGER) OVER (PARTITION BY r ORDER BY i) AS span FROM hit),
spans AS (SELECT r, min(i) AS s, max(i) + 200 AS e FROM numbered GROUP BY r, span),
pieces AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS b FROM spans),
kept AS (SELECT p.r, count(*) AS k, sum(e - s) AS gone, string_agg(substr(h, 2 * b + 1, 2 * (s - b)), '' ORDER BY s) || substr(any_value(h), 2 * max(e) + 1) AS left_over
  FROM pieces p JOIN d ON d.r = p.r GROUP BY p.r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(k, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(left_over, h))) AS kept_sha256
FROM d LEFT JOIN kept ON d.r = kept.r
"""
