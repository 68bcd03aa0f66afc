"""Substring dedup: every word of a 35-word string that also starts elsewhere goes, by an FM-index for each shard.

Three steps. (1) Each window of 35 words picks an anchor, the least hash of the short strings of words in it; equal
windows pick equal anchors, so only regions around anchors that occur twice can match anything, and the rest of the
corpus goes no further. (2) Regions go to shards by anchor, copies of a region once with their number. A task makes an
FM-index of a shard's regions (suffix order, Burrows-Wheeler transform in a wavelet matrix, longest
common prefixes) and streams the regions through it: backward search, word by word from the right, gives the matching
statistic of each place, the longest string from there that occurs at least twice, and windows at places where it is
long enough are reported. (3) They go back to all documents that have the region, and the words they cover go.

Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, table
from .suffix_dedup import ROWS, _slices, removed_spans, row_key

WINDOW, GRAM = 35, 8
#: Bytes of text handled as one array, and anchors a task holds back to merge copies.
CHUNK, HELD = 1 << 20, 1 << 18
#: Words of regions that are indexed together; an anchor's regions stay together.
SHARD_WORDS = 1 << 17
#: An anchor with more distinct regions than this has them split into their windows, which meet by hashes of their own.
MOST_REGIONS = 1 << 12

_BASE = 0xD1342543DE82EF95
#: The first bytes of eight, by their number.
_HEADS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes than this are hashed one by one.
LONG = 64


# ---------------------------------------------------------------- words and their hashes


class _Powers:
    """Powers of the base of the hashes and of its inverse, as far as they have been needed."""

    up = down = np.ones(0, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, CHUNK + 1)
            up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            cls.up, cls.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return cls.up[:n], cls.down[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def _sums(values: np.ndarray) -> np.ndarray:
    """Sums from which :func:`_between` gets a hash of any stretch."""
    up, _ = _Powers.to(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def _between(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    _, down = _Powers.to(len(sums))
    return _mixed((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts one after the other, and how many each has."""
    b = np.frombuffer(b" ".join([*texts, bytes(8)]), np.uint8)
    text = b[:-8]
    word = np.zeros(len(text) + 2, bool)
    word[1:-1] = (text != 32) & (text - np.uint8(9) > 4)
    edge = np.flatnonzero(word[1:] != word[:-1])
    lo, hi = edge[::2], edge[1::2]
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    count = np.diff(np.searchsorted(lo, ends), prepend=0)
    # eight bytes at a time, from any place on
    eight, size = np.ndarray((len(text) + 1,), "<u8", b, 0, (1,)), hi - lo
    h = _mixed((eight[lo] & _HEADS[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(_BASE))
    more, at = np.flatnonzero(size > 8), 8
    while len(more) and at < LONG:
        h[more] = _mixed(h[more] * np.uint64(_BASE) + (eight[lo[more] + at] & _HEADS[np.minimum(size[more] - at, 8)]))
        at += 8
        more = more[size[more] > at]
    for k in more.tolist():
        h[k] = xxhash.xxh3_64_intdigest(b[lo[k] : hi[k]])
    return h, count


def anchors(words: np.ndarray, count: np.ndarray, window: int, gram: int = GRAM):
    """(text, first window, windows, anchor's distance to the first, anchor, region) as arrays, for each anchor of texts.

    words: of all texts; count: of each. An anchor is the hash of the leftmost of the least strings of ``gram`` words
    in its windows, which follow one another; the region has all their words, and its hash also tells the distance.
    """
    gram = min(gram, window)
    none = np.zeros(0, np.int64)
    if not len(count) or count.max() < window:
        return none, none, none, none, none, none
    sums = _sums(words)
    at = np.arange(len(words) - gram + 1)
    h = _between(sums, at, at + gram)
    bits = max(1, int(len(words)).bit_length())
    least = (h >> np.uint64(bits) << np.uint64(bits)) | at.astype(np.uint64)
    size, wide = 1, window - gram + 1
    while size * 2 <= wide:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < wide:
        least = np.minimum(least[: len(least) - (wide - size)], least[wide - size :])
    place = (least & np.uint64((1 << bits) - 1)).astype(np.int64)
    ends = np.cumsum(count)
    # windows that lie within one text
    left = np.repeat(ends, count)[: len(place)] - np.arange(len(place))
    p = np.nonzero(left >= window)[0]
    a = place[p]
    first = np.nonzero(np.concatenate([[True], (np.diff(a) != 0) | (np.diff(p) != 1)]))[0]
    lo, n = p[first], np.diff(np.append(first, len(p)))
    text = np.searchsorted(ends, lo, side="right")
    off = a[first] - lo
    region = _mixed(_between(sums, lo, lo + n + window - 1) + off.astype(np.uint64) * np.uint64(_BASE))
    return text, lo - (ends - count)[text], n, off, h[a[first]].view(np.int64), region.view(np.int64)


# ---------------------------------------------------------------- FM-index


def _suffixes(s: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of all suffixes, and the names of each by its first 1, 2, 4, ... symbols, equal ones alike.

    A name is the first place of those that have it, so that each round sorts only suffixes whose name is not theirs alone.
    Every symbol sequence must differ from the others before its end, as separators of their own see to.
    """
    n = len(s)
    order = np.argsort(s)
    key, at, places = s[order], order, np.arange(n)
    names, by, width = np.empty(n, np.int64), [], 1
    while True:
        first = np.concatenate([[True], key[1:] != key[:-1]])
        names[at] = places[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        by.append(names.copy())
        places = places[~(first & np.append(first[1:], True))]
        if not len(places):
            return order, by
        at = order[places]
        key = names[at] * n + names[at + width]
        sorted_ = np.argsort(key)
        at, key = at[sorted_], key[sorted_]
        order[places] = at
        width *= 2


class _Wavelets:
    """A wavelet matrix of two bits a level: how often a symbol stands before a place."""

    def __init__(self, symbols: np.ndarray, kinds: int):
        self.size, self.shifts, self.goes = len(symbols) + 1, range((max(1, int(kinds - 1).bit_length()) - 1) // 2 * 2, -1, -2), []
        seq = symbols.astype(np.int32)
        for shift in self.shifts:
            digit = (seq >> shift & 3).astype(np.uint8)
            # where each place goes on the next level, for each digit
            goes = np.zeros((4, self.size), np.int32)
            before = 0
            for d in range(4):
                np.cumsum(digit == d, dtype=np.int32, out=goes[d, 1:])
                here = int(goes[d, -1])
                goes[d] += before
                before += here
            self.goes.append(goes.ravel())
            seq = seq[np.argsort(digit, kind="stable")]
        self.start = self._down(np.zeros(kinds, np.int64), np.arange(kinds))

    def _down(self, place: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for shift, goes in zip(self.shifts, self.goes):
            place = goes.take(place + (symbol >> shift & 3) * self.size)
        return place

    def rank(self, place: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return self._down(place, symbol) - self.start[symbol]


def _nearest_lower(v: np.ndarray) -> np.ndarray:
    """For each place the last one before it with a lower value (0 if there is none): by jumps over what is known not to be lower."""
    at = np.maximum(np.arange(len(v)) - 1, 0)
    open_, mine = np.arange(1, len(v)), v[1:]
    while len(open_):
        to = at.take(open_)
        on = np.flatnonzero((v.take(to) >= mine) & (to > 0))
        open_, mine = open_.take(on), mine.take(on)
        at[open_] = at.take(to.take(on))
    return at


class FmIndex:
    """Backward search among texts of words, with the intervals of shorter matches."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, copies: np.ndarray):
        """words: of all texts; sizes: of each; copies: how often each text counts."""
        k = len(sizes)
        _, self.symbol = np.unique(words, return_inverse=True)
        kinds = k + (int(self.symbol.max()) + 1 if len(words) else 0)
        self.symbol = self.symbol + k
        # a separator of its own, lower than all words, ends each text: no match reaches over it
        ends = np.cumsum(sizes)
        s = np.insert(self.symbol, ends, np.arange(k))
        n = len(s)
        weight = np.insert(np.repeat(copies, sizes), ends, 0)
        order, by = _suffixes(s)
        # what two suffixes have in common ends before a separator, so that no place is beyond the last
        common = np.zeros(n - 1, np.int64)
        for j in range(len(by) - 1, -1, -1):
            common += (by[j][order[:-1] + common] == by[j][order[1:] + common]).astype(np.int64) << j
        self.n, self.common = n, np.concatenate([[-1], common, [-1]]).astype(np.int32)
        self.lower = _nearest_lower(self.common)
        self.upper = n - _nearest_lower(self.common[::-1])[::-1]
        self.weight = np.concatenate([[0], np.cumsum(weight[order])])
        self.first = np.cumsum(np.bincount(s, minlength=kinds)) - np.bincount(s, minlength=kinds)
        self.wavelets = _Wavelets(s[order - 1], kinds)

    def extended(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that start with the symbol and go on as those of the intervals do."""
        both = self.wavelets.rank(np.concatenate([lo, hi]), np.concatenate([symbol, symbol]))
        return self.first[symbol] + both[: len(lo)], self.first[symbol] + both[len(lo) :]

    def shortened(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next larger intervals, and how many words their suffixes have in common."""
        k = np.where(self.common[lo] >= self.common[hi], lo, hi)
        return self.lower[k], self.upper[k], self.common[k]


def matching_statistics(words: np.ndarray, sizes: np.ndarray, copies: np.ndarray, least: int = 2) -> np.ndarray:
    """For each word of the texts the length of the longest string from it, within its text, that occurs ``least`` times in all."""
    index = FmIndex(words, sizes, copies)
    out = np.zeros(len(words), np.int64)
    k = len(sizes)
    lo, hi, length = np.zeros(k, np.int64), np.full(k, index.n), np.zeros(k, np.int64)
    # longest texts first, so that those still read at a step are the first ones
    by_size = np.argsort(-sizes, kind="stable")
    ends = np.cumsum(sizes)[by_size]
    live = np.searchsorted(-sizes[by_size], -np.arange(int(sizes.max(initial=0))), side="left")
    for step, n in enumerate(live.tolist(), 1):
        at = ends[:n] - step
        symbol = index.symbol[at]
        row = np.arange(n)
        while len(row):
            a, b = index.extended(lo[row], hi[row], symbol[row])
            fits = index.weight[b] - index.weight[a] >= least
            won = row[fits]
            lo[won], hi[won] = a[fits], b[fits]
            length[won] += 1
            row = row[~fits]
            row = row[length[row] > 0]
            lo[row], hi[row], length[row] = index.shortened(lo[row], hi[row])
        # no string that starts with the word occurs often enough: from the next word on, anew
        out[at] = length[:n]
        fresh = np.nonzero(length[:n] == 0)[0]
        lo[fresh], hi[fresh] = 0, index.n
    return out


# ---------------------------------------------------------------- tasks


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


def _by_bytes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most CHUNK bytes of text, or of one text."""
    for part in _slices(batch):
        ends = np.cumsum(pc.binary_length(part.column("_text")).to_numpy(), dtype=np.int64)
        at = 0
        while at < part.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")))
            yield part.slice(at, to - at)
            at = to


_ANCHOR = "_anchor long, _region long, _row long, _lo int, _windows int, _off int"


def _anchor_rows(window: int, merge: bool):
    def found(keys: list[int], texts: list[bytes]) -> np.ndarray:
        text, lo, n, off, anchor, region = anchors(*word_hashes(texts), window)
        return np.stack([anchor, region, np.array(keys, np.int64)[text], lo, n, off])

    def batch_of(rows: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
        arrays = [pa.array(r if k < 3 else r.astype(np.int32)) for k, r in enumerate(rows)]
        return pa.RecordBatch.from_arrays([*arrays, *map(pa.array, more)], ["_anchor", "_region", "_row", "_lo", "_windows", "_off", "_copies"][: 6 + len(more)])

    def merged(parts: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(parts, axis=1)
        rows = rows[:, np.lexsort((rows[1], rows[0]))]
        first = np.nonzero(np.concatenate([[True], (np.diff(rows[:2], axis=1) != 0).any(0)]))[0] if rows.shape[1] else np.zeros(0, np.int64)
        return batch_of(rows[:, first], np.diff(np.append(first, rows.shape[1])))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for keys, texts in _chunks(batch):
                rows = found(keys, texts)
                if not merge:
                    yield batch_of(rows)
                    continue
                parts.append(rows)
                held += rows.shape[1]
                if held >= HELD:
                    yield merged(parts)
                    parts, held = [], 0
        if parts:
            yield merged(parts)
        give_back()

    return run


_CUT = "_group long, _anchor long, _region long, _copies long, _start int, _words binary"
_RUNS = "_anchor long, _region long, _start int, _end int"


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each lo on, n of them, one range after the other."""
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _cut_regions(window: int):
    """Rows with a text and its regions to the regions' words; of anchors with very many regions to their windows' hashes.

    What may match has the same _group: the anchor of words, the hash of a window (which has no words).
    """
    names = [c.split()[0] for c in _CUT.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in _by_bytes(b)):
            words, count = word_hashes(batch.column("_text").to_pylist())
            regions = batch.column("_regions")
            of = pc.list_parent_indices(regions).to_numpy()
            anchor, region, copies, lo, n, many = (x.to_numpy(zero_copy_only=False) for x in regions.flatten().flatten())
            lo = lo + (np.cumsum(count) - count)[of]
            sums = _sums(words) if many.any() else None
            for part in (np.arange(k, min(k + 4096, len(n))) for k in range(0, len(n), 4096)):
                whole, split = part[~many[part]], part[many[part]]
                sizes = n[whole].astype(np.int64) + window - 1
                ends = np.concatenate([[0], np.cumsum(sizes) * 8]).astype(np.int32)
                bodies = pa.Array.from_buffers(pa.binary(), len(whole), [None, pa.py_buffer(ends), pa.py_buffer(words[_ranges(lo[whole], sizes)])])
                yield pa.RecordBatch.from_arrays([*(pa.array(x[whole]) for x in (anchor, anchor, region, copies)), pa.array(np.zeros(len(whole), np.int32)), bodies], names)
                if len(split):
                    sizes = n[split].astype(np.int64)
                    at = _ranges(lo[split], sizes)
                    groups, starts = _between(sums, at, at + window).view(np.int64), _ranges(np.zeros(len(split), np.int64), sizes).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(groups), *(pa.array(np.repeat(x[split], sizes)) for x in (anchor, region, copies)), pa.array(starts), pa.nulls(len(at), pa.binary())], names)

    return run


def _match_regions(window: int):
    """Rows sorted by _group and _anchor to the windows of each region that occur twice, as runs."""

    def runs(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x if k < 2 else x.astype(np.int32)) for k, x in enumerate(columns)], ["_anchor", "_region", "_start", "_end"])

    def solve(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        anchor, region, copies, sizes, words = (np.concatenate(x) for x in zip(*held))
        long = matching_statistics(words, sizes, copies) >= window
        # a place more after each region, so that no run goes on into the next
        edge = np.diff(np.concatenate([[False], np.insert(long, np.cumsum(sizes), False)]).view(np.int8))
        s, e = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        ends = np.cumsum(sizes + 1)
        owner = np.searchsorted(ends, s, side="right")
        base = (ends - sizes - 1)[owner]
        return runs(anchor[owner], region[owner], s - base, e - base)

    def columns_of(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
        return [batch.column(c).to_numpy() for c in names]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size, last = 0, None
        # of the group of windows that came last: its first row, and whether that is still to be given out
        open_ = np.zeros((6, 0), np.int64)
        for batch in batches:
            is_whole = batch.column("_words").is_valid()
            whole, split = batch.filter(is_whole), batch.filter(pc.invert(is_whole))
            if whole.num_rows:
                anchor, region, copies = columns_of(whole, "_anchor", "_region", "_copies")
                sizes = pc.binary_length(whole.column("_words")).to_numpy().astype(np.int64) // 8
                words = np.frombuffer(b"".join(whole.column("_words").to_pylist()), np.uint64)
                ends = np.cumsum(sizes)
                # a shard that has its size ends where the next anchor begins
                begins = np.nonzero(np.concatenate([[anchor[0] != last], anchor[1:] != anchor[:-1]]))[0]
                before, at, read = (ends - sizes)[begins], 0, 0
                while True:
                    k = np.searchsorted(before, SHARD_WORDS - size + read)
                    to = int(begins[k]) if k < len(begins) else len(anchor)
                    if to > at:
                        held.append((anchor[at:to], region[at:to], copies[at:to], sizes[at:to], words[read : ends[to - 1]]))
                        size, read, at = size + int(ends[to - 1]) - read, int(ends[to - 1]), to
                    if k == len(begins):
                        break
                    yield solve(held)
                    held, size = [], 0
                last = anchor[-1]
            if split.num_rows:
                rows = np.stack([*columns_of(split, "_group", "_anchor", "_region", "_start", "_copies"), np.ones(split.num_rows, np.int64)])
                rows = np.concatenate([open_, rows], axis=1)
                group = np.cumsum((np.diff(rows[:2], axis=1, prepend=rows[:2, :1]) != 0).any(0))
                twice = np.bincount(group, rows[4])[group] > 1
                out = rows[:, twice & (rows[5] == 1)]
                yield runs(out[1], out[2], out[3], out[3] + 1)
                open_ = rows[:, -1:].copy()
                if twice[-1]:
                    open_[4:, 0] = 2, 0
        if held:
            yield solve(held)
        give_back()

    return run


# ---------------------------------------------------------------- operator


def find_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, finish: tuple[Callable, str] | None = None) -> DataFrame:
    """(id, _text, _spans) of every row: its text as UTF-8 bytes, and the maximal runs of its words that go, as [start, end).

    finish: a function of batches of these and the schema of what it gives, which is returned instead. It runs in the same
    Python workers, so that texts aren't sent to others.

    A word goes if a string of ``window`` consecutive words that it is in also starts anywhere else, the same row included.
    Words are runs of anything but ASCII white space. Null text: no words. Texts of fewer than ``window`` words: nothing
    goes. Null and repeated ids are allowed: every row is returned, and equal rows are copies of each other. Very long
    texts are read whole. Empty table: empty result. Other columns are ignored.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([pa.field("_row", pa.int64(), False), pa.field("_id", pa.int64()), pa.field("_text", pa.binary(), False)])
        for b in (part for whole in batches for part in _slices(whole)):
            ids, texts = b.column("_id"), b.column("_text")
            rows = [row_key(i, t) for i, t in zip(ids.to_pylist(), texts.to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), ids, texts], schema=schema)

    bytes_ = docs.select(F.col(id_col).cast("long").alias("_id"), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("_text"))
    texts = bytes_.mapInArrow(keyed, ROWS).repartition(n, "_row")
    slim = bytes_.where(F.length("_text") >= 2 * window - 1)

    # distinct regions of anchors that occur at least twice. A task's copies have been merged, so that a region that very
    # many documents share is a row a task; one exchange, by anchor, serves both aggregates
    merged = slim.mapInArrow(_anchor_rows(window, True), _ANCHOR + ", _copies long").repartition(n, "_anchor")
    regions = merged.groupBy("_anchor", "_region").agg(
        F.sum("_copies").alias("_copies"), F.first("_row").alias("_row"), F.first("_lo").alias("_lo"), F.first("_windows").alias("_windows")
    )
    by_anchor = Window.partitionBy("_anchor")
    shared = regions.withColumn("_all", F.sum("_copies").over(by_anchor)).withColumn("_many", F.count(F.lit(1)).over(by_anchor) > MOST_REGIONS).where("_all > 1")
    wanted = shared.groupBy("_row").agg(F.collect_list(F.struct("_anchor", "_region", "_copies", "_lo", "_windows", "_many")).alias("_regions"))
    cut = texts.join(wanted, "_row").mapInArrow(_cut_regions(window), _CUT)
    # both kinds of rows by one exchange, as two would read and cut all texts twice; each different window of an anchor
    # with very many regions is dealt as a group of its own
    runs = cut.repartition(n, "_group").sortWithinPartitions("_group", "_anchor").mapInArrow(_match_regions(window), _RUNS)

    # back to all documents that have the region
    every = slim.mapInArrow(_anchor_rows(window, False), _ANCHOR).select("_anchor", "_region", "_row", "_lo")
    starts = every.join(runs, ["_anchor", "_region"]).select("_row", (F.col("_lo") + F.col("_start")).alias("_s"), (F.col("_lo") + F.col("_end")).alias("_e"))
    per_row = starts.groupBy("_row").agg(F.collect_set(F.struct("_s", "_e")).alias("_starts"))

    def spans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in (part for whole in batches for part in _slices(whole)):
            starts = b.column("_starts")
            every_run = list(zip(*(x.to_numpy(zero_copy_only=False).tolist() for x in starts.flatten().flatten())))
            found, at = [], 0
            for n_runs in pc.fill_null(pc.list_value_length(starts), 0).to_pylist():
                runs_ = every_run[at : at + n_runs]
                at += n_runs
                found.append([{"start": s, "end": e} for s, e in removed_spans(max((e for _, e in runs_), default=0) + window, runs_, window)])
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_text"), pa.array(found, kind)], [id_col, "_text", "_spans"])

    found = texts.join(per_row, "_row", "left")
    if finish:
        return found.mapInArrow(lambda batches: finish[0](spans(batches)), finish[1])
    return found.mapInArrow(spans, f"`{id_col}` long, _text binary, _spans array<struct<start:long,end:long>>")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 35-word strings that start more than once in the corpus.

    Windows don't cross documents and are judged on the input; one that starts twice in the same document, overlaps
    included, goes at both places.
    """
    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, spans in zip(b.column("_text").to_pylist(), b.column("_spans").to_pylist()):
                words, kept, at = t.split(), [], 0
                for s in spans:
                    kept += words[at : s["start"]]
                    at = s["end"]
                kept += words[at:]
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return find_repeated_words(table(spark, sf_dir, "documents"), finish=(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string"))


#: Equal windows are found by their digests.
OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT r, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS k FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 33, 1))) AS i FROM d)),
twice AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM w SEMI JOIN twice USING (k)),
words AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.r = kept.r
"""
