"""One mergeable state that holds all a summary and its plots need, from one pass over annotated reads.

A read gives a few cells (a kind, up to three names, up to two whole numbers, some measures); cells of one key are
counted and summed, within tasks first. States of tasks, samples, files and stream batches are merged by adding up
cells, so one aggregation serves a sample, a batch keyed by sample, or a stream. Names have few values and whole
numbers are binned or bounded by a read's length, so a state is small whatever the number of reads.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from strandmill.operators import metrics as M
from strandmill.settings import Settings

KEY = ("kind", "a", "b", "c", "n", "m")
MEASURES = tuple(f"v{i}" for i in range(9))
#: What the measures of the kind ``total`` count, in their order.
TOTALS = ("order_valid", "reversed", "long_high_quality", "five_prime_truncated", "three_prime_truncated", "high_n", "invalid_bases", "concatemer_parents", "molecules")


def cell(kind: str, *measures: Column, when: Column | None = None, **key: Column) -> Column:
    """A struct of a key and measures, whose absent parts are null; null itself unless ``when`` holds."""
    names = [F.lit(kind).alias("kind"), *[key.get(k, F.lit(None)).cast("string").alias(k) for k in ("a", "b", "c")]]
    numbers = [key.get(k, F.lit(None)).cast("long").alias(k) for k in ("n", "m")]
    values = [(measures[i] if i < len(measures) else F.lit(None)).cast("double").alias(v) for i, v in enumerate(MEASURES)]
    made = F.struct(*names, *numbers, *values)
    return made if when is None else F.when(when, made)


def cells(df: DataFrame, s: Settings, *by: str) -> DataFrame:
    """The cells of annotated reads: columns ``by`` (a sample's name, say), KEY, MEASURES and read_index. A narrow step."""
    t = s.thresholds
    far, length, q = t.terminal_anchor_max_offset, F.col("length"), F.col("read_qscore")
    flags = (
        F.col("order_valid"), F.col("is_reversed"), (length >= t.long_read_min_bp) & (q >= t.long_read_min_q), F.col("five_prime_offset") > far,
        F.col("three_prime_offset") > far, F.col("n_fraction") >= t.high_n_fraction, F.col("invalid_fraction") > 0, F.size("molecules") > 0,
    )
    ones = [F.coalesce(f.cast("int"), F.lit(0)) for f in flags]
    hits = lambda a: F.size(F.filter("hits", lambda h: h["anchor"] == a))
    anchors = F.transform(F.map_entries("best"), lambda e: cell(
        "anchor", *[e["value"][x] for x in ("distance", "substitutions", "insertions", "deletions")], (hits(e["key"]) > 1).cast("int"), hits(e["key"]),
        F.when(length > 0, e["value"]["start"] / length).otherwise(0.0), a=e["key"],
    ))
    seen = lambda g: g["length"].isNotNull()
    segments = F.transform("segments", lambda g: cell(
        "segment", seen(g).cast("int"), g["length"], g["gc_fraction"], g["gc_fraction"].isNotNull().cast("int"), g["n_fraction"], g["n_fraction"].isNotNull().cast("int"),
        a=g["name"], b=g["status"],
    ))
    lengths = F.transform(F.filter("segments", seen), lambda g: cell("segment_length", a=g["name"], n=g["length"]))
    scores = F.transform(F.filter("segments", seen), lambda g: cell("segment_quality", a=g["name"], n=F.rint(F.coalesce(g["mean_qscore"], F.lit(0.0)) * M.Q_SCALE)))
    starts, stops = M.coverage_events()
    change = lambda at, by: F.transform(at, lambda b: cell("heat", F.lit(by), a=F.col("bucket"), b=F.col("label"), n=b))
    single = [
        cell("total", *ones, F.coalesce(F.size("molecules"), F.lit(0))), cell("length", n=length), cell("qscore", n=F.rint(q * M.Q_SCALE)),
        cell("bin", n=F.rint(length / M.LENGTH_BIN) * M.LENGTH_BIN, m=F.rint(q / M.Q_BIN)), cell("class", a=F.col("label"), b=F.col("bucket"), c=F.col("orientation")),
    ]
    if s.barcode.enabled and "barcode_status" in df.columns:
        single += [cell("barcode_status", a=F.col("barcode_status")), cell("barcode_distance", when=F.col("nearest_distance").isNotNull(), n=F.col("nearest_distance"))]
    every = F.concat(F.array_compact(F.array(*single)), anchors, segments, lengths, scores, change(starts, 1), change(stops, -1))
    return df.select(*by, "read_index", F.inline(every))


def quality_cells(reads: DataFrame) -> DataFrame:
    """The cells of the scores of all bases of a table of reads."""
    counts = M.base_quality_histogram(reads)
    return counts.select(F.lit(None).cast("long").alias("read_index"), F.inline(F.array(cell("phred", F.col("count"), n=F.col("phred")))))


def state(found: DataFrame, *by: str) -> DataFrame:
    """Cells counted and summed: one row for each key."""
    return found.groupBy(*by, *KEY).agg(F.count(F.lit(1)).alias("count"), F.min("read_index").alias("first"), *[F.sum(v).alias(v) for v in MEASURES])


def merge(*states: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """States of different reads as one."""
    whole = states[0]
    for other in states[1:]:
        whole = whole.unionByName(other)
    return whole.groupBy(*by, *KEY).agg(F.sum("count").alias("count"), F.min("first").alias("first"), *[F.sum(v).alias(v) for v in MEASURES])


class Middle(NamedTuple):
    median: float
    n50: int


class Summary:
    """A state's rows, read into the parts of a report."""

    def __init__(self, rows: Iterable[Row]):
        self.kinds: dict[str, list[Row]] = {}
        for r in rows:
            self.kinds.setdefault(r.kind, []).append(r)

    def of(self, kind: str) -> list[Row]:
        return self.kinds.get(kind, [])

    def totals(self) -> dict[str, int]:
        found = self.of("total")
        return {"reads": sum(r["count"] for r in found), **{name: int(sum(r[v] for r in found)) for name, v in zip(TOTALS, MEASURES)}}

    def histogram(self, kind: str, name: str | None = None) -> dict[int, int]:
        """Counts by whole number, ascending."""
        return dict(sorted((r.n, r["count"]) for r in self.of(kind) if name is None or r.a == name))

    def counts(self, kind: str, *names: str) -> dict:
        """(count, first) by one or several of a kind's names, in the order of first reads."""
        out: dict = {}
        for r in sorted(self.of(kind), key=lambda r: r.first):
            key = r[names[0]] if len(names) == 1 else tuple(r[x] for x in names)
            n, first = out.get(key, (0, r.first))
            out[key] = (n + r["count"], first)
        return out

    def anchors(self) -> dict[str, dict]:
        names = ("mean_best_mismatches", "mean_best_substitutions", "mean_best_insertions", "mean_best_deletions", "multi_hit_ratio", "mean_hits_per_positive_read", "mean_position")
        return {r.a: {"reads": r["count"], **{k: r[v] / r["count"] for k, v in zip(names, MEASURES)}} for r in self.of("anchor")}

    def segments(self) -> dict[str, dict]:
        out = {}
        for name in dict.fromkeys(r.a for r in self.of("segment")):
            rows = [r for r in self.of("segment") if r.a == name]
            n = sum(r["count"] for r in rows)
            add = lambda i, rows=rows: sum(r[f"v{i}"] or 0.0 for r in rows)
            among = lambda status, rows=rows: sum(r["count"] for r in rows if r.b == status)
            mean = lambda total, k: total / k if k else 0.0
            seen = int(add(0))
            out[name] = {
                "total_reads": n, "observed_reads": seen, "observed_ratio": seen / n, "missing_ratio": among("missing") / n,
                "within_length_ratio": mean(sum(r.v0 for r in rows if r.b == "pass"), seen), "mean_length": mean(add(1), seen),
                "median_length": middle(self.histogram("segment_length", name)).median, "median_qscore": middle(self.histogram("segment_quality", name)).median / M.Q_SCALE,
                "mean_gc_fraction": mean(add(2), int(add(3))), "mean_n_fraction": mean(add(4), int(add(5))),
            }
        return out

    def coverage(self) -> Iterator[tuple[str, str, int, int]]:
        """(bucket, label, hundredth, reads) where there are any, from running sums of the changes."""
        changes: dict[tuple[str, str], dict[int, int]] = {}
        for r in self.of("heat"):
            changes.setdefault((r.a, r.b), {})[r.n] = int(r.v0)
        for (bucket, label), at in changes.items():
            reads = 0
            for b in range(M.HEAT_BINS):
                reads += at.get(b, 0)
                if reads:
                    yield bucket, label, b, reads


def middle(hist: dict[int, int]) -> Middle:
    """Median and N50 of a histogram whose values ascend; zeros if it is empty."""
    count, bases = sum(hist.values()), sum(v * k for v, k in hist.items())
    low = high = None
    n50 = seen = below = 0
    for value, k in hist.items():
        seen += k
        low = value if low is None and seen > (count - 1) // 2 else low
        high = value if high is None and seen > count // 2 else high
        n50 = value if (bases - below) * 2 >= bases else n50
        below += value * k
    return Middle((low + high) / 2 if hist else 0.0, n50)


def barcode_figures(df: DataFrame, k: int = M.TOP_BARCODES) -> DataFrame:
    """Rows (kind, value, count, first): the k most frequent barcodes, and of barcodes and of UMIs how many differ and occur once.

    Both come from one exchange of distinct values with their counts.
    """
    value = lambda kind, c: F.when(F.length(c) > 0, F.struct(F.lit(kind).alias("kind"), F.col(c).alias("value")))
    each = df.select("read_index", F.inline(F.array_compact(F.array(value("barcode", "raw_barcode"), value("umi", "raw_umi")))))
    per = each.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("count"), F.min("read_index").alias("first"))
    whole = per.groupBy("kind").agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("count") == 1).alias("first"))
    top = per.orderBy(F.when(F.col("kind") == "barcode", 0).otherwise(1), F.desc("count"), "first").limit(k).where("kind = 'barcode'")
    return top.unionByName(whole.select("kind", F.lit(None).cast("string").alias("value"), "count", "first"))
