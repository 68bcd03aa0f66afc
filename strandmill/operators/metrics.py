"""Aggregates over annotated reads, each a DataFrame; those of few rows are then read into one summary.

Histograms keep exact values with their counts, so medians and N50 are taken from tables of distinct values and not
from all reads in one task. Rows that a report lists carry the least read_index, which breaks ties as the file would.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.operators.annotate import held
from strandmill.settings import Settings

#: Scales and bins of the reports.
Q_SCALE, LENGTH_BIN, Q_BIN, HEAT_BINS, TOP_BARCODES = 100, 50, 0.5, 100, 50


def histogram(df: DataFrame, value: Column, name: str) -> DataFrame:
    return df.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("count"))


def length_histogram(df: DataFrame) -> DataFrame:
    return histogram(df, F.col("length"), "length")


def qscore_histogram(df: DataFrame) -> DataFrame:
    """Read scores times 100, rounded half to even."""
    return histogram(df, F.rint(F.col("read_qscore") * Q_SCALE).cast("long"), "qscore")


def length_q_bins(df: DataFrame) -> DataFrame:
    return df.groupBy(
        (F.rint(F.col("length") / LENGTH_BIN) * LENGTH_BIN).cast("long").alias("length_bin"), (F.rint(F.col("read_qscore") / Q_BIN) * Q_BIN).alias("qscore_bin")
    ).agg(F.count(F.lit(1)).alias("count"))


def base_quality_histogram(reads: DataFrame) -> DataFrame:
    """How often each Phred score occurs over all bases; a task sends one row a score, never its bases."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for b in batches:
            total += byte_counts(b.column("quality"))
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32) - 33), pa.array(total[at])], ["phred", "n"])

    return reads.select("quality").mapInArrow(run, "phred int, n long").groupBy("phred").agg(F.sum("n").alias("count"))


def byte_counts(texts: pa.Array) -> np.ndarray:
    """How often each byte occurs in a column of texts of one byte a character, counted in its buffer."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return np.zeros(256, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.bincount(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8), minlength=256)


#: Prefix sums are carried from blocks of values to the blocks' parts: bits that a block leaves to its parts, and blocks of blocks.
BLOCK_BITS, BLOCK_LEVELS = 10, 2


def prefix_sums(hist: DataFrame, value: str, **amounts: Column) -> DataFrame:
    """hist with, for each amount, ``<name>_before`` (its sum over smaller values), ``<name>_to`` (with this one's) and ``<name>_all``.

    Values are distinct whole numbers below 2^31 in size (rows with null are left out), amounts whole. Blocks of 1,024 values, and of 1,024 such
    blocks, are summed first; the coarsest ones, of which there are at most 4,096, are folded as one array, and each
    finer level adds what lies before it within its block. So no window holds more than 1,024 rows.
    """
    names = list(amounts)
    # held, so that each level reads the histogram's one exchange, and no filter of its own is put below that
    whole = hist.where(F.col(value).isNotNull()).withColumns({f"_{n}": amounts[n].cast("long") for n in names})
    levels = [whole.withColumn("_b0", held(F.col(value).cast("long")))]
    for k in range(1, BLOCK_LEVELS + 1):
        fine = f"_b{k - 1}"
        levels.append(levels[-1].groupBy(F.shiftright(fine, BLOCK_BITS).alias(f"_b{k}")).agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in names]))
    top = f"_b{BLOCK_LEVELS}"
    every = F.array_sort(F.collect_list(F.struct(top, *[f"_{n}" for n in names])))
    rows = levels[-1].groupBy().agg(every.alias("_e"), *[F.sum(f"_{n}").alias(f"{n}_all") for n in names])
    smaller = lambda e, n: F.aggregate(F.filter("_e", lambda o: o[top] < e[top]), F.lit(0).cast("long"), lambda a, o: a + o[f"_{n}"])
    blocks = F.transform("_e", lambda e: F.struct(e[top].alias(top), *[smaller(e, n).alias(f"{n}_before") for n in names]))
    above = rows.select(F.inline(blocks), *[f"{n}_all" for n in names])
    for k in reversed(range(BLOCK_LEVELS)):
        outer = f"_b{k + 1}"
        inside = Window.partitionBy(outer).orderBy(f"_b{k}").rowsBetween(Window.unboundedPreceding, -1)
        part = levels[k].withColumn(outer, F.shiftright(f"_b{k}", BLOCK_BITS))
        part = part.withColumns({f"_{n}_in": F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0).cast("long")) for n in names})
        above = part.join(above, outer).withColumns({f"{n}_before": F.col(f"{n}_before") + F.col(f"_{n}_in") for n in names}).drop(outer, *[f"_{n}_in" for n in names])
        if k:
            above = above.drop(*[f"_{n}" for n in names])
    return above.withColumns({f"{n}_to": F.col(f"{n}_before") + F.col(f"_{n}") for n in names}).drop("_b0", *[f"_{n}" for n in names])


def _middle(value: str, upper: bool) -> Column:
    """The lower or upper of the two middle values, by the prefix sums ``n`` of their counts; null if there are none."""
    rank = F.floor((F.col("n_all") - (0 if upper else 1)) / 2)
    return F.min(F.when(F.col("n_to") > rank, F.col(value))).cast("double")


def _n50(value: str) -> Column:
    return F.coalesce(F.max(F.when((F.col("b_all") - F.col("b_before")) * 2 >= F.col("b_all"), F.col(value))), F.lit(0))


def _bases(value: str) -> Column:
    return F.col(value).cast("long") * F.col("count")


def _median(value: str) -> Column:
    return F.coalesce((_middle(value, False) + _middle(value, True)) / 2, F.lit(0.0))


def median_of(hist: DataFrame, value: str, scale: float = 1.0) -> DataFrame:
    """The mean of the two middle values of a histogram; 0 if it is empty."""
    return prefix_sums(hist, value, n=F.col("count")).agg((_median(value) / scale).alias("median"))


def lower_median_of(hist: DataFrame, value: str) -> DataFrame:
    """The lower of the two middle values; null if empty."""
    return prefix_sums(hist, value, n=F.col("count")).agg(_middle(value, False).alias("median"))


def n50_of(hist: DataFrame, value: str = "length") -> DataFrame:
    """The greatest length at which it and all longer ones hold half of the bases; 0 if empty."""
    return prefix_sums(hist, value, b=_bases(value)).agg(_n50(value).alias("n50"))


def length_summary(hist: DataFrame) -> DataFrame:
    """N50, median and lower median of a histogram of lengths, in one row."""
    run = prefix_sums(hist, "length", n=F.col("count"), b=_bases("length"))
    return run.agg(_n50("length").cast("int").alias("n50"), _median("length").alias("median"), _middle("length", False).alias("lower_median"))


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("count"), F.min("read_index").alias("first"))


def totals(df: DataFrame, s: Settings, *more: Column) -> DataFrame:
    """One row: numbers of reads and bases, lengths, reads that meet each condition, and further aggregates."""
    t = s.thresholds
    far = t.terminal_anchor_max_offset
    return df.agg(
        F.count(F.lit(1)).alias("total_reads"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_bases"),
        F.coalesce(F.min("length"), F.lit(0)).alias("min_read_length"), F.coalesce(F.max("length"), F.lit(0)).alias("max_read_length"),
        F.count_if("order_valid").alias("order_valid"), F.count_if("is_reversed").alias("reversed"),
        F.count_if((F.col("length") >= t.long_read_min_bp) & (F.col("read_qscore") >= t.long_read_min_q)).alias("long_high_quality"),
        F.count_if(F.col("five_prime_offset") > far).alias("five_prime_truncated"), F.count_if(F.col("three_prime_offset") > far).alias("three_prime_truncated"),
        F.count_if(F.col("n_fraction") >= t.high_n_fraction).alias("high_n"), F.count_if(F.col("invalid_fraction") > 0).alias("invalid_bases"),
        F.count_if(F.size("molecules") > 0).alias("concatemer_parents"), F.coalesce(F.sum(F.size("molecules")), F.lit(0)).alias("molecules"), *more,
    )


def anchor_stats(df: DataFrame) -> DataFrame:
    """Per anchor with a hit: positive reads, mean distances of best hits, numbers of hits, mean relative place."""
    hits = F.filter("hits", lambda h: h["anchor"] == F.col("_anchor"))
    per = df.select("length", "hits", F.explode("best").alias("_anchor", "_b")).select("_anchor", "_b", "length", F.size(hits).alias("_n"))
    return per.groupBy(F.col("_anchor").alias("anchor")).agg(
        F.count(F.lit(1)).alias("reads"), F.avg("_b.distance").alias("mean_best_mismatches"), F.avg("_b.substitutions").alias("mean_best_substitutions"),
        F.avg("_b.insertions").alias("mean_best_insertions"), F.avg("_b.deletions").alias("mean_best_deletions"),
        F.avg((F.col("_n") > 1).cast("int")).alias("multi_hit_ratio"), F.avg("_n").alias("mean_hits_per_positive_read"),
        F.avg(F.when(F.col("length") > 0, F.col("_b.start") / F.col("length")).otherwise(0.0)).alias("mean_position"),
    )


def coverage_events() -> tuple[Column, Column]:
    """(starts, stops) of the runs of hundredths that a read's hits cover: its merged intervals, as ends of half-open ones."""
    n = F.col("length")
    place = lambda x: F.floor((x / n) * HEAT_BINS).cast("int")
    low = lambda h: F.least(F.lit(HEAT_BINS - 1), F.greatest(F.lit(0), place(h["start"])))
    bins = F.flatten(F.transform("hits", lambda h: F.sequence(low(h), F.least(F.lit(HEAT_BINS), F.greatest(low(h) + 1, place(h["end"]))) - 1)))
    none = F.array().cast("array<int>")
    bins = F.when((n > 0) & (F.size("hits") > 0), bins).otherwise(none)
    after = F.transform(bins, lambda b: b + 1)
    return F.array_except(bins, after), F.array_except(after, bins)


def heatmap(df: DataFrame) -> DataFrame:
    """Per bucket, label and hundredth of the read: how many reads have a hit there.

    A read gives +1 where a run of covered hundredths begins and -1 where it ends, not a row for each hundredth.
    """
    starts, stops = coverage_events()
    mark = lambda at, by: F.transform(at, lambda b: F.struct(b.alias("bin"), F.lit(by).alias("change")))
    events = df.select("bucket", "label", starts.alias("_up"), stops.alias("_down")).select(
        "bucket", "label", F.inline(F.concat(mark(F.col("_up"), 1), mark(F.col("_down"), -1)))
    )
    return covered_bins(events.groupBy("bucket", "label", "bin").agg(F.sum("change").alias("change")), "bucket", "label")


def covered_bins(changes: DataFrame, *by: str) -> DataFrame:
    """Reads in each hundredth, from the sums of the changes at (at most 101) hundredths of a group."""
    w = Window.partitionBy(*by).orderBy("bin")
    runs = changes.select(*by, "bin", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("reads"), F.lead("bin").over(w).alias("_next"))
    return runs.where("reads > 0").select(*by, F.explode(F.sequence(F.col("bin"), F.col("_next") - 1)).alias("bin"), "reads")


def segment_stats(df: DataFrame) -> DataFrame:
    """Per segment: reads, observed ones, ratios, mean and median length, median quality, mean GC and N share."""
    g = df.select(F.explode("segments").alias("g")).select("g.*")
    seen = F.col("length").isNotNull()
    quality = F.when(seen, F.rint(F.coalesce("mean_qscore", F.lit(0.0)) * Q_SCALE).cast("long"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return g.groupBy("name").agg(
        F.count(F.lit(1)).alias("total_reads"), F.count_if(seen).alias("observed_reads"), zero(F.count_if(seen) / F.count(F.lit(1))).alias("observed_ratio"),
        (F.count_if(F.col("status") == "missing") / F.count(F.lit(1))).alias("missing_ratio"),
        zero(F.try_divide(F.count_if(F.col("status") == "pass"), F.count_if(seen))).alias("within_length_ratio"),
        zero(F.avg("length")).alias("mean_length"), zero(F.median("length")).alias("median_length"), (zero(F.median(quality)) / Q_SCALE).alias("median_qscore"),
        zero(F.avg("gc_fraction")).alias("mean_gc_fraction"), zero(F.avg("n_fraction")).alias("mean_n_fraction"),
    )


def segment_statuses(df: DataFrame) -> DataFrame:
    return df.select(F.explode("segments").alias("g"), "read_index").groupBy(F.col("g.name").alias("name"), F.col("g.status").alias("status")).agg(
        F.count(F.lit(1)).alias("count"), F.min("read_index").alias("first")
    )


def top_barcodes(df: DataFrame, k: int = TOP_BARCODES) -> DataFrame:
    seen = df.where(F.length("raw_barcode") > 0)
    return counts_by(seen, "raw_barcode").orderBy(F.desc("count"), "first").limit(k)


def umi_stats(df: DataFrame) -> DataFrame:
    """One row: distinct UMIs, and the share of them seen once."""
    per = df.where(F.length("raw_umi") > 0).groupBy("raw_umi").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("unique_raw_umis"), F.coalesce(F.avg((F.col("n") == 1).cast("int")), F.lit(0.0)).alias("umi_singleton_ratio"))
