"""Column expressions over reads and their hits; all of them native, so Catalyst sees through them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandmill.settings import Settings, Thresholds

# Flags that labels stand for, and flags in the order in which they decide a read's bucket.
LABEL_FLAGS = {
    "no_anchor_detected": "no_anchor", "missing_5p_anchor": "missing_5p", "missing_3p_anchor": "missing_3p",
    "anchor_order_invalid": "order_invalid", "duplicated_anchor": "multi_anchor", "internal_5p_anchor": "internal_adapter",
    "internal_3p_anchor": "internal_adapter", "concatemer_candidate": "concatemer_candidate",
    "structure_rule_violation": "structure_rule_violation", "orientation_unexpected": "orientation_unexpected",
    "partial_structure": "partial_structure",
}
BUCKETS = (
    "empty_read", "too_short", "low_read_q", "invalid_bases", "high_n", "no_anchor", "internal_adapter", "concatemer_candidate",
    "structure_rule_violation", "orientation_unexpected", "multi_anchor", "order_invalid", "partial_structure", "missing_5p",
    "missing_3p", "five_prime_truncated", "three_prime_truncated", "segment_too_short", "segment_too_long", "dense_anchor_hits",
)


def n_count(seq: Column) -> Column:
    return F.length(seq) - F.length(F.translate(seq, "Nn", ""))


def invalid_count(seq: Column) -> Column:
    return F.length(F.translate(F.upper(seq), "ACGTN", ""))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is nothing."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTNacgtn", "TGCANtgcan"))


def phred(quality: Column) -> Column:
    """Array of Phred scores; short-lived, for expressions that fold over it."""
    return F.transform(F.filter(F.split(quality, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)


def mean_q(quality: Column) -> Column:
    return share(F.aggregate(phred(quality), F.lit(0).cast("long"), lambda a, q: a + q), F.length(quality))


def conservative_q(quality: Column) -> Column:
    """Phred score of the mean error rate."""
    errors = F.aggregate(phred(quality), F.lit(0.0), lambda a, q: a + F.pow(F.lit(10.0), -q / F.lit(10.0)))
    return F.when(F.length(quality) > 0, -10 * F.log10(errors / F.length(quality))).otherwise(F.lit(0.0))


def read_q(quality: Column, method: str) -> Column:
    return conservative_q(quality) if method == "conservative" else mean_q(quality)


def levenshtein_within(a: Column, b: Column, most: int) -> Column:
    """Edit distance, or most + 1 where it is greater."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def best_of(hits: str, anchor: str) -> str:
    """SQL of an anchor's best hit in a column of hits: least distance, then first place; null without any."""
    name = anchor.replace("\\", "\\\\").replace("'", "\\'")
    return f"array_min(transform(filter({hits}, h -> h.anchor = '{name}'), h -> named_struct('d', h.distance, 's', h.start, 'e', h.end, 'h', h))).h"


def five_prime_offset(best: Column, order: list[str], length: Column) -> Column:
    if not order:
        return F.lit(None).cast("double")
    return F.when(length > 0, F.try_element_at(best, F.lit(order[0]))["start"] / length)


def three_prime_offset(best: Column, order: list[str], length: Column) -> Column:
    if not order:
        return F.lit(None).cast("double")
    return F.when(length > 0, (length - F.try_element_at(best, F.lit(order[-1]))["end"]) / length)


def qc_flags(s: Settings) -> Column:
    """Flags of an annotated read, in the order in which they are checked."""
    t: Thresholds = s.thresholds
    labels = F.create_map(*[F.lit(x) for pair in LABEL_FLAGS.items() for x in pair])
    dense = 2 * max(1, len(s.structure.expected_order))
    checks = [
        (F.col("length") == 0, "empty_read"), (F.col("length") < t.long_read_min_bp, "too_short"),
        (F.col("read_qscore") < t.long_read_min_q, "low_read_q"), (F.col("n_fraction") >= t.high_n_fraction, "high_n"),
        (F.col("invalid_fraction") > 0, "invalid_bases"), (F.lit(True), F.try_element_at(labels, F.col("label"))),
        (F.col("five_prime_offset") > t.terminal_anchor_max_offset, "five_prime_truncated"),
        (F.col("three_prime_offset") > t.terminal_anchor_max_offset, "three_prime_truncated"), (F.size("hits") > dense, "dense_anchor_hits"),
    ]
    own = F.array(*[F.when(test, flag if isinstance(flag, Column) else F.lit(flag)) for test, flag in checks])
    parts = F.transform(
        F.filter("segments", lambda g: ~g["status"].isin("pass", "missing")), lambda g: F.concat(F.lit("segment_"), g["status"])
    )
    return F.array_distinct(F.array_compact(F.concat(own, parts)))


def qc_bucket(flags: Column) -> Column:
    """The first flag in order of importance; ``pass`` without any."""
    return F.coalesce(*[F.when(F.array_contains(flags, b), F.lit(b)) for b in BUCKETS], F.lit("pass"))


def level(value: Column, warn: float, fail: float, higher_is_better: bool) -> Column:
    """pass, warn or fail of a ratio."""
    worse = (lambda limit: value < limit) if higher_is_better else (lambda limit: value > limit)
    return F.when(worse(fail), "fail").when(worse(warn), "warn").otherwise("pass")
