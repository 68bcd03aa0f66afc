"""Reads to annotated reads: hits from the matching kernel, everything else as column expressions.

The kernel is an Arrow UDF of the sequence alone, and so a narrow operation: no shuffle, whatever the number of reads.
What a query doesn't ask for, hits and scores included, is pruned from its plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions import columns as C
from strandmill.operators import matching, structure
from strandmill.settings import Settings

HIT = "struct<start:int,end:int,anchor:string,distance:int,substitutions:int,insertions:int,deletions:int,cigar:string,matched:string>"
_HIT_TYPES = [(n, pa.string() if n in ("anchor", "cigar", "matched") else pa.int32()) for n in ("start", "end", "anchor", "distance", "substitutions", "insertions", "deletions", "cigar", "matched")]
#: Bases that are searched as one array.
BATCH_BASES = 1 << 20
_PHRED = np.arange(-33, 223)
_ERRORS = 10.0 ** (-_PHRED / 10)


def quality_scores(qualities: pa.Array, conservative: bool = True) -> np.ndarray:
    """Of each string of qualities the Phred score of the mean error rate, or the mean Phred score; 0 for none."""
    texts = qualities.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    codes = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    if len(codes) and codes.max() > 127:  # one byte a character again
        each = [t.encode("latin-1", "replace") for t in texts.to_pylist()]
        codes, ends = np.frombuffer(b"".join(each), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in each])])
    n, at = np.diff(ends), ends[:-1] - ends[0]
    out = np.zeros(len(n))
    some = n > 0
    if some.any():
        mean = np.add.reduceat((_ERRORS if conservative else _PHRED)[codes], at[some]) / n[some]
        out[some] = np.where(mean > 0, -10 * np.log10(np.where(mean > 0, mean, 1)), 0.0) if conservative else mean
    return out


def quality_score(quality: str, conservative: bool = True) -> float:
    return float(quality_scores(pa.array([quality]), conservative)[0])


def read_scores(method: str):
    @F.arrow_udf("double")
    def scored(qualities: pa.Array) -> pa.Array:
        return pa.array(quality_scores(qualities, method == "conservative"))

    return scored


def part_scores():
    @F.arrow_udf("array<double>")
    def scored(parts: pa.Array) -> pa.Array:
        flat = parts.flatten()
        ends = np.concatenate([[0], np.cumsum(parts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(quality_scores(flat)))

    return scored


def _stretches(sequences: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of sequences of about BATCH_BASES together, or one longer one."""
    lo = bases = 0
    for i, x in enumerate(sequences):
        bases += len(x)
        if bases >= BATCH_BASES:
            yield lo, i + 1
            lo, bases = i + 1, 0
    if lo < len(sequences):
        yield lo, len(sequences)


def hit_lists(found: list[list[tuple]]) -> pa.ListArray:
    """Hits of each read as Arrow lists, made column by column."""
    ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    columns = list(zip(*(h for x in found for h in x))) or [()] * len(_HIT_TYPES)
    fields = [pa.array(c, t) for c, (_, t) in zip(columns, _HIT_TYPES)]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, [n for n, _ in _HIT_TYPES]))


def find_hits(s: Settings):
    """A UDF of the sequence: the hits of each strand, read in that strand's direction."""
    anchors = s.anchors

    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        probes = matching.compile_anchors(anchors)
        for b in batches:
            sequences = [x or "" for x in b.to_pylist()]
            forward: list[list[tuple]] = []
            reverse: list[list[tuple]] = []
            for lo, hi in _stretches(sequences):
                forward += matching.find_hits_in_all(sequences[lo:hi], probes)
                reverse += matching.find_hits_in_all([matching.reverse_complement(x) for x in sequences[lo:hi]], probes)
            yield pa.StructArray.from_arrays([hit_lists(forward), hit_lists(reverse)], ["forward", "reverse"])

    both.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # not to be evaluated a second time for a filter on what is worked out from it
    return F.arrow_udf(both, f"struct<forward:array<{HIT}>,reverse:array<{HIT}>>").asNondeterministic()


def strand_hits(reads: DataFrame, s: Settings) -> DataFrame:
    """(read_index, is_reversed, hit) of every hit on either strand, whichever a structure would choose."""
    found = reads.select("read_index", find_hits(s)(F.col("sequence")).alias("_found"))
    side = lambda rev, name: F.struct(F.lit(rev).alias("is_reversed"), F.col("_found")[name].alias("hits"))
    sides = found.select("read_index", F.explode(F.array(side(False, "forward"), side(True, "reverse"))).alias("_s"))
    return sides.select("read_index", "_s.is_reversed", F.explode("_s.hits").alias("hit"))


def annotate(reads: DataFrame, s: Settings) -> DataFrame:
    """reads (read_index, read_id, sequence, quality, and others) with structure, offsets, segments, flags and bucket."""
    matching.compile_anchors(s.anchors)  # so that mistakes in them show here, not in a task
    found = reads.withColumn("_found", find_hits(s)(F.col("sequence")))
    return annotate_hits(found.withColumns({"_forward": F.col("_found.forward"), "_reverse": F.col("_found.reverse")}).drop("_found"), s)


def annotate_hits(found: DataFrame, s: Settings) -> DataFrame:
    """As :func:`annotate`, of reads whose hits on each strand are there, as _forward and _reverse."""
    order, reads = s.structure.expected_order, found.columns
    seq, n = F.coalesce("sequence", F.lit("")), F.col("length")
    anchors = [a.name for a in s.anchors]
    entries = ", ".join(f"named_struct('k', {structure.text(a)}, 'v', {C.best_of('hits', a)})" for a in anchors)
    best = F.expr(f"map_from_entries(filter(array({entries}), e -> e.v IS NOT NULL))" if anchors else f"cast(map() as map<string,{HIT}>)")
    told = structure.choose_strand(found.withColumn("length", F.length(seq)), s.structure)
    told = told.withColumn("best", best).withColumns({
        "_sequence": oriented_of(F.col("is_reversed"), seq, C.reverse_complement), "_quality": oriented_of(F.col("is_reversed"), F.coalesce("quality", F.lit("")), F.reverse),
    })
    told = structure.with_segments(told, s.structure.segments, "_sequence", "_quality", part_scores())
    told = (
        told.withColumn("molecules", structure.molecules(s.structure, "_sequence", "_quality"))
        .withColumn("read_qscore", read_scores(s.qscore_method)(F.coalesce("quality", F.lit(""))))
        .drop("_sequence", "_quality", "_cycles")
        .withColumns({
            "n_fraction": C.share(C.n_count(seq), n), "invalid_fraction": C.share(C.invalid_count(seq), n),
            "five_prime_offset": C.five_prime_offset(F.col("best"), order, n), "three_prime_offset": C.three_prime_offset(F.col("best"), order, n),
        })
        .withColumn("flags", C.qc_flags(s))
        .withColumn("bucket", C.qc_bucket(F.col("flags")))
        .withColumn("orientation", F.when(F.col("is_reversed"), "reversed").otherwise("forward"))
    )
    return told.withColumns({c: held(F.col(c)) for c in told.columns if c not in reads})


def held(c: Column) -> Column:
    """The column as it is, though the optimiser takes it for one that must not be worked out twice.

    Else it would put copies of all the expressions behind a column into each filter on it, below the steps that are to
    work them out once.
    """
    return F.when(F.spark_partition_id() >= 0, c)


def oriented_of(is_reversed: Column, text: Column, turned) -> Column:
    return F.when(is_reversed, turned(text)).otherwise(text)


def oriented(annotated: DataFrame) -> DataFrame:
    """annotated with the sequence and quality of the strand that was chosen."""
    rev = F.col("is_reversed")
    return annotated.withColumns({
        "oriented_sequence": oriented_of(rev, F.col("sequence"), C.reverse_complement), "oriented_quality": oriented_of(rev, F.col("quality"), F.reverse),
    })
