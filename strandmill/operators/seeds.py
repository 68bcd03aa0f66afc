"""Anchors in long reads by a join of seeds: every place of a read meets the pieces of all anchors at once.

A motif with up to k differences has one of k + 1 pieces unchanged (pigeonhole). The pieces of all anchors, those of the
reverse complement too, are a small broadcast table; the stretches of bases at every place of a read probe it in generated
code, so that the cost hardly depends on how many anchors there are. What meets is verified by column functions where
only mismatches are allowed; for anchors with edits the windows around it, joined where they overlap, go to an Arrow UDF
that aligns. Hits are gathered by read and joined back to the reads: only what later steps ask for of a read is shuffled.

Reads are told apart by read_index. It serves fixed anchors; with a regular expression among them use the other kernel.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions import columns as C
from strandmill.operators import matching
from strandmill.operators.annotate import HIT, annotate_hits, held, hit_lists
from strandmill.operators.structure import text
from strandmill.settings import Anchor, Settings

#: Longest stretch of bases that is looked up; longer pieces are looked for by their first bases.
LONGEST_SEED = 12
#: Most rows of the table of pieces, which is broadcast.
MOST_PIECES = 1 << 20
_PIECE = "seed binary, anchor int, turned boolean, motif binary, size int, at int, earlier array<struct<at:int,size:int>>, tolerance int, edits boolean, region string, window int"


def serves(anchors: list[Anchor]) -> bool:
    return all(a.type == "fixed" and a.sequence and a.sequence.isascii() for a in anchors)


def pieces(anchors: list[Anchor]) -> list[tuple]:
    """A row for each piece of each motif and of its reverse complement, as it stands on the forward strand."""
    out = []
    for number, a in enumerate(anchors):
        upper = a.sequence.upper()
        k = a.max_mismatches if a.max_edits is None else a.max_edits
        for turned, motif in ((False, upper), (True, matching.reverse_complement(upper))):
            n = min(k + 1, len(motif))
            cuts = [len(motif) * j // n for j in range(n + 1)]
            seeds = [(lo, min(hi - lo, LONGEST_SEED)) for lo, hi in zip(cuts, cuts[1:])]
            for j, (lo, size) in enumerate(seeds):
                out.append((motif[lo : lo + size].encode(), number, turned, motif.encode(), len(motif), lo, seeds[:j], k, a.max_edits is not None, a.search_region, a.search_window_bp))
    if len(out) > MOST_PIECES:
        raise ValueError(f"The anchors have {len(out)} pieces, above {MOST_PIECES}")
    return out


def _met(reads: DataFrame, anchors: list[Anchor]) -> DataFrame:
    """(read_index, text, n, a piece's columns, place): where a piece is met; text is upper case, one byte a base."""
    table = pieces(anchors)
    widths = sorted({len(r[0]) for r in table})
    found = reads.sparkSession.createDataFrame(table, _PIECE)
    # characters beyond ASCII are none of a motif's: one byte stands for each, so that places are those of characters
    bases = F.expr(r"encode(regexp_replace(upper(coalesce(sequence, '')), '[^\\x00-\\x7F]', '?'), 'UTF-8')")
    laid = reads.select("read_index", bases.alias("text")).withColumn("n", F.length("text")).where(F.col("n") >= widths[0])
    # an element of the array is read in generated code, and only what meets a piece becomes a row
    places = laid.select("*", F.explode(F.expr(f"sequence(0, n - {widths[0]})")).alias("place"))
    if len(widths) > 1:
        places = places.select("*", F.explode(F.array(*map(F.lit, widths))).alias("width")).where("place + width <= n")
    else:
        places = places.withColumn("width", F.lit(widths[0]))
    # a long key; and no filter of functions of arrays goes into the join, which then couldn't be in generated code
    probe = places.withColumn("key", F.expr("xxhash64(substring(text, place + 1, width))"))
    met = probe.join(F.broadcast(found.withColumn("key", F.xxhash64("seed"))), "key").where("substring(text, place + 1, width) = seed")
    return met.withColumn("place", held(F.col("place")))


def _bounds(start: str, end: str) -> str:
    """SQL of whether a stretch on the strand that was read lies where the anchor is looked for."""
    reach = "coalesce(window, n)"
    return f"CASE region WHEN '5p' THEN {end} <= {reach} WHEN '3p' THEN {start} >= n - {reach} ELSE true END"


def _mismatch_hits(met: DataFrame, names: str) -> DataFrame:
    """(read_index, turned, hit) of motifs with mismatches only."""
    at = met.where("NOT edits").withColumn("first", F.expr("place - at")).where("first >= 0 AND first + size <= n").withColumn("stretch", F.expr("substring(text, first + 1, size)"))
    # a place is told by the first piece that is met there
    at = at.where("NOT exists(earlier, e -> substring(stretch, e.at + 1, e.size) = substring(motif, e.at + 1, e.size))")
    at = at.withColumn("distance", F.expr("aggregate(sequence(1, size), 0, (d, i) -> d + if(substring(stretch, i, 1) = substring(motif, i, 1), 0, 1))")).where("distance <= tolerance")
    at = at.withColumn("start", F.expr("if(turned, n - first - size, first)")).where(_bounds("start", "start + size"))
    bases = F.col("stretch").cast("string")
    matched = F.when(F.col("turned"), C.reverse_complement(bases)).otherwise(bases)
    return at.withColumn("matched", matched).select("read_index", "turned", F.expr(
        f"named_struct('start', start, 'end', start + size, 'anchor', get({names}, anchor), 'distance', distance, 'substitutions', 0, 'insertions', 0, 'deletions', 0, 'cigar', '', 'matched', matched)"
    ).alias("hit"))


def _align(anchors: list[Anchor]):
    """A UDF of an anchor's number and the stretches of text to be aligned with it: each one's hits."""
    def aligned(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        probes = {k: matching.compile_anchors([a])[0] for k, a in enumerate(anchors) if a.max_edits is not None}
        for numbers, stretches in batches:
            rows = []
            for k, texts in zip(numbers.to_pylist(), stretches.to_pylist()):
                a = anchors[k]
                rows.append([(h[0] + t["lo"], h[1] + t["lo"], *h[2:]) for t in texts for h in matching.edit_hits(a.name, t["text"], probes[k], a.max_edits)])
            yield hit_lists(rows)

    aligned.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(aligned, f"array<{HIT}>").asNondeterministic()


def _edit_hits(met: DataFrame, anchors: list[Anchor]) -> DataFrame:
    """(read_index, turned, hit) of motifs with edits."""
    # what an alignment with so few edits around the piece can reach, and as much again, in which nothing else can end
    near = met.where("edits").withColumns({
        "lo": F.expr("greatest(0, place - at - 2 * tolerance - 2)"), "hi": F.expr("least(n, place - at + size + 2 * tolerance + 2)"),
    })
    strand = near.withColumns({"start": F.expr("if(turned, n - hi, lo)"), "stop": F.expr("if(turned, n - lo, hi)")})
    lowest, highest = "if(region = '3p', greatest(0, n - coalesce(window, n)), 0)", "if(region = '5p', least(n, coalesce(window, n)), n)"
    strand = strand.withColumns({"start": F.expr(f"greatest(start, {lowest})"), "stop": F.expr(f"least(stop, {highest})")}).where("start < stop")
    # of one read and anchor: windows that overlap or touch are one. The text comes with each of them, so that it needn't be fetched
    strand = strand.withColumn("bases", F.expr("cast(if(turned, substring(text, n - stop + 1, stop - start), substring(text, start + 1, stop - start)) as string)"))
    strand = strand.withColumn("bases", F.when(F.col("turned"), C.reverse_complement(F.col("bases"))).otherwise(F.col("bases")))
    windows = strand.groupBy("read_index", "turned", "anchor").agg(F.array_sort(F.collect_set(F.expr("named_struct('lo', start, 'hi', stop, 'text', bases)"))).alias("w"))
    joined = F.expr("""aggregate(w, cast(array() as array<struct<lo:int,hi:int,text:string>>), (done, x) -> CASE
        WHEN size(done) = 0 OR element_at(done, -1).hi < x.lo THEN concat(done, array(x))
        WHEN element_at(done, -1).hi >= x.hi THEN done
        ELSE concat(slice(done, 1, size(done) - 1), array(named_struct('lo', element_at(done, -1).lo, 'hi', x.hi,
          'text', concat(element_at(done, -1).text, substring(x.text, element_at(done, -1).hi - x.lo + 1))))) END)""")
    hits = _align(anchors)(F.col("anchor"), F.col("stretches"))
    return windows.withColumn("stretches", joined).select("read_index", "turned", F.explode(hits).alias("hit"))


def strand_hits(reads: DataFrame, anchors: list[Anchor]) -> DataFrame:
    """(read_index, turned, hit) of every hit, turned ones on the reverse strand and in its direction."""
    met = _met(reads, anchors)
    parts = []
    if any(a.max_edits is None for a in anchors):
        parts.append(_mismatch_hits(met, f"array({', '.join(text(a.name) for a in anchors)})"))
    if any(a.max_edits is not None for a in anchors):
        parts.append(_edit_hits(met, anchors))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def with_hits(reads: DataFrame, anchors: list[Anchor]) -> DataFrame:
    """reads with each strand's hits, sorted by place and anchor, as _forward and _reverse."""
    none = F.expr(f"cast(array() as array<{HIT}>)")
    if not anchors:
        return reads.withColumns({"_forward": none, "_reverse": none})
    own = lambda turned: F.array_sort(F.collect_list(F.when(F.col("turned") == turned, F.col("hit"))))
    gathered = strand_hits(reads, anchors).groupBy("read_index").agg(own(False).alias("_forward"), own(True).alias("_reverse"))
    return reads.join(gathered, "read_index", "left").withColumns({c: F.coalesce(F.col(c), none) for c in ("_forward", "_reverse")})


def annotate(reads: DataFrame, s: Settings) -> DataFrame:
    """As :func:`strandmill.operators.annotate.annotate`, for fixed anchors and reads of different read_index."""
    matching.compile_anchors(s.anchors)
    if not serves(s.anchors):
        raise ValueError("Seeds serve fixed anchors of ASCII letters only")
    return annotate_hits(with_hits(reads, s.anchors), s)
