"""The engine's operators as queries over the driver's tables.

The tables hold no reads, so reads are derived from ``documents`` by SQL that Spark and DuckDB read alike: bases from
digests of the id, in sixteen layouts (whole, reversed, with one edit, without an anchor, doubled, ...). The
oracles work from those reads, by other means than the operators, and never from the layout's number.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill import settings
from strandmill.functions import columns as C
from strandmill.operators import barcodes, metrics as M, seeds, tags
from strandmill.operators.annotate import annotate, oriented, strand_hits
from strandmill.plans import qc
from strandmill.sinks.files import write_fastq_file
from strandmill.sinks.ordered import make_folder, shared_folder, write_file
from strandmill.sources.fastq import read_fastq, spread
from strandmill.sources.tables import HEADER, read_bam, unmapped_record

FLAGSHIP = "bucket_counts"
LEFT, RIGHT = "AACCGGTTACGTCAGT", "TGCATGCAAGCTTCGA"
WINDOW = 40
_HEX, _BASES = "0123456789abcdef", "ACGTACGTACGTACGT"

READS = f"""
SELECT doc_id AS read_index, concat('r', doc_id) AS read_id, sequence,
  substr(repeat(translate(q, '{_HEX}', CASE WHEN doc_id % 32 = 16 THEN '&&&&&&&&&&&&&&&&' ELSE 'IIIHGFEDCBIIGG55' END), 12), 1, length(sequence)) AS quality
FROM (SELECT doc_id, q, CASE k
    WHEN 0 THEN c WHEN 1 THEN reverse(translate(c, 'ACGTN', 'TGCAN')) WHEN 2 THEN concat(CASE doc_id % 48 WHEN 2 THEN 'AACCGATTACGTCAGT' WHEN 18 THEN 'AACCGGTTGACGTCAGT' ELSE 'AACCGGTACGTCAGT' END, p, '{RIGHT}') WHEN 3 THEN concat(p, '{RIGHT}')
    WHEN 4 THEN concat('{LEFT}', p) WHEN 5 THEN p WHEN 6 THEN concat('{RIGHT}', p, '{LEFT}') WHEN 7 THEN concat('{LEFT}', p, '{LEFT}', p, '{RIGHT}')
    WHEN 8 THEN concat('{LEFT}', p, '{RIGHT}', p, '{RIGHT}') WHEN 9 THEN concat(c, c) WHEN 10 THEN concat(c, c, c) WHEN 11 THEN concat(substr(y, 1, 12), c)
    WHEN 12 THEN lower(c) WHEN 13 THEN concat('{LEFT}', substr(p, 1, 20), '{RIGHT}')
    WHEN 14 THEN concat('{LEFT}', substr(p, 1, 20), 'NNNNNNNNNNNNNNNNNNNN', substr(p, 41, 20), '{RIGHT}') ELSE CASE WHEN doc_id % 32 = 15 THEN '' ELSE concat(c, 'X') END END AS sequence
  FROM (SELECT *, concat('{LEFT}', p, '{RIGHT}') AS c
    FROM (SELECT *, concat(CASE WHEN doc_id % 5 = 0 THEN concat(substr(w, 1, 2), 'A', substr(w, 4, 5)) ELSE substr(w, 1, 8) END, x, substr(y, 1, 20)) AS p
      FROM (SELECT doc_id, doc_id % 16 AS k, md5(concat('q:', doc_id)) AS q,
          translate(md5(concat('a:', doc_id)), '{_HEX}', '{_BASES}') AS x, translate(md5(concat('b:', doc_id)), '{_HEX}', '{_BASES}') AS y,
          translate(md5(concat('w:', doc_id * 7 % 100 + 1)), '{_HEX}', '{_BASES}') AS w
        FROM {{documents}}) layer1) layer2) layer3) layer4
"""
LONG_READS = """
SELECT doc_id AS read_index, translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTCAGTGCATTGACACGTGTCAAC') AS sequence FROM {documents}
"""
#: Motifs that are looked for in long reads with mismatches.
LONG_MOTIFS = {"one": "GACTGTCAGA", "two": "CATTACGTTGCA", "three": "TGCAACGT"}
WHITELIST = f"SELECT DISTINCT substr(translate(md5(concat('w:', s_suppkey)), '{_HEX}', '{_BASES}'), 1, 8) AS barcode FROM {{supplier}} WHERE s_suppkey IS NOT NULL"


def query_settings(edits: bool = False, window: int | None = None) -> settings.Settings:
    """What the queries look for: two anchors with one mismatch (or one edit) each, a segment, and 8 + 4 bp of barcode and UMI.

    window: the left anchor is looked for in so many bases of the 5' end, the right one in as many of the 3' end.
    """
    tolerance = {"max_edits": 1} if edits else {"max_mismatches": 1}
    left, right = ({"search_region": end, "search_window_bp": window} if window else {} for end in ("5p", "3p"))
    return settings.from_dict({
        "anchors": [{"name": "left", "type": "fixed", "sequence": LEFT, **tolerance, **left}, {"name": "right", "type": "fixed", "sequence": RIGHT, **tolerance, **right}],
        "structure": {
            "expected_order": ["left", "right"], "anchor_rules": {"left": {}, "right": {}}, "split_concatemers": True,
            "segments": [{"name": "payload", "start_anchor": "left", "end_anchor": "right", "min_length": 40, "max_length": 80}],
        },
        "barcode": {"enabled": True, "left_anchor": "left", "right_anchor": "right", "barcode_length": 8, "umi_length": 4, "min_base_quality": 15, "max_edit_distance": 1},
        "thresholds": {"long_read_min_bp": 70, "long_read_min_q": 12.0, "terminal_anchor_max_offset": 0.05},
    })


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids, dealt to all cores where the table's scan has fewer partitions, made into reads."""
    return spark.sql(READS, documents=spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")))


def whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier's barcode."""
    return spark.sql(WHITELIST, supplier=spark.read.parquet(f"{sf_dir}/supplier.parquet"))


def annotated(spark, sf_dir, edits: bool = False) -> DataFrame:
    return annotate(reads(spark, sf_dir), query_settings(edits))


def seeded(spark, sf_dir) -> DataFrame:
    """As annotated, with hits by the seed join: no Python worker is needed for hits with mismatches."""
    return seeds.annotate(reads(spark, sf_dir), query_settings())


def long_reads(spark, sf_dir) -> DataFrame:
    """Every document's whole text as a read, its letters as bases."""
    return spark.sql(LONG_READS.replace(", 'g')", ")"), documents=spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


def assessed(spark, sf_dir) -> DataFrame:
    s = query_settings()
    return barcodes.assess(annotated(spark, sf_dir), s.barcode, whitelist(spark, sf_dir))


def _without_first(df: DataFrame) -> DataFrame:
    return df.drop("first")


def read_metrics(spark, sf_dir):
    seq, n = F.col("sequence"), F.length("sequence")
    return reads(spark, sf_dir).select(
        "read_index", n.alias("length"), F.round(C.share(C.n_count(seq), n), 6).alias("n_fraction"), F.round(C.share(C.invalid_count(seq), n), 6).alias("invalid_fraction"),
        F.round(C.mean_q(F.col("quality")), 6).alias("mean_q"), F.round(C.conservative_q(F.col("quality")), 6).alias("conservative_q"),
    )


def strands(spark, sf_dir):
    return reads(spark, sf_dir).select("read_index", C.reverse_complement(F.col("sequence")).alias("reverse_complement"))


def _kernel_hits(df: DataFrame) -> DataFrame:
    h = df.select("read_index", "orientation", F.explode("hits").alias("h"))
    return h.select("read_index", "orientation", F.col("h.anchor").alias("anchor"), F.col("h.start").alias("start"), F.col("h.end").alias("stop"), F.col("h.distance").alias("distance"))


def edit_hits(spark, sf_dir):
    h = annotated(spark, sf_dir, True).select("read_index", "orientation", F.explode("hits").alias("h"))
    return h.select("read_index", "orientation", "h.*").withColumnRenamed("end", "stop")


def window_hits(spark, sf_dir):
    """Hits of anchors that are looked for near the ends only."""
    return _kernel_hits(annotate(reads(spark, sf_dir), query_settings(window=WINDOW)))


def edit_anchor_stats(spark, sf_dir):
    """What the anchors' best hits with edits are like."""
    names = ("mean_best_mismatches", "mean_best_substitutions", "mean_best_insertions", "mean_best_deletions", "multi_hit_ratio", "mean_hits_per_positive_read", "mean_position")
    return M.anchor_stats(annotated(spark, sf_dir, True)).select("anchor", "reads", *[F.round(c, 6).alias(c) for c in names])


def edit_distances(spark, sf_dir):
    """Each anchor's least edits on each strand, where within one; both strands count, also where one has more hits."""
    anchors = settings.from_dict({"anchors": [{"name": n, "type": "fixed", "sequence": m, "max_edits": 1} for n, m in (("left", LEFT), ("right", RIGHT))]})
    h = strand_hits(reads(spark, sf_dir), anchors)
    return h.groupBy("read_index", "is_reversed", F.col("hit.anchor").alias("anchor")).agg(F.min("hit.distance").alias("distance"))


def exact_hits(spark, sf_dir):
    """Overlapping exact occurrences of a short motif on the strand chosen."""
    s = settings.from_dict({"anchors": [{"name": "motif", "type": "fixed", "sequence": "ACA"}], "structure": {"expected_order": []}})
    h = seeds.annotate(reads(spark, sf_dir), s).select("read_index", "orientation", F.explode("hits").alias("h"))
    return h.select("read_index", "orientation", F.col("h.start").alias("start"))


def long_read_hits(spark, sf_dir):
    """All places of both strands of long reads that hold a motif with one mismatch at most."""
    anchors = [settings.Anchor(name=n, type="fixed", sequence=m, max_mismatches=1) for n, m in LONG_MOTIFS.items()]
    h = seeds.strand_hits(long_reads(spark, sf_dir), anchors)
    return h.select("read_index", "turned", F.col("hit.anchor").alias("anchor"), F.col("hit.start").alias("start"), F.col("hit.distance").alias("distance"), F.col("hit.matched").alias("matched"))


def regex_hits(spark, sf_dir):
    s = settings.from_dict({"anchors": [{"name": "homopolymer", "type": "regex", "pattern": "A{3,}|C{3,}|G{3,}|T{3,}"}]})
    a = annotate(reads(spark, sf_dir), s)
    return a.select("read_index", F.size("hits").alias("n_hits"), F.aggregate("hits", F.lit(0), lambda x, h: x + h["end"] - h["start"]).alias("bases"))


def best_hits(spark, sf_dir):
    b = seeded(spark, sf_dir).select("read_index", F.explode("best").alias("anchor", "b"))
    return b.select("read_index", "anchor", F.col("b.start").alias("start"), F.col("b.end").alias("stop"), F.col("b.distance").alias("distance"))


def structures(spark, sf_dir):
    return annotated(spark, sf_dir).select("read_index", "label", "orientation", "order_valid", F.size("hits").alias("n_hits"), F.array_join("detected", ",").alias("detected"))


MIDDLE = "GATTA"


def label_settings(kind: str) -> settings.Settings:
    """Structures for all labels: with rules of place, distance and strand, without an order, and with a third anchor in between."""
    two = [{"name": "left", "type": "fixed", "sequence": LEFT, "max_mismatches": 1}, {"name": "right", "type": "fixed", "sequence": RIGHT, "max_mismatches": 1}]
    if kind == "rules":
        rules = {"left": {"terminal": "5p", "max_terminal_offset": 0.05}, "right": {"min_distance_from_previous": 50, "max_distance_from_previous": 75}}
        return settings.from_dict({"anchors": two, "structure": {"expected_order": ["left", "right"], "anchor_rules": rules, "expected_orientation": "forward"}})
    if kind == "free":
        return settings.from_dict({"anchors": two, "structure": {"expected_order": []}})
    middle = {"name": "mid", "type": "fixed", "sequence": MIDDLE}
    return settings.from_dict({"anchors": [two[0], middle, two[1]], "structure": {"expected_order": ["left", "mid", "right"], "anchor_rules": {"left": {}, "mid": {"max_count": None}, "right": {}}}})


def structure_labels(spark, sf_dir):
    """Label, strand and broken rules of every read under each of the three structures."""
    parts = []
    for kind in ("rules", "free", "middle"):
        a = annotate(reads(spark, sf_dir), label_settings(kind))
        parts.append(a.select(F.lit(kind).alias("structure"), "read_index", "label", "order_valid", "orientation", F.array_join("violations", ",").alias("violations"), "cycle_count"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def read_flags(spark, sf_dir):
    return annotated(spark, sf_dir).select("read_index", F.array_join("flags", ";").alias("flags"), "bucket", F.round("five_prime_offset", 6).alias("offset5"), F.round("three_prime_offset", 6).alias("offset3"))


def segments(spark, sf_dir):
    g = annotated(spark, sf_dir).select("read_index", F.explode("segments").alias("g"))
    return g.select("read_index", F.col("g.status").alias("status"), F.col("g.length").alias("length"), F.round("g.gc_fraction", 6).alias("gc"), F.round("g.mean_qscore", 6).alias("qscore"))


def segment_stats(spark, sf_dir):
    return M.segment_stats(annotated(spark, sf_dir)).select(
        "name", "total_reads", "observed_reads", *[F.round(c, 6).alias(c) for c in ("observed_ratio", "missing_ratio", "within_length_ratio", "mean_length", "median_length", "mean_gc_fraction", "mean_n_fraction")]
    )


def barcode_status(spark, sf_dir):
    return assessed(spark, sf_dir).select("read_index", "barcode_status", "raw_barcode", "raw_umi", "min_barcode_q", "nearest_distance", "second_distance", "nearest_barcode")


def barcode_counts(spark, sf_dir):
    return _without_first(M.counts_by(assessed(spark, sf_dir), "barcode_status"))


def top_barcodes(spark, sf_dir):
    return _without_first(M.top_barcodes(assessed(spark, sf_dir), 50))


def umis(spark, sf_dir):
    return M.umi_stats(assessed(spark, sf_dir)).select("unique_raw_umis", F.round("umi_singleton_ratio", 6).alias("umi_singleton_ratio"))


def run_totals(spark, sf_dir):
    return M.totals(annotated(spark, sf_dir), query_settings())


def anchor_stats(spark, sf_dir):
    return M.anchor_stats(annotated(spark, sf_dir)).select("anchor", "reads", *[F.round(c, 6).alias(c) for c in ("mean_best_mismatches", "multi_hit_ratio", "mean_hits_per_positive_read", "mean_position")])


def length_stats(spark, sf_dir):
    h = M.length_histogram(reads(spark, sf_dir).withColumn("length", F.length("sequence")))
    return M.length_summary(h)


def quality_levels(spark, sf_dir):
    """The run's verdicts as rows, and the worst of those that count; which strand reads are of doesn't, as either will do."""
    s = query_settings()
    t = s.thresholds
    row = M.totals(annotated(spark, sf_dir), s, F.count_if(F.col("bucket") == "no_anchor").alias("no_anchor"))
    n = F.col("total_reads")
    level = lambda part, limit, up: C.level(C.share(F.col(part), n), getattr(t, f"warn_{limit}_ratio"), getattr(t, f"fail_{limit}_ratio"), up)
    counting = [
        ("long_high_quality_ratio", "long_high_quality", level("long_high_quality", "long_high_quality", True)),
        ("correct_anchor_order_ratio", "order_valid", level("order_valid", "correct_anchor_order", True)),
        ("no_anchor_ratio", "no_anchor", level("no_anchor", "no_anchor", False)), ("high_n_read_ratio", "high_n", level("high_n", "high_n", False)),
    ]
    one = lambda name, value, status: F.struct(F.lit(name).alias("metric"), value.alias("value"), status.alias("status"))
    rows = [one(name, F.round(C.share(F.col(part), n), 6), status) for name, part, status in [*counting, ("reversed_read_ratio", "reversed", F.lit("pass"))]]
    found = F.array(*(status for *_, status in counting))
    worst = F.when(F.array_contains(found, "fail"), "fail").when(F.array_contains(found, "warn"), "warn").otherwise("pass")
    return row.select(F.inline(F.array(*rows, one("overall", F.lit(None).cast("double"), worst))))


def split_molecules(spark, sf_dir):
    return qc.split_molecules(annotated(spark, sf_dir)).select("read_id", "sequence", "quality")


def passed_reads(spark, sf_dir):
    return annotated(spark, sf_dir).where("bucket = 'pass'").select("read_id", "sequence", "quality")


def oriented_reads(spark, sf_dir):
    return oriented(annotated(spark, sf_dir)).select("read_index", "oriented_sequence", "oriented_quality")


TAG_LINES = """
SELECT c_custkey AS id, concat_ws('\t', CASE WHEN c_custkey % 7 <> 0 THEN concat('CR:Z:', substr(a, 1, 8)) END,
  CASE WHEN c_custkey % 3 <> 0 THEN concat('CB:Z:', CASE WHEN c_custkey % 5 = 0 THEN concat('T', substr(a, 2, 7)) ELSE substr(a, 1, 8) END, '-1') END,
  concat('UR:Z:', substr(b, 1, 6)), CASE WHEN c_custkey % 2 = 0 THEN concat('UB:Z:', substr(b, 1, 5), 'A') END,
  CASE WHEN c_custkey % 4 = 0 THEN concat('pt:i:', c_custkey % 50 - 5) END, CASE WHEN c_custkey % 11 = 0 THEN 'XA:Z:ambiguous' END) AS line
FROM (SELECT c_custkey, translate(md5(concat('t:', c_custkey)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS a, translate(md5(concat('u:', c_custkey)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS b FROM {customer}) layer1
"""


def _tagged(customers: DataFrame) -> DataFrame:
    lines = customers.sparkSession.sql(TAG_LINES, customer=customers)
    return lines.select("id", tags.parse_tags(F.split("line", "\t")).alias("tags"))


def tag_records(spark, sf_dir) -> DataFrame:
    """All customers' tags. The keys, which are small, are dealt to all cores: a table of few row groups is read by few tasks."""
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    return _tagged(keys.repartition(max(keys.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)))


def tag_counts(spark, sf_dir):
    return tags.tag_counts(tag_records(spark, sf_dir))


def tag_distances(spark, sf_dir):
    r = tag_records(spark, sf_dir)
    return tags.tag_distances(r, "CR", "CB", True).withColumn("pair", F.lit("barcode")).unionByName(tags.tag_distances(r, "UR", "UB", False).withColumn("pair", F.lit("umi")))


def tail_median(spark, sf_dir):
    return M.lower_median_of(tags.tail_lengths(tag_records(spark, sf_dir)), "length")


#: Bytes of a range of the files that queries write and read back, so that there are several.
RANGE_BYTES = 1 << 18


def block_reads(spark, sf_dir):
    """All reads written as one block-compressed FASTQ file by all executors, and read back in ranges of its blocks."""
    folder = shared_folder(spark)
    make_folder(spark, folder)
    write_fastq_file(reads(spark, sf_dir), Path(folder), "reads", compress=True)
    back = read_fastq(spark, f"{folder}/reads.fastq.gz", range_bytes=RANGE_BYTES)
    return back.select("read_id", "sequence", "quality")


def block_tags(spark, sf_dir):
    """How many records have which tags, from a BAM file of all customers' tags that is read in ranges of its blocks."""
    folder = shared_folder(spark)
    make_folder(spark, folder)

    def records(batch):
        # keys and values as two lists: a map's own form in Python takes several times as long
        maps = batch.column("tags")
        ends, names, values = maps.offsets.to_pylist(), maps.keys.to_pylist(), maps.items.to_pylist()
        for k, lo, hi in zip(batch.column("id").to_pylist(), ends, ends[1:]):
            yield unmapped_record(f"c{k}", {t: int(v) if t == "pt" else v for t, v in zip(names[lo:hi], values[lo:hi])})

    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    write_file(keys, ["c_custkey"], f"{folder}/tags.bam", records, HEADER, compress=True, made=_tagged)
    return tags.tag_counts(read_bam(spark, f"{folder}/tags.bam", range_bytes=RANGE_BYTES))


def queries() -> dict:
    a = lambda f: lambda spark, sf_dir: f(annotated(spark, sf_dir))
    plain = lambda f: lambda spark, sf_dir: f(reads(spark, sf_dir).withColumn("length", F.length("sequence")).withColumn("read_qscore", C.conservative_q(F.col("quality"))))
    return {
        "bucket_counts": a(lambda d: _without_first(M.counts_by(d, "bucket"))), "read_metrics": read_metrics, "reverse_complement": strands,
        "length_histogram": plain(M.length_histogram), "qscore_histogram": plain(M.qscore_histogram), "length_q_bins": plain(M.length_q_bins),
        "base_quality_histogram": plain(M.base_quality_histogram), "length_stats": length_stats, "exact_hits": exact_hits, "hamming_hits": lambda spark, sf_dir: _kernel_hits(seeded(spark, sf_dir)), "long_read_hits": long_read_hits,
        "edit_hits": edit_hits, "edit_anchor_stats": edit_anchor_stats, "window_hits": window_hits, "edit_distances": edit_distances, "regex_hits": regex_hits, "best_hits": best_hits, "structures": structures, "structure_labels": structure_labels, "read_flags": read_flags,
        "structure_orientation_counts": a(lambda d: _without_first(M.counts_by(d, "label", "orientation"))), "segments": segments, "segment_stats": segment_stats,
        "barcode_status": barcode_status, "barcode_counts": barcode_counts, "top_barcodes": top_barcodes, "umi_stats": umis, "run_totals": run_totals,
        "anchor_stats": anchor_stats, "heatmap": a(M.heatmap), "quality_levels": quality_levels, "split_molecules": split_molecules, "passed_reads": passed_reads,
        "oriented_reads": oriented_reads, "block_reads": block_reads, "block_tags": block_tags, "tag_counts": tag_counts, "tag_distances": tag_distances, "tail_median": tail_median,
    }


# ---------------------------------------------------------------- oracles

_READS = f"reads AS ({READS.format(documents='documents')})"
_WL = f"wl AS ({WHITELIST.format(supplier='supplier')})"
_Q = """q AS (SELECT read_index, length(sequence) AS n, CASE WHEN length(quality) = 0 THEN 0.0 ELSE
  -10 * log10(list_sum(list_transform(string_split(quality, ''), lambda c: pow(10.0, -(ord(c) - 33) / 10.0))) / length(quality)) END AS qs FROM reads)"""
# hits by trying every place of both strands
_PLACES = f"""strands AS (SELECT read_index, false AS rev, upper(sequence) AS s FROM reads UNION ALL
    SELECT read_index, true, reverse(translate(upper(sequence), 'ACGTN', 'TGCAN')) FROM reads),
  tried AS (SELECT read_index, rev, s, anchor, motif, unnest(range(1, greatest(length(s) - 13, 1))) AS i
    FROM strands, (VALUES ('left', '{LEFT}'), ('right', '{RIGHT}')) m(anchor, motif))"""
_MISMATCHES = """hits AS (SELECT read_index, rev, anchor, (i - 1)::INTEGER AS start, (i + 15)::INTEGER AS stop, hamming(substr(s, i, 16), motif)::INTEGER AS distance
    FROM tried WHERE i <= length(s) - 15 AND hamming(substr(s, i, 16), motif) <= 1)"""


def _equal(length: int, suffix: bool) -> str:
    """How many characters of a stretch of so many that ends at place i + 14 are those of the motif, from one side."""
    n, u = min(length, 16), f"substr(s, i + 15 - {length}, {length})"
    places = f"lambda k: {u}[{length} - k] = motif[16 - k]), false)" if suffix else f"lambda k: {u}[k + 1] = motif[k + 1]), false)"
    return f"coalesce(list_position(list_transform(range({n}), {places} - 1, {n})"


# Alignments with one edit at most to each end: the edit stands as far left as it can, a substitution before an insertion
# before a deletion. Of those of one anchor the best, then the one nearest to the motif's length, then the first is taken,
# and so on among those that don't overlap.
_EDITS = f"""ends AS (SELECT *, i + 14 AS e, CASE WHEN i > 1 THEN hamming(substr(s, i - 1, 16), motif) END AS h16, CASE WHEN i > 1 THEN {_equal(16, False)} END AS p16,
      CASE WHEN i > 2 THEN {_equal(17, False)} END AS p17, CASE WHEN i > 2 THEN {_equal(17, True)} END AS s17, {_equal(15, False)} AS p15, {_equal(15, True)} AS s15 FROM tried),
  placed AS (SELECT *, CASE WHEN h16 = 1 THEN p16 + 1 END AS x, CASE WHEN greatest(1, 16 - s17) <= p17 THEN greatest(1, 16 - s17) END AS n,
      CASE WHEN greatest(1, 16 - s15) <= p15 + 1 THEN greatest(1, 16 - s15) END AS d FROM ends),
  edited AS (SELECT *, CASE WHEN h16 = 0 THEN 'M' WHEN x <= coalesce(n, 99) AND x <= coalesce(d, 99) THEN 'X' WHEN n <= coalesce(d, 99) THEN 'I' ELSE 'D' END AS op
    FROM placed WHERE h16 = 0 OR x IS NOT NULL OR n IS NOT NULL OR d IS NOT NULL),
  sized AS (SELECT read_index, rev, s, anchor, e, op, CASE op WHEN 'I' THEN 17 WHEN 'D' THEN 15 ELSE 16 END AS len,
      CASE op WHEN 'M' THEN '16M' ELSE concat(CASE WHEN b > 0 THEN concat(b, 'M') END, '1', op, CASE WHEN a > 0 THEN concat(a, 'M') END) END AS cigar
    FROM (SELECT *, CASE op WHEN 'X' THEN x - 1 WHEN 'I' THEN n WHEN 'D' THEN d - 1 END AS b, 16 - CASE op WHEN 'X' THEN x WHEN 'I' THEN n WHEN 'D' THEN d END AS a FROM edited) t),
  sorted AS (SELECT read_index, rev, s, anchor, list([{{'d': (op <> 'M')::INTEGER, 'a': e - len, 'e': e, 'op': op, 'cigar': cigar}}] ORDER BY op <> 'M', abs(len - 16), e - len, e) AS c
    FROM sized GROUP BY ALL),
  taken AS (SELECT read_index, rev, s, anchor, unnest(list_reduce(c, lambda t, y: CASE WHEN len(list_filter(t, lambda z: z.a < y[1].e AND y[1].a < z.e)) = 0 THEN list_concat(t, y) ELSE t END)) AS h FROM sorted),
  hits AS (SELECT read_index, rev, anchor, h.a::INTEGER AS start, h.e::INTEGER AS stop, h.d AS distance, (h.op = 'X')::INTEGER AS substitutions, (h.op = 'I')::INTEGER AS insertions,
    (h.op = 'D')::INTEGER AS deletions, h.cigar, substr(s, h.a + 1, h.e - h.a) AS matched FROM taken)"""
_CHOICE = """names AS (SELECT read_index, rev, string_agg(upper(substr(anchor, 1, 1)), '' ORDER BY start, stop, anchor) AS w, count(*) AS k, sum(distance) AS d FROM hits GROUP BY ALL),
  told AS (SELECT s.read_index, s.rev, length(s.s) AS n, coalesce(w, '') AS w, coalesce(k, 0) AS k, coalesce(d, 0) AS d,
      length(coalesce(w, '')) - length(replace(coalesce(w, ''), 'L', '')) AS nl, length(coalesce(w, '')) - length(replace(coalesce(w, ''), 'R', '')) AS nr,
      regexp_replace(regexp_replace(coalesce(w, ''), 'L+', 'L', 'g'), 'R+', 'R', 'g') AS runs,
      (length(coalesce(w, '')) - length(replace(coalesce(w, ''), 'LR', ''))) // 2 AS passes
    FROM strands s LEFT JOIN names x ON s.read_index = x.read_index AND s.rev = x.rev),
  labelled AS (SELECT *, CASE WHEN w = '' THEN 'no_anchor_detected' WHEN passes >= 2 THEN 'concatemer_candidate'
      WHEN nl > 1 OR nr > 1 THEN CASE WHEN contains(runs, 'LRL') THEN 'concatemer_candidate' WHEN nl > 1 THEN 'internal_5p_anchor' ELSE 'internal_3p_anchor' END
      WHEN nl = 0 THEN 'missing_5p_anchor' WHEN nr = 0 THEN 'missing_3p_anchor' WHEN w = 'RL' THEN 'anchor_order_invalid' ELSE 'full_structure' END AS label FROM told),
  ranked AS (SELECT *, CASE label WHEN 'full_structure' THEN 6 WHEN 'anchor_order_invalid' THEN 4 WHEN 'missing_5p_anchor' THEN 2 WHEN 'missing_3p_anchor' THEN 2
      WHEN 'no_anchor_detected' THEN 0 ELSE 1 END AS rank FROM labelled),
  chosen AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY read_index ORDER BY label = 'full_structure' DESC, rank DESC, length(runs) DESC, k DESC, d, rev) = 1),
  own AS (SELECT h.*, c.n FROM hits h JOIN chosen c ON h.read_index = c.read_index AND h.rev = c.rev),
  best AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY read_index, anchor ORDER BY distance, start, stop) = 1),
  pair AS (SELECT c.*, l.start AS l0, l.stop AS l1, r.start AS r0, r.stop AS r1, o.s AS os, CASE WHEN c.rev THEN reverse(e.quality) ELSE e.quality END AS oq, e.sequence, e.quality, e.read_id
    FROM chosen c JOIN reads e ON e.read_index = c.read_index JOIN strands o ON o.read_index = c.read_index AND o.rev = c.rev
    LEFT JOIN best l ON l.read_index = c.read_index AND l.anchor = 'left' LEFT JOIN best r ON r.read_index = c.read_index AND r.anchor = 'right')"""
_HITS = f"{_PLACES}, {_MISMATCHES}, {_CHOICE}"
_SEGMENT = """seg AS (SELECT *, CASE WHEN l1 IS NULL OR r0 IS NULL OR r0 < l1 THEN 'missing' WHEN r0 - l1 < 40 THEN 'too_short' WHEN r0 - l1 > 80 THEN 'too_long' ELSE 'pass' END AS status,
    CASE WHEN r0 >= l1 THEN substr(os, l1 + 1, r0 - l1) END AS part, CASE WHEN r0 >= l1 THEN substr(oq, l1 + 1, r0 - l1) END AS pq FROM pair)"""
_FLAGS = """seen AS (SELECT seg.*, q.qs, l0 / nullif(seg.n, 0) AS o5, (seg.n - r1) / nullif(seg.n, 0) AS o3,
    CASE WHEN seg.n = 0 THEN 0.0 ELSE (length(sequence) - length(translate(sequence, 'Nn', ''))) / seg.n END AS nf,
    CASE WHEN seg.n = 0 THEN 0.0 ELSE length(translate(upper(sequence), 'ACGTN', '')) / seg.n END AS bad FROM seg JOIN q ON q.read_index = seg.read_index),
  flagged AS (SELECT *, list_distinct_keep FROM (SELECT *, list_filter([
      CASE WHEN n = 0 THEN 'empty_read' END, CASE WHEN n < 70 THEN 'too_short' END, CASE WHEN qs < 12 THEN 'low_read_q' END, CASE WHEN nf >= 0.1 THEN 'high_n' END,
      CASE WHEN bad > 0 THEN 'invalid_bases' END,
      CASE label WHEN 'no_anchor_detected' THEN 'no_anchor' WHEN 'missing_5p_anchor' THEN 'missing_5p' WHEN 'missing_3p_anchor' THEN 'missing_3p' WHEN 'anchor_order_invalid' THEN 'order_invalid'
        WHEN 'internal_5p_anchor' THEN 'internal_adapter' WHEN 'internal_3p_anchor' THEN 'internal_adapter' WHEN 'concatemer_candidate' THEN 'concatemer_candidate' END,
      CASE WHEN o5 > 0.05 THEN 'five_prime_truncated' END, CASE WHEN o3 > 0.05 THEN 'three_prime_truncated' END, CASE WHEN k > 4 THEN 'dense_anchor_hits' END,
      CASE WHEN status IN ('too_short', 'too_long') THEN 'segment_' || status END], lambda f: f IS NOT NULL) AS list_distinct_keep FROM seen) t),
  bucketed AS (SELECT * EXCLUDE (list_distinct_keep), list_distinct_keep AS flags, coalesce(list_filter(['empty_read', 'too_short', 'low_read_q', 'invalid_bases', 'high_n', 'no_anchor', 'internal_adapter',
      'concatemer_candidate', 'order_invalid', 'missing_5p', 'missing_3p', 'five_prime_truncated', 'three_prime_truncated', 'segment_too_short', 'segment_too_long', 'dense_anchor_hits'],
      lambda b: list_contains(list_distinct_keep, b))[1], 'pass') AS bucket FROM flagged)"""
_BARCODES = """cut AS (SELECT *, CASE WHEN l1 IS NULL OR r0 IS NULL THEN 'anchor_missing' WHEN l1 + 12 > n OR l1 + 12 > r0 THEN 'region_incomplete' END AS st FROM pair),
  raw AS (SELECT *, CASE WHEN st IS NULL THEN substr(os, l1 + 1, 8) END AS raw_barcode, CASE WHEN st IS NULL THEN substr(os, l1 + 9, 4) END AS raw_umi,
    CASE WHEN st IS NULL THEN list_min(list_transform(string_split(substr(oq, l1 + 1, 8), ''), lambda c: ord(c) - 33)) END AS minq FROM cut),
  dist AS (SELECT u.raw_barcode, barcode, levenshtein(u.raw_barcode, barcode) AS d FROM (SELECT DISTINCT raw_barcode FROM raw WHERE st IS NULL AND minq >= 15) u, wl WHERE levenshtein(u.raw_barcode, barcode) <= 2),
  near AS (SELECT raw_barcode, list(d ORDER BY d, barcode) AS ds, list(barcode ORDER BY d, barcode) AS bs FROM dist GROUP BY 1),
  status AS (SELECT r.*, CASE WHEN st IS NOT NULL THEN st WHEN minq < 15 THEN 'low_quality' WHEN ds[1] = 0 THEN 'exact' WHEN ds IS NULL OR ds[1] > 1 THEN 'unrecoverable'
      WHEN ds[2] - ds[1] < 1 THEN 'ambiguous' ELSE 'uniquely_recoverable' END AS barcode_status, ds, bs FROM raw r LEFT JOIN near ON r.raw_barcode = near.raw_barcode AND minq >= 15)"""
_TAGS = f"""tagged AS (SELECT id, string_split(line, chr(9)) AS f FROM ({TAG_LINES.format(customer='customer')}) t),
  t AS (SELECT {', '.join(f"list_filter(f, lambda x: starts_with(x, '{x}:'))[1][6:] AS {x}" for x in ('CR', 'CB', 'UR', 'UB', 'pt', 'XA'))} FROM tagged)"""


_TAG_COUNTS = f"""WITH {_TAGS} SELECT count(*) AS total_reads, count(CR) AS CR, count(CB) AS CB, 0::BIGINT AS CY, count(UR) AS UR, count(UB) AS UB, 0::BIGINT AS UY, count(pt) AS pt,
  count_if(XA = 'ambiguous')::BIGINT AS ambiguous FROM t"""


def _told(kind: str, hits: str, runs: str, passes: str, label: str, valid: str, more: str = "'' AS broken") -> str:
    """CTEs that give read_index, label, rev, violations and passes of the strand chosen, under names that end in the kind."""
    return f"""names_{kind} AS (SELECT read_index, rev, string_agg(upper(substr(anchor, 1, 1)), '' ORDER BY start, stop, anchor) AS w, count(*) AS k, sum(distance) AS d FROM {hits} GROUP BY ALL),
  best_{kind} AS (SELECT read_index, rev, min(CASE WHEN anchor = 'left' THEN {{'d': distance, 's': start, 'e': stop}} END) AS l, min(CASE WHEN anchor = 'right' THEN {{'d': distance, 's': start, 'e': stop}} END) AS r FROM {hits} GROUP BY ALL),
  told_{kind} AS (SELECT s.read_index, s.rev, length(s.s) AS n, coalesce(w, '') AS w, coalesce(k, 0) AS k, coalesce(d, 0) AS d, l, r, {runs} AS runs, {passes} AS passes,
      length(coalesce(w, '')) - length(replace(coalesce(w, ''), 'L', '')) AS nl, length(coalesce(w, '')) - length(replace(coalesce(w, ''), 'R', '')) AS nr
    FROM strands s LEFT JOIN names_{kind} x ON s.read_index = x.read_index AND s.rev = x.rev LEFT JOIN best_{kind} y ON s.read_index = y.read_index AND s.rev = y.rev),
  labelled_{kind} AS (SELECT *, CASE WHEN w = '' THEN 'no_anchor_detected' {label} END AS label FROM (SELECT *, {more} FROM told_{kind}) t),
  chosen_{kind} AS (SELECT * FROM labelled_{kind} QUALIFY row_number() OVER (PARTITION BY read_index ORDER BY label = '{valid}' DESC, CASE label WHEN 'full_structure' THEN 6 WHEN 'anchors_detected' THEN 5
      WHEN 'anchor_order_invalid' THEN 4 WHEN 'partial_structure' THEN 3 WHEN 'missing_5p_anchor' THEN 2 WHEN 'missing_3p_anchor' THEN 2 WHEN 'no_anchor_detected' THEN 0 ELSE 1 END DESC, length(runs) DESC, k DESC, d, rev) = 1)"""


_RUNS = "regexp_replace(regexp_replace(regexp_replace(coalesce(w, ''), 'L+', 'L', 'g'), 'R+', 'R', 'g'), 'M+', 'M', 'g')"
_REPEATED = "WHEN nl > 1 OR nr > 1 THEN CASE WHEN contains(runs, '{again}') THEN 'concatemer_candidate' WHEN nl > 1 THEN 'internal_5p_anchor' ELSE 'internal_3p_anchor' END WHEN nl = 0 THEN 'missing_5p_anchor' WHEN nr = 0 THEN 'missing_3p_anchor'"
_RULES = f"""WITH {_READS}, {_PLACES}, {_MISMATCHES},
  {_told('rules', 'hits', _RUNS, "(length(coalesce(w, '')) - length(replace(coalesce(w, ''), 'LR', ''))) // 2", f"WHEN passes >= 2 THEN 'concatemer_candidate' {_REPEATED.format(again='LRL')} WHEN w = 'RL' THEN 'anchor_order_invalid' WHEN broken <> '' THEN 'structure_rule_violation' ELSE 'full_structure'", 'full_structure',
    "concat_ws(',', CASE WHEN n > 0 AND l.s / n > 0.05 THEN 'left:not_5p_terminal' END, CASE WHEN r.s - l.e < 50 THEN 'right:distance_below_min' END, CASE WHEN r.s - l.e > 75 THEN 'right:distance_above_max' END) AS broken")},
  {_told('free', 'hits', _RUNS, '0', "WHEN nl > 1 OR nr > 1 THEN 'duplicated_anchor' ELSE 'anchors_detected'", 'anchors_detected')},
  middles AS (SELECT * FROM hits UNION ALL SELECT read_index, rev, 'mid', (i - 1)::INTEGER, (i + 4)::INTEGER, 0 FROM (SELECT read_index, rev, s, unnest(range(1, greatest(length(s) - 3, 1))) AS i FROM strands) t WHERE substr(s, i, 5) = '{MIDDLE}'),
  {_told('middle', 'middles', _RUNS, "(length(coalesce(w, '')) - length(replace(coalesce(w, ''), 'LMR', ''))) // 3", f"WHEN passes >= 2 THEN 'concatemer_candidate' {_REPEATED.format(again='LMRL')} WHEN NOT contains(w, 'M') THEN 'partial_structure' WHEN runs <> 'LMR' THEN 'anchor_order_invalid' ELSE 'full_structure'", 'full_structure')}
  SELECT 'rules' AS structure, read_index, CASE WHEN rev AND label = 'full_structure' THEN 'orientation_unexpected' ELSE label END AS label, label = 'full_structure' AND NOT rev AS order_valid,
    CASE WHEN rev THEN 'reversed' ELSE 'forward' END AS orientation, concat_ws(',', CASE WHEN label = 'structure_rule_violation' THEN broken END, CASE WHEN rev THEN 'orientation_unexpected' END) AS violations,
    CASE WHEN label = 'concatemer_candidate' AND passes >= 2 OR label = 'structure_rule_violation' THEN passes ELSE 0 END::INTEGER AS cycle_count FROM chosen_rules
  UNION ALL SELECT 'free', read_index, label, label = 'anchors_detected', CASE WHEN rev THEN 'reversed' ELSE 'forward' END, '', 0 FROM chosen_free
  UNION ALL SELECT 'middle', read_index, label, label = 'full_structure', CASE WHEN rev THEN 'reversed' ELSE 'forward' END, '', CASE WHEN label = 'concatemer_candidate' AND passes >= 2 THEN passes ELSE 0 END::INTEGER FROM chosen_middle"""


def oracle_sql() -> dict:
    whole = f"WITH {_READS}, {_Q}, {_HITS}, {_SEGMENT}, {_FLAGS}"
    hits = f"WITH {_READS}, {_HITS}"
    codes = f"WITH {_READS}, {_WL}, {_HITS}, {_BARCODES}"
    measured = "round(CASE WHEN length(pq) = 0 THEN 0.0 ELSE -10 * log10(list_sum(list_transform(string_split(pq, ''), lambda c: pow(10.0, -(ord(c) - 33) / 10.0))) / length(pq)) END, 6)"
    gc = "CASE WHEN length(part) = 0 THEN 0.0 ELSE length(translate(part, 'ATNX', '')) / length(part) END"
    return {
        "bucket_counts": f"{whole} SELECT bucket, count(*) AS count FROM bucketed GROUP BY 1",
        "read_metrics": f"""WITH {_READS}, {_Q} SELECT r.read_index, n::INTEGER AS length,
          round(CASE WHEN n = 0 THEN 0.0 ELSE (n - length(translate(sequence, 'Nn', ''))) / n END, 6) AS n_fraction,
          round(CASE WHEN n = 0 THEN 0.0 ELSE length(translate(upper(sequence), 'ACGTN', '')) / n END, 6) AS invalid_fraction,
          round(CASE WHEN n = 0 THEN 0.0 ELSE list_sum(list_transform(string_split(quality, ''), lambda c: ord(c) - 33)) / n END, 6) AS mean_q, round(qs, 6) AS conservative_q
          FROM reads r JOIN q ON r.read_index = q.read_index""",
        "reverse_complement": f"WITH {_READS} SELECT read_index, reverse(translate(sequence, 'ACGTNacgtn', 'TGCANtgcan')) AS reverse_complement FROM reads",
        "length_histogram": f"WITH {_READS} SELECT length(sequence)::INTEGER AS length, count(*) AS count FROM reads GROUP BY 1",
        "qscore_histogram": f"WITH {_READS}, {_Q} SELECT round_even(qs * 100, 0)::BIGINT AS qscore, count(*) AS count FROM q GROUP BY 1",
        "length_q_bins": f"WITH {_READS}, {_Q} SELECT (round_even(n / 50, 0) * 50)::BIGINT AS length_bin, round_even(qs / 0.5, 0) * 0.5 AS qscore_bin, count(*) AS count FROM q GROUP BY 1, 2",
        "base_quality_histogram": f"WITH {_READS}, b AS (SELECT unnest(string_split(quality, '')) AS c FROM reads WHERE quality <> '') SELECT (ord(c) - 33)::INTEGER AS phred, count(*) AS count FROM b GROUP BY 1",
        "length_stats": f"""WITH {_READS}, l AS (SELECT length(sequence) AS n FROM reads), c AS (SELECT n, sum(n) OVER (ORDER BY n DESC RANGE UNBOUNDED PRECEDING) AS upto, sum(n) OVER () AS total FROM l)
          SELECT (SELECT max(n)::INTEGER FROM c WHERE upto * 2 >= total) AS n50, median(n) AS median, quantile_disc(n, 0.5)::DOUBLE AS lower_median FROM l""",
        "exact_hits": f"""WITH {_READS}, s AS (SELECT read_index, upper(sequence) AS s, reverse(translate(upper(sequence), 'ACGTN', 'TGCAN')) AS r FROM reads),
          f AS (SELECT read_index, list_filter(range(0, greatest(length(s) - 2, 0)), lambda i: substr(s, i + 1, 3) = 'ACA') AS f, list_filter(range(0, greatest(length(r) - 2, 0)), lambda i: substr(r, i + 1, 3) = 'ACA') AS g FROM s),
          k AS (SELECT *, CASE WHEN len(f) = 0 THEN 0 WHEN len(f) > 1 THEN 1 ELSE 2 END AS fk, CASE WHEN len(g) = 0 THEN 0 WHEN len(g) > 1 THEN 1 ELSE 2 END AS gk FROM f)
          SELECT read_index, CASE WHEN t THEN 'reversed' ELSE 'forward' END AS orientation, unnest(CASE WHEN t THEN g ELSE f END)::INTEGER AS start
          FROM (SELECT *, (gk = 2, gk > 0, len(g)) > (fk = 2, fk > 0, len(f)) AS t FROM k) c""",
        "hamming_hits": f"{hits} SELECT read_index, CASE WHEN rev THEN 'reversed' ELSE 'forward' END AS orientation, anchor, start, stop, distance FROM own",
        "edit_hits": f"""WITH {_READS}, {_PLACES}, {_EDITS}, {_CHOICE} SELECT read_index, CASE WHEN rev THEN 'reversed' ELSE 'forward' END AS orientation, anchor, start, stop, distance,
          substitutions, insertions, deletions, cigar, matched FROM own""",
        "edit_anchor_stats": f"""WITH {_READS}, {_PLACES}, {_EDITS}, {_CHOICE}, c AS (SELECT read_index, anchor, count(*) AS h FROM own GROUP BY ALL)
          SELECT b.anchor, count(*) AS reads, round(avg(distance), 6) AS mean_best_mismatches, round(avg(substitutions), 6) AS mean_best_substitutions, round(avg(insertions), 6) AS mean_best_insertions,
          round(avg(deletions), 6) AS mean_best_deletions, round(avg((h > 1)::INTEGER), 6) AS multi_hit_ratio, round(avg(h), 6) AS mean_hits_per_positive_read, round(avg(start / n), 6) AS mean_position
          FROM best b JOIN c ON c.read_index = b.read_index AND c.anchor = b.anchor GROUP BY 1""",
        "window_hits": f"""WITH {_READS}, {_PLACES}, {_MISMATCHES.replace("WHERE", f"WHERE CASE anchor WHEN 'left' THEN i + 15 <= {WINDOW} ELSE i > length(s) - {WINDOW} END AND")}, {_CHOICE}
          SELECT read_index, CASE WHEN rev THEN 'reversed' ELSE 'forward' END AS orientation, anchor, start, stop, distance FROM own""",
        "edit_distances": f"""WITH {_READS}, a AS (SELECT read_index, false AS rev, upper(sequence) AS s FROM reads UNION ALL SELECT read_index, true, reverse(translate(upper(sequence), 'ACGTN', 'TGCAN')) FROM reads),
          p AS (SELECT read_index, rev, s, anchor, motif, unnest(range(1, length(s) + 1)) AS i FROM a, (VALUES ('left', '{LEFT}'), ('right', '{RIGHT}')) m(anchor, motif))
          SELECT read_index, rev AS is_reversed, anchor, min(least(levenshtein(substr(s, i, 15), motif), levenshtein(substr(s, i, 16), motif), levenshtein(substr(s, i, 17), motif)))::INTEGER AS distance
          FROM p GROUP BY ALL HAVING min(least(levenshtein(substr(s, i, 15), motif), levenshtein(substr(s, i, 16), motif), levenshtein(substr(s, i, 17), motif))) <= 1""",
        "regex_hits": f"""WITH {_READS}, m AS (SELECT read_index, regexp_extract_all(upper(sequence), 'A{{3,}}|C{{3,}}|G{{3,}}|T{{3,}}') AS f FROM reads)
          SELECT read_index, len(f)::INTEGER AS n_hits, coalesce(list_sum(list_transform(f, lambda x: length(x))), 0)::INTEGER AS bases FROM m""",
        "long_read_hits": f"""WITH reads AS ({LONG_READS.format(documents='documents')}), strands AS (SELECT read_index, false AS turned, sequence AS s FROM reads
            UNION ALL SELECT read_index, true, reverse(translate(sequence, 'ACGT', 'TGCA')) FROM reads),
          tried AS (SELECT read_index, turned, s, unnest(range(1, length(s) + 1)) AS i FROM strands),
          laid AS (SELECT read_index, turned, anchor, motif, i, substr(s, i, length(motif)) AS matched
            FROM tried, (VALUES {', '.join(f"('{n}', '{m}')" for n, m in LONG_MOTIFS.items())}) m(anchor, motif) WHERE i + length(motif) - 1 <= length(s)),
          told AS (SELECT *, CASE WHEN length(matched) = length(motif) THEN hamming(matched, motif) ELSE 99 END AS distance FROM laid)
          SELECT read_index, turned, anchor, (i - 1)::INTEGER AS start, distance::INTEGER AS distance, matched FROM told WHERE distance <= 1""",
        "best_hits": f"{hits} SELECT read_index, anchor, start, stop, distance FROM best",
        "structures": f"{hits} SELECT read_index, label, CASE WHEN rev THEN 'reversed' ELSE 'forward' END AS orientation, label = 'full_structure' AS order_valid, k::INTEGER AS n_hits, array_to_string(list_transform(list_filter(string_split(runs, ''), lambda c: c <> ''), lambda c: CASE c WHEN 'L' THEN 'left' ELSE 'right' END), ',') AS detected FROM chosen",
        "structure_labels": _RULES,
        "read_flags": f"{whole} SELECT read_index, array_to_string(flags, ';') AS flags, bucket, round(o5, 6) AS offset5, round(o3, 6) AS offset3 FROM bucketed",
        "structure_orientation_counts": f"{hits} SELECT label, CASE WHEN rev THEN 'reversed' ELSE 'forward' END AS orientation, count(*) AS count FROM chosen GROUP BY 1, 2",
        "segments": f"{hits}, {_SEGMENT} SELECT read_index, status, length(part)::INTEGER AS length, round({gc}, 6) AS gc, {measured} AS qscore FROM seg",
        "segment_stats": f"""{hits}, {_SEGMENT} SELECT 'payload' AS name, count(*) AS total_reads, count(part) AS observed_reads, round(count(part) / count(*), 6) AS observed_ratio,
          round(count_if(status = 'missing') / count(*), 6) AS missing_ratio, round(count_if(status = 'pass') / count(part), 6) AS within_length_ratio, round(avg(length(part)), 6) AS mean_length,
          round(median(length(part)), 6) AS median_length, round(avg({gc}), 6) AS mean_gc_fraction,
          round(avg(CASE WHEN length(part) = 0 THEN 0.0 ELSE (length(part) - length(replace(part, 'N', ''))) / length(part) END), 6) AS mean_n_fraction FROM seg""",
        "barcode_status": f"""{codes} SELECT read_index, barcode_status, raw_barcode, raw_umi, minq::INTEGER AS min_barcode_q, ds[1]::INTEGER AS nearest_distance,
          CASE WHEN barcode_status IN ('ambiguous', 'uniquely_recoverable') THEN ds[2] END::INTEGER AS second_distance,
          CASE WHEN barcode_status IN ('exact', 'ambiguous', 'uniquely_recoverable') THEN bs[1] END AS nearest_barcode FROM status""",
        "barcode_counts": f"{codes} SELECT barcode_status, count(*) AS count FROM status GROUP BY 1",
        "top_barcodes": f"{codes} SELECT raw_barcode, count(*) AS count FROM raw WHERE raw_barcode <> '' GROUP BY 1 ORDER BY 2 DESC, min(read_index) LIMIT 50",
        "umi_stats": f"{codes}, u AS (SELECT raw_umi, count(*) AS n FROM raw WHERE raw_umi <> '' GROUP BY 1) SELECT count(*) AS unique_raw_umis, round(avg((n = 1)::INTEGER), 6) AS umi_singleton_ratio FROM u",
        "run_totals": f"""{whole} SELECT count(*) AS total_reads, sum(n)::BIGINT AS total_bases, min(n)::INTEGER AS min_read_length, max(n)::INTEGER AS max_read_length, count_if(label = 'full_structure')::BIGINT AS order_valid,
          count_if(rev)::BIGINT AS reversed, count_if(n >= 70 AND qs >= 12)::BIGINT AS long_high_quality, count_if(o5 > 0.05)::BIGINT AS five_prime_truncated, count_if(o3 > 0.05)::BIGINT AS three_prime_truncated,
          count_if(nf >= 0.1)::BIGINT AS high_n, count_if(bad > 0)::BIGINT AS invalid_bases, count_if(label = 'concatemer_candidate' AND passes > 0)::BIGINT AS concatemer_parents,
          sum(CASE WHEN label = 'concatemer_candidate' THEN passes ELSE 0 END)::BIGINT AS molecules FROM bucketed""",
        "anchor_stats": f"""{hits}, c AS (SELECT read_index, anchor, count(*) AS h FROM own GROUP BY ALL) SELECT b.anchor, count(*) AS reads, round(avg(distance), 6) AS mean_best_mismatches,
          round(avg((h > 1)::INTEGER), 6) AS multi_hit_ratio, round(avg(h), 6) AS mean_hits_per_positive_read, round(avg(start / n), 6) AS mean_position
          FROM best b JOIN c ON c.read_index = b.read_index AND c.anchor = b.anchor GROUP BY 1""",
        "heatmap": f"""{whole}, cover AS (SELECT DISTINCT o.read_index, unnest(range(least(99, floor(start / o.n * 100)::INTEGER), least(100, greatest(least(99, floor(start / o.n * 100)::INTEGER) + 1, floor(stop / o.n * 100)::INTEGER)))) AS bin FROM own o)
          SELECT bucket, label, bin::INTEGER AS bin, count(*) AS reads FROM cover JOIN bucketed USING (read_index) GROUP BY ALL""",
        "quality_levels": f"""{whole}, r AS (SELECT count(*) AS t, count_if(n >= 70 AND qs >= 12) AS a, count_if(label = 'full_structure') AS b, count_if(bucket = 'no_anchor') AS c, count_if(nf >= 0.1) AS d, count_if(rev) AS e FROM bucketed),
          v AS (SELECT 'long_high_quality_ratio' AS metric, round(a / t, 6) AS value, CASE WHEN a / t < 0.5 THEN 'fail' WHEN a / t < 0.7 THEN 'warn' ELSE 'pass' END AS status FROM r UNION ALL
          SELECT 'correct_anchor_order_ratio', round(b / t, 6), CASE WHEN b / t < 0.5 THEN 'fail' WHEN b / t < 0.7 THEN 'warn' ELSE 'pass' END FROM r UNION ALL
          SELECT 'no_anchor_ratio', round(c / t, 6), CASE WHEN c / t > 0.35 THEN 'fail' WHEN c / t > 0.2 THEN 'warn' ELSE 'pass' END FROM r UNION ALL
          SELECT 'high_n_read_ratio', round(d / t, 6), CASE WHEN d / t > 0.2 THEN 'fail' WHEN d / t > 0.1 THEN 'warn' ELSE 'pass' END FROM r)
          SELECT * FROM v UNION ALL SELECT 'reversed_read_ratio', round(e / t, 6), 'pass' FROM r UNION ALL SELECT 'overall', NULL, min(status) FROM v WHERE status <> 'pass' OR (SELECT bool_and(status = 'pass') FROM v)""",
        "split_molecules": f"""{hits}, o AS (SELECT own.*, lead(anchor) OVER w AS after, lead(stop) OVER w AS until FROM own WINDOW w AS (PARTITION BY own.read_index ORDER BY start, stop, anchor)),
          m AS (SELECT read_index, start, until, row_number() OVER (PARTITION BY read_index ORDER BY start) AS cycle FROM o WHERE anchor = 'left' AND after = 'right')
          SELECT concat(read_id, '|cycle=', cycle) AS read_id, substr(CASE WHEN rev THEN reverse(translate(sequence, 'ACGTNacgtn', 'TGCANtgcan')) ELSE sequence END, start + 1, until - start) AS sequence, substr(oq, start + 1, until - start) AS quality
          FROM m JOIN pair USING (read_index) WHERE label = 'concatemer_candidate'""",
        "passed_reads": f"{whole} SELECT read_id, sequence, quality FROM bucketed WHERE bucket = 'pass'",
        "oriented_reads": f"{hits} SELECT read_index, CASE WHEN rev THEN reverse(translate(sequence, 'ACGTNacgtn', 'TGCANtgcan')) ELSE sequence END AS oriented_sequence, oq AS oriented_quality FROM pair",
        "block_reads": f"WITH {_READS} SELECT read_id, sequence, quality FROM reads",
        "block_tags": _TAG_COUNTS,
        "tag_counts": _TAG_COUNTS,
        "tag_distances": f"""WITH {_TAGS} SELECT levenshtein(CR, regexp_replace(CB, '-[0-9]+$', ''))::INTEGER AS distance, count(*) AS count, 'barcode' AS pair FROM t WHERE CR <> '' AND CB <> '' GROUP BY 1
          UNION ALL SELECT levenshtein(UR, UB)::INTEGER, count(*), 'umi' FROM t WHERE UR <> '' AND UB <> '' GROUP BY 1""",
        "tail_median": f"WITH {_TAGS} SELECT quantile_disc(pt::INTEGER, 0.5)::DOUBLE AS median FROM t WHERE pt::INTEGER >= 0",
    }
