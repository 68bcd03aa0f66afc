"""Matching, structure, segments, barcodes, sources and sinks on small cases with known answers."""

import gzip
import json
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill import settings
from strandmill.functions import columns as C
from strandmill.operators import annotate, barcodes, matching, metrics, structure, tags
from strandmill.plans import qc
from strandmill.sinks import report
from strandmill.sources import fastq, tables

LEFT, RIGHT = "AACCGGTTACGTCAGT", "TGCATGCAAGCTTCGA"
P60 = "GATCCTGAGAGTCCTTGGATAGACCTTAGGCATTCAGGTAGCCTATTGCAGGATCTCCAGG"


def probe(**kw):
    return matching.compile_anchors([settings.Anchor(name="a", type="fixed", **kw)])


def hits(text, **kw):
    return matching.find_hits(text, probe(**kw))


@pytest.mark.parametrize("text,place,distance,kinds,cigar,matched", [
    ("TTACCTAA", (2, 6), 1, (1, 0, 0), "2M1X1M", "ACCT"), ("TTACAGTAA", (2, 7), 1, (0, 1, 0), None, "ACAGT"), ("TTACTAA", (2, 5), 1, (0, 0, 1), None, "ACT"),
])
def test_edit_hits(text, place, distance, kinds, cigar, matched):
    (h,) = hits(text, sequence="ACGT", max_edits=1)
    assert h[:2] == place and h[3] == distance and h[4:7] == kinds and h[8] == matched
    assert cigar is None or h[7] == cigar


def test_exact_hits_overlap_and_edit_hits_do_not():
    assert len(hits("AAAAAA", sequence="AAAA")) == 3
    assert len(hits("AAAAAA", sequence="AAAA", max_edits=0)) == 1


def brute_edit_ends(text, motif, most):
    """The least edits of the motif to stretches that end at each place, one cell after the other."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(motif, 1):
        last, row[0] = row[0], i
        for j, x in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != c))
    return {j: d for j, d in enumerate(row) if j and d <= most}


@pytest.mark.parametrize("kw", [
    {"max_edits": 0}, {"max_edits": 1}, {"max_edits": 3}, {"max_mismatches": 2}, {"max_mismatches": 0}, {"max_edits": 2, "search_region": "5p", "search_window_bp": 25},
    {"max_edits": 1, "search_region": "3p", "search_window_bp": 9}, {"max_mismatches": 1, "search_region": "3p", "search_window_bp": 20},
])
def test_all_at_once_finds_what_one_by_one_does(kw):
    rng = random.Random(40)
    text = lambda n: "".join(rng.choice("ACGTACGTacgtN") for _ in range(n))
    motif = "ACGTTGCA"
    some = ["", "A", "ACGTTGC", motif, motif * 3, "CGTTGCA" + motif[:-1], *(text(rng.randrange(90)) + rng.choice([motif, "ACGTGCA", "ACGTTTGCA", "ACCTTGCA", ""]) + text(rng.randrange(60)) for _ in range(150))]
    probes = probe(sequence=motif, **kw) + matching.compile_anchors([settings.Anchor(name="b", type="fixed", sequence="GGAT", max_edits=1), settings.Anchor(name="c", type="regex", pattern="A{3,}")])
    assert matching.find_hits_in_all(some, probes) == [matching.find_hits(x, probes) for x in some]
    assert matching.find_hits_in_all([], probes) == []


def test_edit_alignments_are_of_the_least_edits():
    rng = random.Random(41)
    for _ in range(200):
        x = "".join(rng.choice("ACG") for _ in range(rng.randrange(30)))
        laid = matching._Laid([x], 4)
        found = matching.edit_batch(laid, matching.codes("ACGGA"), 2)
        assert {end: d for _, d, _, end, _ in found} == brute_edit_ends(x, "ACGGA", 2)
        for _, d, start, end, ops in found:
            assert d == sum(map(ops.count, "XID")) and end - start == len(ops) - ops.count("D") and 5 == len(ops) - ops.count("I")


def test_window_applies_to_the_strand_searched():
    kw = dict(sequence="ACGT", max_edits=0, search_region="5p", search_window_bp=6)
    assert len(hits("ACGTTTACGT", **kw)) == 1
    assert not hits("TTTTTTACGT", **kw)
    assert [h[0] for h in hits("ACGTTTACGT", **(kw | {"search_region": "3p"}))] == [6]


def test_hamming_reports_distance_only_and_needs_an_equal_piece():
    (h,) = hits("TTACCTTT", sequence="ACGT", max_mismatches=1)
    assert h[3] == 1 and h[4:8] == (0, 0, 0, "")
    assert not hits("GGGG", sequence="AAAA", max_mismatches=4)
    assert hits("GGAG", sequence="AAAA", max_mismatches=4)


def test_motif_is_upper_cased_and_pattern_is_not():
    assert hits("acgt", sequence="acgt")
    lower = matching.compile_anchors([settings.Anchor("r", "regex", pattern="acgt")])
    assert not matching.find_hits("acgt", lower)
    upper = matching.compile_anchors([settings.Anchor("r", "regex", pattern="(?P<x>ACG)T")])
    assert matching.find_hits("aacgt", upper)[0][:3] == (1, 5, "r")


def test_edit_matrix_is_the_textbook_recurrence():
    rng = random.Random(5)
    for _ in range(150):
        text, motif = ("".join(rng.choice("ACG") for _ in range(rng.randrange(1, 14))) for _ in range(2))
        d = [[0] * (len(text) + 1)] + [[i] + [0] * len(text) for i in range(1, len(motif) + 1)]
        for i, m in enumerate(motif, 1):
            for j, t in enumerate(text, 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (m != t))
        assert matching.edit_matrix(matching.codes(text), matching.codes(motif)).tolist() == d


def rules(**kw):
    return settings.Structure(expected_order=["left", "right"], **kw)


def hit(name, start, end, distance=0):
    return (start, end, name, distance, 0, 0, 0, "", "")


def told(spark, forward, reverse, r, length):
    """What the column expressions say of one read's hits."""
    df = spark.createDataFrame([(forward, reverse, length)], f"_forward array<{annotate.HIT}>, _reverse array<{annotate.HIT}>, length int")
    return structure.choose_strand(df, r).first()


def test_rules_and_violations(spark):
    r = rules(anchor_rules={"left": settings.Rule(terminal="5p", max_terminal_offset=0.1), "right": settings.Rule(terminal="3p", max_terminal_offset=0.1, min_distance_from_previous=5, max_distance_from_previous=20)})
    assert told(spark, [hit("left", 1, 5), hit("right", 15, 19)], [], r, 20).label == "full_structure"
    v = told(spark, [hit("left", 5, 9), hit("right", 10, 14)], [], r, 20)
    assert v.label == "structure_rule_violation" and {"left:not_5p_terminal", "right:distance_below_min"} <= set(v.violations)


def test_cycles_and_molecules(spark):
    found = [hit("left", 0, 4), hit("right", 10, 14), hit("left", 20, 24), hit("right", 30, 34)]
    v = told(spark, found, [], rules(), 40)
    assert (v.label, v.cycle_count) == ("concatemer_candidate", 2)
    df = spark.createDataFrame([(v._cycles, v.label, "A" * 40, "I" * 40)], "_cycles array<struct<start:int,end:int>>, label string, s string, q string")
    (m,) = df.select(structure.molecules(rules(split_concatemers=True), "s", "q")).first()
    assert [x[:3] for x in m] == [(1, 0, 14), (2, 20, 34)]
    assert len(told(spark, [hit("left", 0, 4), hit("other", 5, 6), hit("right", 10, 14)], [], rules(), 20)._cycles) == 1
    assert not told(spark, [hit("right", 0, 4), hit("left", 5, 9)], [], rules(), 20)._cycles


def test_orientation(spark):
    found = [hit("left", 0, 4), hit("right", 10, 14)]
    assert told(spark, [], found, rules(), 14).label == "full_structure"
    v = told(spark, [], found, rules(expected_orientation="forward"), 14)
    assert v.label == "orientation_unexpected" and not v.order_valid
    assert not told(spark, [], [], rules(), 14).is_reversed


@pytest.mark.parametrize("sequence,first,second,g,want", [
    ("AAAACCGTGGGG", (0, 4), (8, 12), settings.Segment("s", "left", "right", min_length=4, max_length=8), (4, 0.75, "pass")), ("AAAAGGGG", (0, 4), (4, 8), settings.Segment("s", "left", "right"), (0, 0.0, "pass")),
])
def test_segment(spark, sequence, first, second, g, want):
    df = spark.createDataFrame([(sequence, "I" * len(sequence), {"left": hit("left", *first), "right": hit("right", *second)})], f"s string, q string, best map<string,{annotate.HIT}>")
    (o,) = structure.with_segments(df, [g], "s", "q", annotate.part_scores()).first().segments
    assert (o.length, o.gc_fraction, o.status) == want
    assert o.mean_qscore == (0.0 if o.length == 0 else pytest.approx(40))


@pytest.mark.parametrize("raw,message", [
    ({"structure": {"expected_order": ["x"]}}, "Unknown anchor"), ({"thresholds": {"warn_long_high_quality_ratio": 0.5, "fail_long_high_quality_ratio": 0.7}}, "fail threshold"),
    ({"anchors": [{"name": "a", "type": "odd"}]}, "type is 'odd', not one of"), ({"structure": {"concatemer_min_cycles": 1}}, "below 2"),
    ({"anchors": [{"name": "a", "type": "fixed", "sequence": "A", "max_edits": True}]}, "max_edits"), ({"qscore_method": "best"}, "qscore_method"),
])
def test_bad_settings(raw, message):
    with pytest.raises(ValueError, match=message):
        settings.from_dict(raw)


def suite():
    rc = matching.reverse_complement
    c = LEFT + P60 + RIGHT
    S = LEFT[:5] + "A" + LEFT[6:]
    long = P60 + P60[:30]
    # name, sequence, quality character, label, bucket, segment
    return [
        ("exact_forward", c, "I", "full_structure", "pass", "pass"), ("exact_reverse", rc(c), "I", "full_structure", "pass", "pass"),
        ("left_substitution", S + P60 + RIGHT, "I", "full_structure", "pass", "pass"), ("left_insertion", LEFT[:8] + "G" + LEFT[8:] + P60 + RIGHT, "I", "full_structure", "pass", "pass"),
        ("left_deletion", LEFT[:8] + LEFT[9:] + P60 + RIGHT, "I", "full_structure", "pass", "pass"), ("right_substitution", LEFT + P60 + RIGHT[:5] + "A" + RIGHT[6:], "I", "full_structure", "pass", "pass"),
        ("over_edit_limit", "AAGCGGTTACCTCAGT" + P60 + RIGHT, "I", "missing_5p_anchor", "missing_5p", "missing"), ("missing_5p", P60 + RIGHT, "I", "missing_5p_anchor", "missing_5p", "missing"),
        ("missing_3p", LEFT + P60, "I", "missing_3p_anchor", "missing_3p", "missing"), ("no_anchor", P60 + P60[:32], "I", "no_anchor_detected", "no_anchor", "missing"),
        ("order_invalid", RIGHT + P60 + LEFT, "I", "anchor_order_invalid", "order_invalid", "missing"), ("duplicated_5p", LEFT + P60 + LEFT + P60 + RIGHT, "I", "internal_5p_anchor", "internal_adapter", None),
        ("duplicated_3p", LEFT + P60 + RIGHT + P60 + RIGHT, "I", "internal_3p_anchor", "internal_adapter", "pass"), ("two_cycles", c + c, "I", "concatemer_candidate", "concatemer_candidate", None),
        ("three_cycles", c * 3, "I", "concatemer_candidate", "concatemer_candidate", None), ("five_offset", P60[:10] + c, "I", "full_structure", "five_prime_truncated", "pass"),
        ("three_offset", c + P60[:10], "I", "full_structure", "three_prime_truncated", "pass"), ("segment_short", LEFT + P60[:38] + RIGHT, "I", "full_structure", "segment_too_short", "too_short"),
        ("segment_long", LEFT + long + RIGHT, "I", "full_structure", "segment_too_long", "too_long"), ("low_quality", c, "&", "full_structure", "low_read_q", "pass"),
        ("high_n", LEFT + P60[:20] + "N" * 20 + P60[40:] + RIGHT, "I", "full_structure", "high_n", "pass"), ("invalid", LEFT + P60[:20] + "X" + P60[21:] + RIGHT, "I", "full_structure", "invalid_bases", "pass"),
        ("short", LEFT + P60[:20] + RIGHT, "I", "full_structure", "too_short", "too_short"), ("lower", c.lower(), "I", "full_structure", "pass", "pass"), ("empty", "", "I", "no_anchor_detected", "empty_read", "missing"),
    ]


@pytest.fixture(scope="module")
def suite_settings():
    return settings.from_dict({
        "anchors": [{"name": n, "type": "fixed", "sequence": s, "max_edits": 1} for n, s in (("left", LEFT), ("right", RIGHT))],
        "structure": {"expected_order": ["left", "right"], "anchor_rules": {"left": {}, "right": {}}, "split_concatemers": True, "segments": [{"name": "payload", "start_anchor": "left", "end_anchor": "right", "min_length": 40, "max_length": 80}]},
        "thresholds": {"long_read_min_bp": 70, "long_read_min_q": 12, "terminal_anchor_max_offset": 0.05},
    })


def test_structure_suite(spark, suite_settings):
    rows = [(i, name, seq, q * len(seq)) for i, (name, seq, q, *_) in enumerate(suite())]
    df = annotate.annotate(spark.createDataFrame(rows, "read_index long, read_id string, sequence string, quality string"), suite_settings)
    got = {r.read_id: r for r in df.collect()}
    for name, seq, _, label, bucket, segment in suite():
        r = got[name]
        assert (r.label, r.bucket) == (label, bucket), name
        assert segment is None or r.segments[0].status == segment, name
    assert got["exact_reverse"].is_reversed and not got["empty"].is_reversed
    assert got["empty"].flags == ["empty_read", "too_short", "low_read_q", "no_anchor"]
    assert "dense_anchor_hits" in got["three_cycles"].flags
    assert [len(got[n].molecules) for n in ("two_cycles", "three_cycles")] == [2, 3]
    assert got["left_insertion"].best["left"].insertions == 1 and got["left_deletion"].best["left"].deletions == 1


BARCODES = {"exact": "AACCGG", "uniquely_recoverable": "AACCTG", "ambiguous": "AACCGT", "unrecoverable": "GGGGGG"}


def test_barcode_suite(spark):
    s = settings.from_dict({
        "anchors": [{"name": n, "type": "fixed", "sequence": q, "max_edits": 0} for n, q in (("left", LEFT), ("right", RIGHT))], "structure": {"expected_order": ["left", "right"]},
        "barcode": {"enabled": True, "left_anchor": "left", "right_anchor": "right", "barcode_length": 6, "umi_length": 4, "max_edit_distance": 1}, "thresholds": {"long_read_min_bp": 1, "long_read_min_q": 0},
    })
    read = lambda b: LEFT + b + "TGCA" + P60 + RIGHT
    rows = [(k, read(b), "I" * len(read(b))) for k, b in BARCODES.items()]
    rows += [("low_quality", read("AACCGG"), "!" * len(read("AACCGG"))), ("region_incomplete", LEFT + "AACCG" + RIGHT, "I" * 37), ("anchor_missing", LEFT + P60, "I" * 76), ("reverse", matching.reverse_complement(read("AACCGG")), "I" * len(read("AACCGG")))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "read_index long, read_id string, sequence string, quality string")
    listed = spark.createDataFrame([("AACCGG",), ("AACCGA",), ("TTGGCC",)], "barcode string")
    got = {r.read_id: r for r in barcodes.assess(annotate.annotate(df, s), s.barcode, listed).collect()}
    for name, r in got.items():
        assert r.barcode_status == ("exact" if name == "reverse" else name), name
    assert got["exact"].raw_umi == "TGCA" and got["exact"].nearest_distance == 0 and got["exact"].second_distance is None


def test_nearest_is_what_all_pairs_give(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("ACGT") for _ in range(rng.randrange(5, 9)))
    raw, listed = sorted({word() for _ in range(60)}), sorted({word() for _ in range(60)} | {"A"})
    far = lambda a, b: matching.edit_matrix(matching.codes(a), matching.codes(b))  # noqa: E731, F841

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        return row[-1]

    got = barcodes.nearest(spark.createDataFrame([(x,) for x in raw], "raw_barcode string"), spark.createDataFrame([(x,) for x in listed], "barcode string"), 3)
    want = set()
    for a in raw:
        near = sorted((d, b) for b in listed if (d := distance(a, b)) <= 3)
        if near:
            want.add((a, near[0][0], near[0][1], near[1][0] if len(near) > 1 else None))
    assert {tuple(r) for r in got.collect()} == want


def write_fastq(path, reads, opener=open):
    with opener(path, "wt") as f:
        f.writelines(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in reads)


def test_fastq_ranges(spark, tmp_path):
    rng = random.Random(2)
    reads = [(f"r{i} x", (s := "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 60)))), "".join(rng.choice("@+I") for _ in s)) for i in range(300)]
    write_fastq(tmp_path / "a.fastq", reads)
    write_fastq(tmp_path / "b.fastq.gz", reads[:5], gzip.open)
    for size in (1 << 20, 700):
        got = fastq.read_fastq(spark, str(tmp_path / "a.fastq"), str(tmp_path / "b.fastq.gz"), range_bytes=size).orderBy("read_index").collect()
        assert [tuple(r)[1:4] for r in got] == reads + reads[:5]


@pytest.mark.parametrize("text,message", [("r\nA\n+\nI\n", "header"), ("@r\nA\n-\nI\n", "Malformed FASTQ record"), ("@r\nAC\n+\nI\n", "lengths differ"), ("@r\nA\n+\n", "incomplete 4-line record"), ("@r\nA\n+\nI\n\n", "header")])
def test_malformed_fastq(spark, tmp_path, text, message):
    (tmp_path / "x.fastq").write_text(text)
    with pytest.raises(Exception, match=message):
        fastq.read_fastq(spark, str(tmp_path / "x.fastq")).collect()


RECORDS = [{"CR": "ACGT", "CB": "ACGT-1", "UR": "AAAA", "UB": "AAAT", "pt": 35}, {"CR": "ACGA", "CB": "ACGT-1", "UR": "CCCC", "UB": "CCCC", "pt": 25}, {"CR": "TTTT"}]


def test_tag_audit(spark, tmp_path):
    s = tags.audit(tables.tag_records(spark, RECORDS), "x")
    assert s["total_reads"] == 3 and s["corrected_barcode_ratio"] == 2 / 3 and s["median_poly_a_length"] == 25.0
    assert s["barcode_edit_distance_counts"] == {0: 1, 1: 1} == s["umi_edit_distance_counts"]
    (tmp_path / "a.sam").write_text("@HD\tVN:1\n" + "\t".join(["r", "4", "*", "0", "0", "*", "*", "0", "0", "A", "I", "CR:Z:ACGA", "CB:Z:ACGT-1", "UR:Z:AAAA", "UB:Z:AAAT", "pt:i:35", "xx:i:no", "pt:Z"]) + "\n")
    s = qc.audit_file(spark, str(tmp_path / "a.sam"), str(tmp_path / "out"))
    assert s["barcode_edit_distance_counts"] == {1: 1} and s["median_poly_a_length"] == 35.0 and s["sample_name"] == "a"
    assert json.loads((tmp_path / "out/tag_audit_summary.json").read_text())["total_reads"] == 1


def test_bam(spark, tmp_path):
    tail = b"CRZACGA\0CBZACGT-1\0ptC" + bytes([35]) + b"xxBs" + struct.pack("<ihh", 2, 1, -2) + b"XAAx"
    body = struct.pack("<iiBBHHHiiii", -1, -1, 2, 0, 0, 0, 4, 3, -1, -1, 0) + b"r\0" + b"\x12\x40" + b"\xff" * 3 + tail
    raw = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 0) + struct.pack("<i", len(body)) + body
    (tmp_path / "a.bam").write_bytes(gzip.compress(raw[:30]) + gzip.compress(raw[30:]))
    (r,) = tables.read_bam(spark, str(tmp_path / "a.bam")).collect()
    assert r.tags == {"CR": "ACGA", "CB": "ACGT-1", "pt": "35", "xx": "1,-2", "XA": "x"}


def test_lengths_of_the_floating_type_are_cut(spark):
    fields = spark.createDataFrame([(["pt:f:35.7", "xx:f:1.5"],), (["pt:f:35.0"],), (["pt:Z:12.5"],), (["pt:f:-0.5"],), (["pt:f:nan"],), (["pt:i:7"],)], "f array<string>")
    got = fields.select(tags.parse_tags(F.col("f")).alias("tags"))
    assert got.first().tags == {"pt": "35", "xx": "1.5"}
    assert {(r.length, r["count"]) for r in tags.tail_lengths(got).collect()} == {(35, 2), (0, 1), (7, 1)}
    assert tables.bam_tags(b"ptf" + struct.pack("<f", 35.7) + b"xxf" + struct.pack("<f", 1.5)) == {"pt": "35", "xx": "1.5"}


def test_missing_inputs_are_told(spark, tmp_path, capsys):
    from strandmill import cli

    with pytest.raises(ValueError, match="no folder"):
        fastq.list_fastq(tmp_path / "none")
    with pytest.raises(ValueError, match="no FASTQ file"):
        fastq.read_fastq(spark, str(tmp_path / "none.fastq"))
    (tmp_path / "c.json").write_text(json.dumps({"anchors": [{"name": "a", "type": "fixed", "sequence": "ACGT"}]}))
    assert cli.main(["batch", "--config", str(tmp_path / "c.json"), "--input", str(tmp_path / "none"), "--outdir", str(tmp_path / "o")]) == 1
    assert cli.main(["run", "--config", str(tmp_path / "none.json"), "--fastq", "x", "--outdir", str(tmp_path / "o")]) == 1
    assert capsys.readouterr().err.count("error: ") == 2


def test_folders_of_samples():
    assert qc.folders(["a", "a", "b", "a_2", "a"]) == ["a", "a_2", "b", "a_2_2", "a_3"]


def test_end_to_end(spark, tmp_path):
    full = "AAAAACGTGGCCCC"
    write_fastq(tmp_path / "s.fastq", [("full", full, "I" * 14), ("two", full * 2, "I" * 28)])
    (tmp_path / "wl.txt").write_text("#c\nacgt\n\nTTTT\n")
    raw = {
        "anchors": [{"name": "l", "type": "fixed", "sequence": "AAAA", "max_edits": 0}, {"name": "r", "type": "fixed", "sequence": "CCCC", "max_edits": 0}],
        "structure": {"expected_order": ["l", "r"], "split_concatemers": True, "segments": [{"name": "payload", "start_anchor": "l", "end_anchor": "r", "min_length": 6, "max_length": 6}]},
        "barcode": {"enabled": True, "left_anchor": "l", "right_anchor": "r", "barcode_length": 4, "umi_length": 2, "whitelist_path": "wl.txt", "max_edit_distance": 1},
        "thresholds": {"long_read_min_bp": 1}, "export_non_full_structure_fastq": True,
    }
    (tmp_path / "c.json").write_text(json.dumps(raw))
    s = settings.load(tmp_path / "c.json")
    out = qc.run_qc(spark, str(tmp_path / "s.fastq"), s, str(tmp_path / "o"), export_csv=True, passed_fastq=True, failed_fastq=True, gzip_output=True)
    assert out["structure_counts"] == {"full_structure": 1, "concatemer_candidate": 1} and out["split_molecules_exported"] == 2
    assert out["barcode_qc"]["status_counts"] == {"exact": 2} and out["matcher_backend"]["mode"] == "edit"
    assert out["passed_reads_exported"] == 1 == out["failed_reads_exported"] and out["median_read_length"] == 21.0
    o = tmp_path / "o"
    assert gzip.open(o / "split_concatemers.fastq.gz", "rt").read().startswith("@two|cycle=1\n")
    lines = (o / "read_details.csv").read_bytes().split(b"\r\n")
    assert lines[1].startswith(b"full,14,40.00,full_structure,pass,,False,True,0.0000,0.0000") and len(lines) == 4
    assert len((o / "anchor_hits.csv").read_text().splitlines()) == 7
    assert (o / "report.html").read_text().count("<svg") >= 5
    assert {"summary.json", "summary.csv", "structure_classification.csv", "strandmill_mqc.json", "concatemer_candidate.fastq.gz"} <= {p.name for p in o.iterdir()}
    again = qc.run_qc(spark, str(tmp_path / "s.fastq"), s, str(tmp_path / "p"), passed_fastq=True, failed_fastq=True, parts=True)
    assert again["passed_reads_exported"] == 1 == again["failed_reads_exported"]
    text = lambda folder: "".join(x.read_text() for x in sorted((tmp_path / "p" / folder).glob("part-*")))
    assert text("split_concatemers.fastq").startswith(f"@two|cycle=1\n{full}\n+\n") and text("split_concatemers.fastq").count("@two|") == 2
    assert text("passed.fastq") == f"@full\n{full}\n+\n{'I' * 14}\n" and text("by_label.fastq/label=concatemer_candidate").startswith("@two\n")
    (tmp_path / "bad.fastq").write_text("x\n")
    results = qc.run_batch(spark, [tmp_path / "s.fastq", tmp_path / "bad.fastq", tmp_path / "none.fastq"], s, str(tmp_path / "b"), continue_on_error=True)
    assert sorted(r["status"] for r in results) == ["failed", "failed", "success"]
    with pytest.raises(qc.BatchError):
        qc.run_batch(spark, [tmp_path / "s.fastq", tmp_path / "none.fastq"], s, str(tmp_path / "b2"))
    assert json.loads((tmp_path / "b2/batch_summary.json").read_text())["total_count"] == 1


def test_column_functions(spark):
    assert spark.range(1).select(C.levenshtein_within(F.lit("ACGT"), F.lit("TGCA"), 1), C.level(F.lit(0.6), 0.7, 0.5, True), C.conservative_q(F.lit("")), C.mean_q(F.lit("+5"))).first()[:] == (2, "warn", 0.0, 15.0)
    h = spark.createDataFrame([(1, 1), (2, 1), (10, 1), (20, 1)], "length long, count long")
    assert metrics.median_of(h, "length").first()[0] == 6.0 and metrics.lower_median_of(h, "length").first()[0] == 2.0 and metrics.n50_of(h).first()[0] == 20
    assert metrics.n50_of(h.limit(0)).first()[0] == 0


def test_report_parts():
    assert report.rebin({5: 3})[2].index(3) == 12
    assert np.isclose(annotate.quality_score("I" * 5), 40.0) and annotate.quality_score("+5", False) == 15.0


def test_stream(spark, tmp_path):
    from strandmill.streaming import bucket_stream

    rows = [(i, n, s, q * len(s)) for i, (n, s, q, *_) in enumerate(suite()[:4])]
    spark.createDataFrame(rows, "read_index long, read_id string, sequence string, quality string").write.parquet(str(tmp_path / "in"))
    s = settings.from_dict({"anchors": [{"name": "left", "type": "fixed", "sequence": LEFT}]})
    source = spark.readStream.schema("read_index long, read_id string, sequence string, quality string").parquet(str(tmp_path / "in"))
    q = bucket_stream(source, s).writeStream.outputMode("complete").format("memory").queryName("buckets").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("buckets").agg(F.sum("count")).first()[0] == 4


def test_the_last_of_a_tag_counts(spark):
    rng = random.Random(81)
    rows = [(i, [f"{rng.choice('AB')}{rng.choice('CR')}:Z:{rng.randrange(9)}" for _ in range(rng.randrange(7))] + ["xx:i:no"] * (i % 2)) for i in range(80)]
    got = spark.createDataFrame(rows, "i long, f array<string>").select("i", tags.parse_tags(F.col("f")).alias("tags"))
    want = {i: {x[:2]: x[5:] for x in f if x[3] == "Z"} for i, f in rows}
    assert any(len({x[:2] for x in f}) < len(f) for _, f in rows) and {r.i: r.tags for r in got.collect()} == want
    assert spark.createDataFrame([(None,)], "f array<string>").select(tags.parse_tags(F.col("f")).alias("tags")).first().tags is None


def test_tags_are_worked_out_once_a_record(spark):
    fields = spark.createDataFrame([(["CR:Z:ACGT", "CB:Z:ACGA-1", "pt:i:7"],), (["CR:Z:", "CB:Z:A"],)], "f array<string>")
    parsed = fields.select(tags.parse_tags(F.col("f")).alias("tags"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan()
    assert plan(parsed).toJSON().count('expressions.StringSplit"') == 1  # of a field, and not again for each other one
    far, tails = tags.tag_distances(parsed, "CR", "CB", True), tags.tail_lengths(parsed)
    assert [plan(df).toString().count("map_from_entries") for df in (far, tails)] == [1, 1]
    assert [tuple(r) for r in far.collect()] == [(1, 1)] and [tuple(r) for r in tails.collect()] == [(7, 1)]
