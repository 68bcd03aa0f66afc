"""Rows to files: large ones by all executors, as folders of parts or as single files that parts are put together to."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from strandmill.sinks.ordered import write_file

# The columns of the CSV files.
DETAIL_COLUMNS = (
    "Read ID", "Read Length", "Read Qscore", "Structure Label", "QC Bucket", "QC Flags", "Is Reversed", "Order Valid", "5p Offset", "3p Offset",
    "N Fraction", "Invalid Base Fraction", "Anchor Count", "Segment Statuses", "Barcode Status", "Raw Barcode", "Raw UMI",
    "Barcode Nearest Distance", "Barcode Second Distance",
)
HIT_COLUMNS = (
    "Read ID", "Read Length", "Read Qscore", "Structure Label", "QC Bucket", "Is Reversed", "Anchor Name", "Start", "End", "Mismatches",
    "Substitutions", "Insertions", "Deletions", "CIGAR", "Matched Sequence",
)


def write_fastq_table(df: DataFrame, path: str, by: str | None = None, compress: bool = False) -> None:
    """Reads as a folder of FASTQ parts, written by all executors; by: a folder for each of a column's values.

    The parts are ranges of read_index, so one after the other they are in the files' order, as is what is in them.
    """
    order = ["read_index", *(["cycle"] if "cycle" in df.columns else [])]
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*([by] if by else []), *order)
    lines = ranged.select(*([by] if by else []), F.concat(F.lit("@"), "read_id", F.lit("\n"), "sequence", F.lit("\n+\n"), "quality").alias("value"))
    writer = lines.write.mode("overwrite").option("compression", "gzip" if compress else "none")
    (writer.partitionBy(by) if by else writer).text(path)


def _fastq_texts(batch: pa.RecordBatch) -> Iterable[bytes]:
    for name, sequence, quality in zip(*(batch.column(c).to_pylist() for c in ("read_id", "sequence", "quality"))):
        yield f"@{name}\n{sequence}\n+\n{quality}\n".encode()


def write_fastq_file(df: DataFrame, folder: Path, stem: str, compress: bool = False) -> int:
    """Reads in order of read_index as one file of this name, compressed ones in blocks that can be read in ranges; how many."""
    order = ["read_index", *(["cycle"] if "cycle" in df.columns else [])]
    return write_file(df.select(*order, "read_id", "sequence", "quality"), order, folder / f"{stem}.fastq{'.gz' if compress else ''}", _fastq_texts, compress=compress)


def _blank(x) -> object:
    return "" if x is None else x


def detail_row(r: Row) -> list:
    parts = ";".join(f"{g.name}:{g.status}" for g in r.segments)
    offsets = ["" if x is None else f"{x:.4f}" for x in (r.five_prime_offset, r.three_prime_offset)]
    return [
        r.read_id, r.length, f"{r.read_qscore:.2f}", r.label, r.bucket, ";".join(r.flags), r.is_reversed, r.order_valid, *offsets, f"{r.n_fraction:.4f}",
        f"{r.invalid_fraction:.4f}", r.n_hits, parts, r.shown_status, _blank(r.raw_barcode), _blank(r.raw_umi), _blank(r.nearest_distance), _blank(r.second_distance),
    ]


def hit_row(r: Row) -> list:
    h = r.hit
    return [
        r.read_id, r.length, f"{r.read_qscore:.2f}", r.label, r.bucket, r.is_reversed, h.anchor, h.start, h.end, h.distance, h.substitutions, h.insertions,
        h.deletions, h.cigar, h.matched,
    ]


def write_csv(path: Path, header: Iterable[str], rows: Iterable) -> None:
    """A few rows under a header."""
    with path.open("w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(header)
        out.writerows(rows)


def _csv_text(rows: Iterable) -> bytes:
    out = io.StringIO()
    csv.writer(out).writerows(rows)
    return out.getvalue().encode()


def _row(x):
    return Row(**{k: _row(v) for k, v in x.items()}) if isinstance(x, dict) else [_row(v) for v in x] if isinstance(x, list) else x


def _csv_texts(form: Callable):
    """Numbers are formatted in Python, whose rounding is half to even on the binary value."""
    return lambda batch: (_csv_text(form(_row(r)) for r in batch.slice(at, 1024).to_pylist()) for at in range(0, batch.num_rows, 1024))


def write_details(df: DataFrame, path: Path, barcodes: bool) -> None:
    shown = df.withColumn("n_hits", F.size("hits")).withColumn("shown_status", F.col("barcode_status") if barcodes else F.lit(""))
    columns = [
        "read_index", "read_id", "length", "read_qscore", "label", "bucket", "flags", "is_reversed", "order_valid", "five_prime_offset", "three_prime_offset",
        "n_fraction", "invalid_fraction", "n_hits", "segments", "shown_status", "raw_barcode", "raw_umi", "nearest_distance", "second_distance",
    ]
    write_file(shown.select(*columns), ["read_index"], path, _csv_texts(detail_row), _csv_text([DETAIL_COLUMNS]))


def write_hits(df: DataFrame, path: Path) -> None:
    rows = df.select("read_index", "read_id", "length", "read_qscore", "label", "bucket", "is_reversed", F.posexplode("hits").alias("pos", "hit"))
    write_file(rows, ["read_index", "pos"], path, _csv_texts(hit_row), _csv_text([HIT_COLUMNS]))


def write_json(path: Path, what: dict) -> None:
    path.write_text(json.dumps(what, indent=2, ensure_ascii=False), encoding="utf-8")


def summary_rows(s: dict) -> Iterable[list]:
    """The summary as sections of name and value."""
    plain = (
        ("Sample Name", "sample_name", "{}"), ("Total Reads", "total_reads", "{}"), ("Total Bases", "total_bases", "{}"),
        ("Mean Read Length", "mean_read_length", "{:.2f}"), ("Median Read Length", "median_read_length", "{}"), ("N50", "n50", "{}"),
        ("Min Read Length", "min_read_length", "{}"), ("Max Read Length", "max_read_length", "{}"), ("Median Read Qscore", "median_read_qscore", "{:.2f}"),
        ("Long High-Quality Ratio", "long_high_quality_ratio", "{:.4f}"), ("Reversed Read Ratio", "reversed_read_ratio", "{:.4f}"),
        ("Correct Anchor Order Ratio", "correct_anchor_order_ratio", "{:.4f}"), ("5' Truncation Ratio", "five_prime_truncation_ratio", "{:.4f}"),
        ("3' Truncation Ratio", "three_prime_truncation_ratio", "{:.4f}"), ("High-N Read Ratio", "high_n_read_ratio", "{:.4f}"),
    )
    yield from ([title, form.format(s[key])] for title, key, form in plain)
    yield ["Matcher Backend", s["matcher_backend"]["mode"]]
    yield from ([], ["Anchor Detection Ratios"])
    yield from ([a, f"{v:.4f}"] for a, v in s["anchor_detection_ratio"].items())
    yield from ([], ["Anchor Edit Statistics"], ["Anchor", "Mean Edits", "Mean Substitutions", "Mean Insertions", "Mean Deletions"])
    yield from ([a, *(f"{v[f'mean_best_{k}']:.4f}" for k in ("mismatches", "substitutions", "insertions", "deletions"))] for a, v in s["anchor_quality_stats"].items())
    if s["segment_qc"]:
        yield from ([], ["Segment QC"], ["Segment", "Observed Ratio", "Median Length", "Median Qscore", "Mean GC", "Within Bounds"])
        form = (("observed_ratio", ".4f"), ("median_length", ".2f"), ("median_qscore", ".2f"), ("mean_gc_fraction", ".4f"), ("within_length_ratio", ".4f"))
        yield from ([g, *(format(v[k], f) for k, f in form)] for g, v in s["segment_qc"].items())
    if s["barcode_qc"]:
        yield from ([], ["Barcode/UMI Recoverability"])
        keys = ("observed_ratio", "recoverable_ratio", "ambiguous_ratio", "low_quality_ratio", "unique_raw_barcodes", "unique_raw_umis", "umi_singleton_ratio")
        yield from ([k, s["barcode_qc"][k]] for k in keys)
    for title, key in (("QC Bucket Counts", "qc_bucket_counts"), ("Structure Classification Counts", "structure_counts")):
        yield from ([], [title])
        yield from map(list, s[key].items())
    yield from ([], ["Structure Orientation Counts"])
    yield from ([f"{label} ({o})", n] for label, per in s["structure_orientation_counts"].items() for o, n in per.items())


def structure_rows(s: dict) -> Iterable[list]:
    total = s["total_reads"]
    for label, per in s["structure_orientation_counts"].items():
        for o, n in per.items():
            yield [label, o, n, f"{n / total * 100 if total else 0:.2f}%"]


def multiqc(s: dict) -> dict:
    """The run's general statistics as a MultiQC custom section."""
    ratios, b = s["qc_bucket_ratios"], s["barcode_qc"]
    metrics = {
        "total_reads": s["total_reads"], "median_length": s["median_read_length"], "median_qscore": s["median_read_qscore"],
        "full_structure": s["correct_anchor_order_ratio"], "pass_reads": ratios.get("pass", 0.0), "no_anchor": ratios.get("no_anchor", 0.0),
        "concatemer": ratios.get("concatemer_candidate", 0.0),
    }
    if b:
        metrics |= {"barcode_recoverable": b["recoverable_ratio"], "barcode_ambiguous": b["ambiguous_ratio"]}
    forms = {"total_reads": ("", "{:.0f}"), "median_length": (" bp", "{:.0f}"), "median_qscore": ("", "{:.2f}")}
    names = [*metrics, *(n for n in ("barcode_recoverable", "barcode_ambiguous") if n not in metrics)]
    return {
        "id": "strandmill_general_stats", "section_name": "strandmill", "plot_type": "generalstats",
        "description": "Structure quality control of long-read libraries by anchors.", "pconfig": {"id": "strandmill_general_stats", "title": "strandmill"},
        "headers": {n: {"value": None, "suffix": forms.get(n, ("%", ""))[0], "format": forms.get(n, ("", "{:.1%}"))[1]} for n in names},
        "data": {s["sample_name"]: metrics},
    }


def multiqc_tags(s: dict) -> dict:
    rates = {"reads": "total_reads", "corrected_barcode_rate": "corrected_barcode_ratio", "corrected_umi_rate": "corrected_umi_ratio", "ambiguous_barcode_rate": "ambiguous_barcode_ratio", "poly_a_tag_rate": "poly_a_tag_ratio"}
    return {
        "id": "strandmill_tag_audit", "section_name": "strandmill tag audit", "plot_type": "generalstats",
        "description": "Raw and corrected barcode and UMI tags of a BAM.", "pconfig": {"id": "strandmill_tag_audit", "title": "strandmill tag audit"},
        "data": {s["sample_name"]: {name: s[key] for name, key in rates.items()}},
    }
