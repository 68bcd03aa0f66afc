"""Command line: run, batch and audit-bam."""

from __future__ import annotations

import argparse
import dataclasses
import logging
import sys

from strandmill import settings
from strandmill.sources.fastq import list_fastq


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandmill", description=__doc__)
    top.add_argument("--master", default="local[*]", help="Spark master")
    top.add_argument("--log-file")
    top.add_argument("--log-level", default="INFO")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("run", "batch"):
        p = sub.add_parser(name)
        p.add_argument("--config", required=True)
        p.add_argument("--outdir", required=True)
        p.add_argument("--fastq" if name == "run" else "--input")
        for flag in ("--export-csv", "--output-passed-fastq", "--output-failed-fastq", "--gzip-output", "--parts"):
            p.add_argument(flag, action="store_true")
        if name == "batch":
            p.add_argument("--pattern", default="*.fastq*")
            p.add_argument("--continue-on-error", action="store_true")
    p = sub.add_parser("audit-bam")
    p.add_argument("--input", required=True)
    p.add_argument("--outdir", required=True)
    p.add_argument("--sample-name")
    return top


def set_up_logging(path: str | None, level: str) -> None:
    """To the console at ``level``, and to the file, if any, everything."""
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    handlers[0].setLevel(level)
    if path:
        handlers.append(logging.FileHandler(path))
    logging.basicConfig(level=logging.DEBUG if path else level, handlers=handlers, format="%(asctime)s %(levelname)s %(name)s %(message)s", force=True)
    logging.getLogger("py4j").setLevel(logging.WARNING)


def main(argv: list[str] | None = None) -> int:
    top = parser()
    a = top.parse_args(argv)
    set_up_logging(a.log_file, a.log_level)
    from pyspark.sql import SparkSession

    from strandmill.plans import qc

    spark = SparkSession.getActiveSession() or SparkSession.builder.master(a.master).appName("strandmill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if a.command == "audit-bam":
            qc.audit_file(spark, a.input, a.outdir, a.sample_name)
            return 0
        s = settings.load(a.config)
        options = {"export_csv": a.export_csv, "passed_fastq": a.output_passed_fastq, "failed_fastq": a.output_failed_fastq, "gzip_output": a.gzip_output, "parts": a.parts}
        listed = s.samples or []
        if a.command == "run":
            if len(listed) > 1:
                qc.run_batch(spark, [x.path for x in listed], s, a.outdir, sample_names=[x.sample_name for x in listed], **options)
                return 0
            if listed:
                s = dataclasses.replace(s, sample_name=listed[0].sample_name)
            path = listed[0].path if listed else a.fastq
            if not path:
                top.error("run needs --fastq or a sample in the configuration")
            qc.run_qc(spark, path, s, a.outdir, **options)
            return 0
        if a.input:
            paths, names = list_fastq(a.input, a.pattern), None
        else:
            paths, names = [x.path for x in listed], [x.sample_name for x in listed]
        if not paths:
            top.error("batch needs --input or samples in the configuration")
        qc.run_batch(spark, paths, s, a.outdir, continue_on_error=a.continue_on_error, sample_names=names, **options)
        return 0
    except (ValueError, OSError, qc.BatchError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
