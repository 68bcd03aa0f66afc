"""Reads as they arrive: mergeable counts over a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame

from strandmill.operators import metrics as M
from strandmill.operators.annotate import annotate
from strandmill.operators.summary import cells, state
from strandmill.settings import Settings


def bucket_stream(reads: DataFrame, s: Settings) -> DataFrame:
    """Running counts of buckets, labels and orientations of a streaming table of reads; for output mode complete."""
    return M.counts_by(annotate(reads, s), "bucket", "label", "orientation")


def summary_stream(reads: DataFrame, s: Settings) -> DataFrame:
    """The running state of a summary of a streaming table of reads; for output modes update and complete."""
    return state(cells(annotate(reads, s), s))
