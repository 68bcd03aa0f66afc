"""Sinks: FASTQ and CSV files, JSON, MultiQC sections and HTML reports."""
