"""Operators over reads: matching, structure, segments, barcodes, metrics."""
