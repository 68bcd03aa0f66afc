"""Audit of barcode tags: how many records have them, and how far raw and corrected ones are apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.operators.annotate import held
from strandmill.operators.metrics import lower_median_of

# The tags that are counted.
TAGS = ("CR", "CB", "CY", "UR", "UB", "UY", "pt")


def plain_barcode(value: Column) -> Column:
    """Upper case, without a ``-1`` kind of suffix."""
    return F.regexp_replace(F.upper(value), r"-\d+$", "")


def parse_tags(fields: Column) -> Column:
    """A map of ``TAG:TYPE:VALUE`` fields; malformed ones and numbers that are none are left out, the last of a tag counts.

    A length in ``pt`` of the floating type is cut to a whole number, as its type isn't known later.
    """
    parts = F.transform(fields, lambda f: F.split(f, ":", 3))
    whole = lambda p: F.get(p, F.lit(1)).isin("i", "I")
    value = lambda p: F.get(p, F.lit(2))
    fine = F.filter(parts, lambda p: (F.size(p) == 3) & (~whole(p) | F.trim(value(p)).rlike(r"^[+-]?\d+$")) & ((F.get(p, F.lit(1)) != "f") | value(p).try_cast("double").isNotNull()))
    cut = lambda p: F.when((F.get(p, F.lit(0)) == "pt") & (F.get(p, F.lit(1)) == "f"), value(p).try_cast("double").try_cast("bigint").cast("string"))
    plain = lambda p: F.when(whole(p), F.regexp_replace(F.trim(value(p)), r"^\+", "")).otherwise(F.coalesce(cut(p), value(p)))
    entries = F.transform(fine, lambda p: F.struct(F.get(p, F.lit(0)).alias("key"), plain(p).alias("value")))
    # the last of a key is the first from behind; looked for only where a key is there twice
    keys = lambda es: F.transform(es, lambda e: e["key"])
    firsts = lambda es: _with(keys(es), lambda ks: F.filter(es, lambda e, i: F.array_position(ks, e["key"]) == i + 1))
    last = lambda es: F.when(F.size(F.array_distinct(keys(es))) == F.size(es), es).otherwise(_with(F.reverse(es), firsts))
    return F.map_from_entries(_with(entries, last))


def _with(value: Column, made) -> Column:
    """made(value), with the value worked out once: within a lambda it would be so at each place and for each element."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def tag_counts(records: DataFrame) -> DataFrame:
    """One row: records, records with each tag, ambiguous ones."""
    tag = lambda t: F.try_element_at("tags", F.lit(t))
    ambiguous = F.coalesce(tag("XA") == "ambiguous", F.lit(False)) | F.coalesce(tag("barcode_status") == "ambiguous", F.lit(False))
    return records.agg(
        F.count(F.lit(1)).alias("total_reads"), *[F.count_if(F.map_contains_key("tags", t)).alias(t) for t in TAGS], F.count_if(ambiguous).alias("ambiguous")
    )


def tag_distances(records: DataFrame, raw: str, corrected: str, barcode: bool) -> DataFrame:
    """Edit distances between a raw and a corrected tag where both are there and not empty."""
    form = plain_barcode if barcode else F.upper
    # held, so that no filter goes below the step that makes the tags, which then would be made for each use of them
    both = records.select(*(held(F.try_element_at("tags", F.lit(t))).alias(c) for t, c in ((raw, "_a"), (corrected, "_b")))).where((F.length("_a") > 0) & (F.length("_b") > 0))
    return both.groupBy(F.levenshtein(form(F.col("_a")), form(F.col("_b"))).alias("distance")).agg(F.count(F.lit(1)).alias("count"))


def tail_lengths(records: DataFrame) -> DataFrame:
    """The lengths in tag ``pt`` that are whole numbers from 0 on."""
    n = records.select(held(F.try_element_at("tags", F.lit("pt")).try_cast("int")).alias("length"))
    return n.where("length >= 0").groupBy("length").agg(F.count(F.lit(1)).alias("count"))


def audit(records: DataFrame, sample_name: str, input_path: str = "") -> dict:
    """The audit's summary of records with a column ``tags``, a map of strings."""
    row = tag_counts(records).first()
    total = row.total_reads
    share = lambda n: n / total if total else 0.0
    hist = lambda df, key: dict(sorted((r[key], r["count"]) for r in df.collect()))
    lengths = tail_lengths(records)
    return {
        "sample_name": sample_name, "input_path": input_path, "total_reads": total, "tag_counts": {t: row[t] for t in TAGS if row[t]},
        "raw_barcode_ratio": share(row.CR), "corrected_barcode_ratio": share(row.CB), "corrected_umi_ratio": share(row.UB),
        "ambiguous_barcode_ratio": share(row.ambiguous), "poly_a_tag_ratio": share(row.pt),
        "barcode_edit_distance_counts": hist(tag_distances(records, "CR", "CB", True), "distance"),
        "umi_edit_distance_counts": hist(tag_distances(records, "UR", "UB", False), "distance"),
        "median_poly_a_length": lower_median_of(lengths, "length").first()[0], "poly_a_length_counts": hist(lengths, "length"),
    }
