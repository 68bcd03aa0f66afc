"""Barcodes and UMIs: where they lie on a read, and how far they are from a whitelist.

The whitelist lookup never compares every barcode with every entry. Raw barcodes are reduced to distinct ones, exact
ones are settled by an equi-join, and the others meet entries on pieces: of an entry cut into r + 1 pieces at least
one occurs unchanged within r places of its own in a barcode that is at most r edits away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.operators.annotate import oriented
from strandmill.settings import Barcode
from strandmill.sinks.ordered import shared_folder

# Statuses of a barcode that was not seen, and of one that can be used.
UNSEEN = ("disabled", "anchor_missing", "region_incomplete")
USABLE = ("exact", "uniquely_recoverable", "extracted")


def extract(annotated: DataFrame, b: Barcode) -> DataFrame:
    """annotated with raw_barcode, raw_umi, min_barcode_q and the status so far (null where a lookup has to tell)."""
    if not b.enabled or not b.left_anchor:
        nothing = {c: F.lit(None).cast(t) for c, t in (("raw_barcode", "string"), ("raw_umi", "string"), ("min_barcode_q", "int"))}
        return annotated.withColumns({"barcode_status": F.lit("disabled"), **nothing})
    left = F.try_element_at("best", F.lit(b.left_anchor))
    right = F.try_element_at("best", F.lit(b.right_anchor)) if b.right_anchor else None
    df = oriented(annotated).withColumn("_at", left["end"] + b.offset_from_left)
    end = F.col("_at") + b.barcode_length + b.umi_length
    absent = left.isNull() | right.isNull() if right is not None else left.isNull()
    outside = (F.col("_at") < 0) | (end > F.length("oriented_sequence")) | (F.length("oriented_quality") < F.col("_at") + b.barcode_length)
    if right is not None:
        outside = outside | (end > right["start"])
    cut = lambda c, at, n: F.substring(F.col(c), F.col("_at") + at + 1, F.lit(n))
    seen = ~absent & ~outside
    quality = cut("oriented_quality", 0, b.barcode_length)
    df = df.withColumn("_seen", seen).withColumn(
        "min_barcode_q", F.when(F.col("_seen"), F.array_min(F.transform(F.filter(F.split(quality, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)))
    )
    low = F.col("min_barcode_q") < b.min_base_quality
    status = F.when(absent, "anchor_missing").when(outside, "region_incomplete").when(low, "low_quality")
    return df.withColumns({
        "raw_barcode": F.when(F.col("_seen"), F.upper(cut("oriented_sequence", 0, b.barcode_length))),
        "raw_umi": F.when(F.col("_seen"), F.upper(cut("oriented_sequence", b.barcode_length, b.umi_length))),
        "barcode_status": status,
    }).drop("_at", "_seen", "oriented_sequence", "oriented_quality")


def nearest(raw: DataFrame, whitelist: DataFrame, radius: int, raw_col: str = "raw_barcode", entry_col: str = "barcode") -> DataFrame:
    """(raw, nearest_distance, nearest_barcode, second_distance) of each distinct raw barcode with an entry within radius.

    Entries are ordered by (distance, entry). Candidates are pairs that share a piece; the distance is then exact.
    """
    entries = whitelist.select(F.col(entry_col).alias("_entry")).distinct()
    pieces = radius + 1
    begin = lambda n, k: F.floor(n * k / pieces).cast("int")
    n = F.length("_entry")
    keyed = entries.select("_entry", F.explode(F.transform(F.sequence(F.lit(0), F.lit(radius)), lambda k: F.struct(
        n.alias("n"), k.alias("k"), F.substring(F.col("_entry"), begin(n, k) + 1, begin(n, k + 1) - begin(n, k)).alias("piece")))).alias("_key"))
    lengths = F.sequence(F.greatest(F.length("_raw") - radius, F.lit(0)), F.length("_raw") + radius)
    shifts = F.sequence(F.lit(-radius), F.lit(radius))
    probes = raw.select(F.col(raw_col).alias("_raw")).where(F.col("_raw").isNotNull()).distinct().select("_raw", F.explode(lengths).alias("_n")).select(
        "_raw", "_n", F.explode(F.sequence(F.lit(0), F.lit(radius))).alias("_k")
    ).select("_raw", "_n", "_k", F.explode(shifts).alias("_d")).where(begin(F.col("_n"), F.col("_k")) + F.col("_d") >= 0)
    probes = probes.select("_raw", F.struct(
        F.col("_n").alias("n"), F.col("_k").alias("k"),
        F.substring(F.col("_raw"), begin(F.col("_n"), F.col("_k")) + F.col("_d") + 1, begin(F.col("_n"), F.col("_k") + 1) - begin(F.col("_n"), F.col("_k"))).alias("piece"),
    ).alias("_key")).distinct()
    near = probes.join(keyed, "_key").select("_raw", "_entry").distinct().withColumn("_far", F.levenshtein("_raw", "_entry", radius)).where("_far >= 0")
    # the two nearest by aggregation: the least, and the least distance of the others
    least = near.groupBy("_raw").agg(F.min(F.struct("_far", "_entry")).alias("_best"))
    second = near.join(least, "_raw").where(F.col("_entry") != F.col("_best._entry")).groupBy("_raw").agg(F.min("_far").alias("_second"))
    return least.join(second, "_raw", "left").select(
        F.col("_raw").alias(raw_col), F.col("_best._far").alias("nearest_distance"), F.col("_best._entry").alias("nearest_barcode"), F.col("_second").alias("second_distance")
    )


#: A table of looked-up barcodes of at most so many bytes is broadcast to the reads; a larger one and they are shuffled.
BROADCAST_BYTES, LOOKED_UP_BYTES = 32 << 20, 128


def assess(annotated: DataFrame, b: Barcode, whitelist: DataFrame | None = None) -> DataFrame:
    """annotated with barcode_status, raw_barcode, raw_umi, min_barcode_q, nearest_distance, second_distance, nearest_barcode.

    Reads with their barcodes, and the distinct barcodes to look up, are written to the shared folder: nothing stays in
    executors' memory, none of it is lost with an executor, and the lookup reads one column of it, the result those it
    asks for. Reads with nothing to look up have keys of their own in the join, so they don't meet under one.
    """
    df = extract(annotated, b)
    unknown = {"nearest_distance": F.lit(None).cast("int"), "second_distance": F.lit(None).cast("int"), "nearest_barcode": F.lit(None).cast("string")}
    if whitelist is None or not b.enabled:
        return df.withColumns({"barcode_status": F.coalesce("barcode_status", F.lit("extracted")), **unknown})
    df = written(df)
    asking = F.col("barcode_status").isNull()
    asked = written(df.where(asking).select("raw_barcode").distinct())
    exact = asked.join(whitelist.select(F.col("barcode").alias("raw_barcode")).distinct(), "raw_barcode").select("raw_barcode", F.lit(True).alias("_exact"))
    rest = asked.join(exact, "raw_barcode", "left_anti")
    found = nearest(rest, whitelist, b.max_edit_distance + b.min_distance_margin)
    looked_up = exact.select(F.col("raw_barcode").alias("_key"), "_exact", F.lit(0).alias("_d1"), F.col("raw_barcode").alias("_near"), F.lit(None).cast("int").alias("_d2")).unionByName(
        found.select(F.col("raw_barcode").alias("_key"), F.lit(False).alias("_exact"), F.col("nearest_distance").alias("_d1"), F.col("nearest_barcode").alias("_near"), F.col("second_distance").alias("_d2"))
    )
    if asked.count() * LOOKED_UP_BYTES <= BROADCAST_BYTES:
        looked_up = F.broadcast(looked_up)
    reach = F.coalesce(F.col("_d1") <= b.max_edit_distance, F.lit(False))
    close = F.coalesce(F.col("_d2") - F.col("_d1") < b.min_distance_margin, F.lit(False))
    told = F.when(F.col("_exact"), "exact").when(~reach, "unrecoverable").when(close, "ambiguous").otherwise("uniquely_recoverable")
    key = F.when(asking, F.col("raw_barcode")).otherwise(F.concat(F.lit("-"), F.col("read_index")))  # no barcode begins like that
    return df.withColumn("_key", key).join(looked_up, "_key", "left").withColumns({
        "nearest_distance": F.col("_d1"), "second_distance": F.when(reach, F.col("_d2")), "nearest_barcode": F.when(reach, F.col("_near")), "barcode_status": F.coalesce("barcode_status", told),
    }).drop("_key", "_exact", "_d1", "_d2", "_near")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, which outlives executors."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
