"""Sharding by sampled splitters: equal bytes per shard, equal texts next to each other.

Every record gets a sort key (digest of its text, then its id). A size-weighted sample of the keys gives quantile
boundaries; records are range-partitioned by them. Ranges that turn out overfull get a sample and boundaries of their
own, and are subdivided; one that lies across the end of a shard is cut by the running size within it. Only ids, sizes
and digests are shuffled, never texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Ranges: one for so many rows, between the two bounds. The upper bound also bounds the splitters (48 bytes each)
#: and the table of range totals, which is what gets broadcast.
ROWS_A_RANGE, LEAST_RANGES, MOST_RANGES = 20_000, 64, 16_384
#: Keys drawn per boundary; a range is overfull from so many times its share on, and is subdivided so often at most.
DRAWS, OVERFULL, ROUNDS = 4, 2, 3


def _sort_key(digest: Column, ident: Column) -> Column:
    """A string that sorts as (digest, id), null ids first."""
    flipped = F.lpad(F.hex(ident.bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.concat(digest, F.coalesce(F.concat(F.lit("1"), flipped), F.lit("0")))


def _range_of(key: Column, splitters: list[str]) -> Column:
    """How many splitters are at or below the key; two levels of comparisons, so about 2 sqrt(n) a row."""
    if not splitters:
        return F.lit(0)
    step = max(1, math.isqrt(len(splitters)))
    fine = F.split(F.lit(",".join(splitters)), ",")
    coarse = F.split(F.lit(",".join(splitters[step - 1 :: step])), ",")
    block = F.size(F.filter(coarse, lambda s: s <= key))
    within = F.size(F.filter(F.slice(fine, block * step + 1, F.lit(step)), lambda s: s <= key))
    return block * step + within


def _in_ranges(keyed: DataFrame, splitters: list[str]) -> tuple[DataFrame, DataFrame]:
    """The records with their ranges, and each range's bytes and rows."""
    ranged = keyed.withColumn("_range", _range_of(F.col("_key"), splitters))
    return ranged, ranged.groupBy("_range").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))


def _subdivisions(ranged: DataFrame, overfull: dict[int, int], share: int, u: Column) -> list[str]:
    """Boundaries within overfull ranges, from a sample of their records in which DRAWS a share are expected."""
    if not overfull:
        return []
    drawn: dict[int, list[str]] = {}
    for r in ranged.where(F.col("_range").isin(list(overfull)) & (u < F.col("size") * F.lit(DRAWS / share))).select("_range", "_key").collect():
        drawn.setdefault(r[0], []).append(r[1])
    out = []
    for k, keys in drawn.items():
        parts = -(-overfull[k] // share)
        keys.sort()
        out += [keys[len(keys) * i // parts] for i in range(1, parts)]
    return sorted(set(out))


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """One row per record: id, size, text_crc32, shard, slot.

    size is the text's UTF-8 bytes plus 1. In the order of (md5 of the text, id) a record goes to the shard in which
    its first byte falls when all bytes are cut in n_shards equal parts, so shards differ by at most one record's
    size, equal texts are neighbours, and a group of copies larger than a shard is cut where the shard ends.
    slot counts from 0 without gaps in each shard. Very long texts count whole.

    Null text: as the empty text (size 1, crc 0). Null id: sorts before all others of its text. Repeated rows: each
    is placed. Empty table: empty result. Other columns of the input are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(
        F.col(id_col).cast("long").alias("_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.md5(F.encode(text, "UTF-8")).alias("_digest"),
    ).withColumn("_key", _sort_key(F.col("_digest"), F.col("_id"))).drop("_digest")
    keyed = stored(keyed, "shard-keys")  # texts are read once; this is some 70 bytes a row

    # the sample: the least of -ln(u)/size over all records is a draw weighted by size, and so are the next least
    rows, total = keyed.select(F.count(F.lit(1)), F.sum("size")).first()
    total = total or 0
    n_ranges = min(MOST_RANGES, max(LEAST_RANGES, math.ceil(rows / ROWS_A_RANGE)))
    u = (F.pmod(F.xxhash64("_key", F.lit(seed)), F.lit(2**52)) + 1) / F.lit(float(2**52 + 1))
    drawn = (
        keyed.select("_key", (-F.log(u) / F.col("size")).alias("_draw")).orderBy("_draw", "_key").limit(n_ranges * DRAWS)
    )
    keys = sorted(r[0] for r in drawn.select("_key").collect())  # at most MOST_RANGES * DRAWS keys
    splitters = sorted({keys[len(keys) * i // n_ranges] for i in range(1, n_ranges)}) if keys else []

    ranged, sums = _in_ranges(keyed, splitters)
    for k in range(ROUNDS):
        overfull = {r[0]: r[1] for r in sums.where((F.col("_bytes") > OVERFULL * total // n_ranges) & (F.col("_rows") > 1)).select("_range", "_bytes").collect()}
        more = _subdivisions(ranged, overfull, max(1, total // n_ranges), u=F.pmod(F.xxhash64("_key", F.lit(seed + 1 + k)), F.lit(2**52)) / F.lit(float(2**52)))
        room = MOST_RANGES * 2 - len(splitters)
        if not set(more) - set(splitters) or room <= 0:
            break
        splitters = sorted({*splitters, *more[:: -(-len(more) // room)]})
        ranged, sums = _in_ranges(keyed, splitters)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over at most MOST_RANGES rows
    bases = sums.select(
        "_range",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes0"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows0"),
    )
    inside = Window.partitionBy("_range").orderBy("_key")
    run = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        ranged.withColumn("_run", F.coalesce(F.sum("size").over(run), F.lit(0)))
        .withColumn("_nth", F.row_number().over(inside) - 1)
        .join(F.broadcast(bases), "_range")
        .select(
            "_id", "size", "text_crc32",
            F.least(F.floor((F.col("_bytes0") + F.col("_run")) * n_shards / F.lit(max(1, total))) if total < 2**50 // n_shards
                    else F.expr(f"(_bytes0 + _run) div {-(-total // n_shards)}"), F.lit(n_shards - 1)).cast("int").alias("shard"),
            (F.col("_rows0") + F.col("_nth")).alias("_row"),
        )
    )
    firsts = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # n_shards rows
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).cast("long").alias("slot")
    )


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law ``bytes``."""
    return shard_by_bytes(table(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


OP5_SQL = """
WITH steps AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n::BIGINT)) AS t
), rows_in AS (
  SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS k FROM documents
), crcs AS (
  SELECT doc_id, k, octet_length(encode(text)) + 1 AS size,
    xor(list_reduce(list_transform(range(octet_length(encode(text))),
        lambda i: ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::BIGINT),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295) AS crc
  FROM rows_in, steps
), ordered AS (
  SELECT doc_id, size, crc, coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    row_number() OVER w AS n, sum(size) OVER () AS total
  FROM crcs WINDOW w AS (ORDER BY k, doc_id NULLS FIRST)
), cut AS (
  SELECT *, least(7, floor(before * 8 / total))::INTEGER AS shard FROM ordered
)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard,
  (n - min(n) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""
