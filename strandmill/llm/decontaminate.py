"""Benchmark decontamination by spaced seeds.

Fixed masks select some of a few consecutive words and ignore the others. The seeds of every position of every
document are joined with those of the benchmark items; around each hit, document and item are laid over each other on
the hit's diagonal, and the overlap is verified word by word, substitutions allowed. Only column functions are used;
documents stay where they are read, and only verified hits are shuffled.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, free_name, table

#: 1: the word counts, 0: it is ignored. Together they miss no window of WINDOW words with NEEDED of them equal.
MASKS = ("11111", "111101", "101111")
WINDOW, NEEDED = 13, 11
#: Of items of fewer words than WINDOW one may differ from SHORT words on, which the masks don't miss either; below, none.
SHORT = 8
#: Items of so few words that no mask fits are looked for by all of their words.
TINY = 4
#: The benchmark's seeds are broadcast in blocks of at most so many bytes of its text, one pass over the documents each. A word
#: has a seed for each mask, rows of some 150 bytes.
BLOCK_BYTES = 1 << 19


def word_hashes(text: Column) -> Column:
    """Hashes of a text's lower-cased words, runs of letters and digits."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(words: Column, at: Column, length: Column, masks: dict[int, str]) -> Column:
    """An array of (mask's number, hash) at a position; null where the mask doesn't fit."""
    out = []
    for k, mask in masks.items():
        picked = [F.get(words, at + i) for i, c in enumerate(mask) if c == "1"]
        out.append(F.when(at + len(mask) <= length, F.struct(F.lit(k).alias("mask"), F.xxhash64(F.lit(k), *picked).alias("seed"))))
    return F.array(*out)


def _seeded(df: DataFrame, keep: list[str], at: str, words: str, masks: dict[int, str]) -> DataFrame:
    positions = df.select(*keep, F.col(words), F.posexplode_outer(words).alias(at, "_w"))
    return positions.select(*keep, words, at, F.explode(_seeds(F.col(words), F.col(at), F.size(words), masks)).alias("_s")).where(
        F.col("_s").isNotNull()
    ).select(*keep, words, at, F.col("_s.mask").alias("_mask"), F.col("_s.seed").alias("_seed"))


def _needed(n: Column, window: int, needed: int) -> Column:
    return F.when(n >= window, F.lit(needed)).when(n >= SHORT, n - 1).otherwise(n)


def find_overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", masks=MASKS, window: int = WINDOW, needed: int = NEEDED, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, best_window, n_matched, n_aligned) of each document that holds a passage of a benchmark item.

    It holds one if, on some alignment, ``needed`` of ``window`` consecutive item words stand at their place in the
    document. best_window: most words matched in such a window; n_matched: most words of the whole item matched on an
    alignment that qualifies; n_aligned: most of its words that lie within the document on one. Words are compared by 64-bit hashes.

    Items of fewer than ``window`` words: all but one from SHORT words on, all of them below, down to items of one word.

    Null or empty texts have no words and match nothing. Repeated rows of one id count as one document (rows with a
    null id too). Very long texts and items are taken whole: an item's words are fetched for verified places only, and
    its seeds may lie in several blocks. Blocks go out by broadcast, each of a bounded size. An empty side gives an empty
    result. Other columns are ignored.
    """
    hashed_items = items.select(F.col(item_id).alias("_item"), word_hashes(F.col(item_text)).alias("_iw"), F.octet_length(F.col(item_text).cast("string")).alias("_bytes")).where(F.size("_iw") > 0).withColumn("_key", F.xxhash64("_iw"))
    hashed_docs = docs.select(F.col(id_col).alias("_doc"), word_hashes(F.col(text_col)).alias("_dw"))
    # equal items are one text; documents are only searched for the sizes of tiny items that there are
    texts = hashed_items.select("_key", "_iw", "_bytes").dropDuplicates(["_key"])
    words, size = texts.agg(F.coalesce(F.sum(F.size("_iw").cast("long")), F.lit(0)), F.coalesce(F.sum(F.col("_bytes").cast("long") + 64), F.lit(0))).first()
    texts = texts.drop("_bytes")
    tiny = [r[0] for r in texts.where(F.size("_iw") <= TINY).select(F.size("_iw")).distinct().collect()]
    numbered = dict(enumerate(masks)) | {len(masks) + n: "1" * n for n in sorted(tiny)}
    blocks = max(1, math.ceil(size / block_bytes))
    seeds = _item_seeds(texts, numbered, len(masks))
    if words * 8 <= BROADCAST_BYTES:
        texts = F.broadcast(texts)
    place = F.pmod(F.xxhash64("_key", "_q"), F.lit(blocks))
    found = [_overlaps(hashed_docs, seeds.where(place == b) if blocks > 1 else seeds, texts, numbered, len(masks), window) for b in range(blocks)]
    best = (
        reduce(DataFrame.unionByName, found).withColumn("_fits", F.col("_best") >= _needed(F.col("_n"), window, needed)).where("_fits")
        .groupBy("_doc", "_key").agg(F.max("_best").alias("_best"), F.max("_all").alias("_all"), F.max("_inside").alias("_inside"))
    )
    return (
        best.join(hashed_items.select("_key", "_item"), "_key").groupBy("_doc", "_item")
        .agg(F.max("_best").alias("best_window"), F.max("_all").alias("n_matched"), F.max("_inside").alias("n_aligned"))
        .select(F.col("_doc").alias(id_col), F.col("_item").alias(item_id), "best_window", "n_matched", "n_aligned")
    )


def _item_seeds(texts: DataFrame, masks: dict[int, str], spaced: int) -> DataFrame:
    """(_key, _n, _q, _seed, _before, _after) of every seed of the items: a row has the words around its place, and not the item's others."""
    i = _seeded(texts, ["_key"], "_q", "_iw", masks).where((F.col("_mask") < spaced) | (F.size("_iw") == F.col("_mask") - spaced))
    return i.select(
        "_key", F.size("_iw").alias("_n"), "_q", "_seed", F.get("_iw", F.col("_q") - 1).alias("_before"), F.slice("_iw", F.col("_q") + 1, F.lit(len(masks[0]))).alias("_after"),
    )


def _overlaps(hashed_docs: DataFrame, seeds: DataFrame, texts: DataFrame, masks: dict[int, str], spaced: int, window: int) -> DataFrame:
    """Laid-over stretches around hits; the first ``spaced`` masks are those for items of any size, one for each tiny size follows."""
    d = _seeded(hashed_docs, ["_doc"], "_p", "_dw", masks)
    # one key of type long (a seed's hash takes in its mask's number), so that the broadcast table is one of longs
    hits = d.join(F.broadcast(seeds), "_seed")
    # a run of equal words hits at each of its positions: go on from the first, and from the first mask
    same = lambda k: F.get("_dw", F.col("_p") + k).eqNullSafe(F.get("_after", F.lit(k)))
    follows = (F.col("_p") > 0) & (F.col("_q") > 0) & F.get("_dw", F.col("_p") - 1).eqNullSafe(F.col("_before"))
    solid = reduce(lambda a, b: a & b, [same(k) for k in range(len(masks[0]))])
    hits = hits.where(~F.when(F.col("_mask") >= spaced, False).when(F.col("_mask") == 0, follows).otherwise(solid))
    # the two stretches that lie over each other: the document's is cut out before the rows leave generated code, so that
    # a long document's words aren't copied for each hit, and the item's fetched
    shift = F.col("_p") - F.col("_q")
    lead = F.greatest(-shift, F.lit(0))
    inside = F.least(F.col("_n"), F.size("_dw") - shift) - lead
    hits = hits.select("_doc", "_key", "_n", lead.alias("_lead"), F.slice("_dw", shift + lead + 1, inside).alias("_d"))
    laid = hits.join(texts, "_key").select("_doc", "_key", "_n", "_d", F.slice("_iw", F.col("_lead") + 1, F.size("_d")).alias("_i"))
    # where the words are equal; a best window starts at one of these places
    equal = F.zip_with("_d", "_i", lambda a, b: a == b)
    places = F.filter(F.transform(equal, lambda e, k: F.when(e, k)), lambda k: k.isNotNull())
    span = F.least(F.col("_n"), F.lit(window))

    def counted(at):
        # a place and those of the next window - 1 that are near enough, read one by one: a slice would copy the array for each
        near = lambda q, k: reduce(lambda a, b: a + b, [F.when(F.get(at, k + j) < q + span, 1).otherwise(0) for j in range(1, window)], F.lit(1))
        return F.struct(F.coalesce(F.array_max(F.transform(at, near)), F.lit(0)).alias("best"), F.size(at).alias("all"))

    # a one-element array is worked out once, where a column's expression might be put in for each of its uses
    laid = laid.select("_doc", "_key", "_n", F.size("_d").alias("_inside"), F.transform(F.array(places), counted)[0].alias("_told"))
    return laid.select("_doc", "_key", "_n", "_inside", F.col("_told.best").alias("_best"), F.col("_told.all").alias("_all"))


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document's overlaps with every benchmark item."""
    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a benchmark passage, unchanged, whatever their other columns are named.

    Rows with a null id are one document here: if one of them holds a passage, all go. See :func:`find_overlaps`.
    """
    name = free_name(docs, "_found")
    found = find_overlaps(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found[name]), "left_anti")


OP9_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM documents),
i AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM benchmark),
dw AS (SELECT doc_id, len(ws) AS len, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
iw AS (SELECT item_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS q FROM i),
laid AS (SELECT doc_id, item_id, n, len, p - q AS shift, list(q) AS qs FROM dw JOIN iw USING (w) GROUP BY ALL HAVING count(*) >= CASE WHEN n >= 13 THEN 11 WHEN n >= 8 THEN n - 1 ELSE n END),
best AS (SELECT doc_id, item_id, n, len(qs) AS n_matched, least(n, len - shift) - greatest(-shift, 0) AS n_aligned,
  list_max(list_transform(range(1, n - least(n, 13) + 2), lambda s: len(list_filter(qs, lambda q: q >= s AND q < s + least(n, 13))))) AS best
  FROM laid)
SELECT doc_id, item_id, max(best)::INTEGER AS best_window, max(n_matched)::INTEGER AS n_matched, max(n_aligned)::INTEGER AS n_aligned
FROM best WHERE best >= CASE WHEN n >= 13 THEN 11 WHEN n >= 8 THEN n - 1 ELSE n END GROUP BY ALL
"""
