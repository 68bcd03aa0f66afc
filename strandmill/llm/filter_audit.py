"""Filter interaction audit: what each filter removes, at every place of every order in which five filters can run.

Every document's flags meet all 120 orders, which are broadcast, and each of the five steps of an order; the first step
that fails is where the document goes. Counts are conditional sums by part, order and step, combined in the task before
they are exchanged, so that what is exchanged depends on the numbers of parts and tasks and not on the documents.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

FILTERS = "ABCDE"
#: Fewest words, least percentage of distinct words, most percentage of capitals, characters that a text may not hold.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 200, 50, 2, r"[#$%&*|]"
#: A text of more than one in so many rows is looked up in a broadcast table, which has at most so many rows.
HOT_ONE_IN = 4096
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> Column:
    """Bits 0 to 3: whether a text (no null) fails A, B, C, D."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    # the words are needed twice: a one-element array is worked out once
    counted = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))[0]
    a_and_b = F.transform(
        F.array(counted),
        lambda c: F.when(c["n"] < LEAST_WORDS, 1).otherwise(0) + F.when(F.lit(100).cast("long") * c["d"] < F.lit(LEAST_DISTINCT).cast("long") * c["n"], 2).otherwise(0),
    )[0]
    return a_and_b + F.when(F.lit(100).cast("long") * capitals > F.lit(MOST_CAPITALS).cast("long") * F.length(text), 4).otherwise(0) + F.when(text.rlike(MARKS), 8).otherwise(0)


def document_flags(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, failures, good, toxic) of every row: a bit for each filter that it fails, and what its label says.

    E fails where the same text has a smaller id anywhere in the table; rows of the smallest id, repeated ones too, and
    rows without an id don't fail it. Texts are compared by their SHA-256.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    flags = docs.select(
        F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("_digest"), text_failures(text).alias("_mask"),
    )
    said = labels.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    ).where("_id IS NOT NULL AND (good OR toxic)")
    # texts with several ids; those of very many rows stand in a table of a bounded size, so that no key is hot in the other
    copies = flags.groupBy("_digest").agg(F.min("_id").alias("_least"), F.max("_id").alias("_most"), F.count(F.lit(1)).alias("_rows")).where("_least < _most")
    bound = F.lit(docs.count() / HOT_ONE_IN)
    hot = copies.where(F.col("_rows") > bound).select(F.col("_digest"), F.col("_least").alias("_hot"))
    rest = copies.where(F.col("_rows") <= bound).select("_digest", "_least")
    # rows whose text is hot need nothing from the other table, and are spread by their ids there
    placed = flags.join(F.broadcast(hot), "_digest", "left").withColumn("_digest", F.when(F.col("_hot").isNull(), F.col("_digest")).otherwise(F.encode(F.concat(F.lit("-"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), "UTF-8")))
    found = placed.join(rest, "_digest", "left").withColumn("_late", F.coalesce(F.col("_id") > F.coalesce("_hot", "_least"), F.lit(False)))
    return found.join(said, "_id", "left").select(
        "part", (F.col("_mask") + F.when(F.col("_late"), 16).otherwise(0)).alias("failures"),
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )


def all_orders(spark: SparkSession) -> DataFrame:
    """(filter_order, bits): the 120 orders, with the bit of each step's filter."""
    rows = [("".join(p), [1 << FILTERS.index(f) for f in p]) for p in itertools.permutations(FILTERS)]
    return spark.createDataFrame(rows, "filter_order string, bits array<int>")


def audit(flags: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from the flags of documents.

    One row for each part that there is, order and step, zeros included; an empty table gives none.
    """
    bits, failures = F.col("bits"), F.col("failures")
    fails = lambda k: failures.bitwiseAND(F.get(bits, F.lit(k))) > 0
    first = F.lit(len(FILTERS) + 1)
    for k in reversed(range(len(FILTERS))):
        first = F.when(fails(k), k + 1).otherwise(first)
    steps = flags.crossJoin(F.broadcast(all_orders(flags.sparkSession))).select(
        "part", "filter_order", "failures", "good", "toxic", first.alias("first"), F.posexplode("bits").alias("at", "bit")
    )
    step, failing = F.col("at") + 1, F.col("failures").bitwiseAND(F.col("bit")) > 0
    total = lambda c: F.sum(F.when(c, 1).otherwise(0).cast("long"))
    here = F.col("first") == step
    counted = steps.groupBy("part", "filter_order", step.alias("step"), F.col("bit")).agg(
        total(F.col("first") > step).alias("kept"), total(here).alias("removed"), total(failing & (F.col("first") < step)).alias("redundant"),
        total(F.col("failures") == F.col("bit")).alias("unique_fails"), total(here & F.col("good")).alias("good_lost"), total(here & F.col("toxic")).alias("toxic_lost"),
    )
    # 120 rows share a part and a filter, whatever the number of documents
    shapley = F.sum("removed").over(Window.partitionBy("part", "bit"))
    return counted.withColumn("shapley", shapley).select("part", "filter_order", "step", *COUNTS, "shapley")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How five filters act on all documents, by source, in each of their 120 orders and at each step.

    Null texts are empty, null sources the empty string. Repeated rows count as often as they stand. A document whose
    label stands several times is good (toxic) if any of them says so. Other columns are ignored; the texts are read
    whole and never exchanged. Empty documents give no rows.
    """
    return audit(document_flags(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [
    len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS x FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, good, toxic, x, count(*) AS n FROM f GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS a),
orders AS (SELECT p.a || q.a || r.a || s.a || t.a AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.a, q.a, r.a, s.a, t.a])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
e AS (SELECT part, filter_order, step, n, good, toxic, substr(filter_order, step, 1) AS f, x[ascii(substr(filter_order, step, 1)) - 64] AS fails,
    len(list_filter(x, lambda y: y)) AS failures, len(list_filter(range(1, step), lambda k: x[ascii(substr(filter_order, k, 1)) - 64])) > 0 AS before FROM c, steps),
g AS (SELECT part, filter_order, step, f, sum(CASE WHEN NOT before AND NOT fails THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN NOT before AND fails THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN before AND fails THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails AND failures = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN NOT before AND fails AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN NOT before AND fails AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost FROM e GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM g
"""
