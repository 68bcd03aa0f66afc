"""Exact top-k search by inner product with norm buckets.

Vectors are grouped by length, longest first. For each bucket a query's running threshold becomes a bound on the
cosine that a vector of the bucket needs; the bucket is left out where no vector can reach it, pruned by length where
the bound is low, and by its heaviest coordinates where it is high. What is left is verified by exact products.

Candidates are searched where they are read and never shuffled. Queries go to them in blocks of a bounded size; each block
first meets the longest vectors, and the thresholds found there are handed on to the search of all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

SCALE, K, QUERIES_ONE_IN = 256, 5, 50
#: Vectors in a bucket, vectors that a task holds at a time and of which the longest give the first thresholds, and bytes
#: of a block of queries.
BUCKET, ROWS_A_CELL, BLOCK_BYTES = 2048, 65_536, 8 << 20
#: From this bound on the cosine on, coordinates prune before products are taken.
HIGH_COSINE = 0.6
#: Products are exact as long as no sum of them can reach this; beyond, they are a filter and scores are Python integers.
EXACT = float(1 << 53)


def top_in_cell(q_ids: np.ndarray, q: np.ndarray, v_ids: np.ndarray, v: np.ndarray, k: int = K, stats: dict | None = None, least: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(query id, vector id, score) of each query's k best vectors here, itself left out, ties to smaller ids.

    q and v: integer-valued float64 matrices. Where their products may be inexact, see :func:`top_of_large`.
    least: scores that each query has k vectors of elsewhere; vectors below may be left out.
    """
    if q.size and v.size and not _least_sum(q, v) < EXACT:
        return top_of_large(q_ids, q, v_ids, v, k)
    norms = np.sqrt((v * v).sum(1))
    order = np.lexsort((v_ids, -norms))
    v_ids, v, norms = v_ids[order], v[order], norms[order]
    q_norms = np.sqrt((q * q).sum(1))
    best = np.full((len(q), k), -np.inf)
    best_ids = np.full((len(q), k), np.iinfo(np.int64).max)
    floor = np.full(len(q), -np.inf) if least is None else least
    for at in range(0, len(v), BUCKET):
        b, b_ids, longest = v[at : at + BUCKET], v_ids[at : at + BUCKET], norms[at]
        least = np.maximum(best[:, -1], floor)
        with np.errstate(divide="ignore", invalid="ignore"):
            bound = np.where(q_norms * longest > 0, least / (q_norms * longest), np.where(least > 0, np.inf, -1.0))
        live = np.nonzero(bound <= 1 + 1e-9)[0]
        if not len(live):
            continue
        if stats is not None:
            stats["buckets"] = stats.get("buckets", 0) + len(live)
        for rows, by_coordinate in ((live[bound[live] < HIGH_COSINE], False), (live[bound[live] >= HIGH_COSINE], True)):
            if by_coordinate:
                for i in rows.tolist():
                    # the query's heaviest coordinates f: q.v <= q_f.v_f + |q_rest| |v_rest|
                    f = np.argsort(-np.abs(q[i]), kind="stable")[: max(1, q.shape[1] // 8)]
                    part = b[:, f] @ q[i, f]
                    rest = np.sqrt(np.maximum(q_norms[i] ** 2 - (q[i, f] ** 2).sum(), 0)) * np.sqrt(np.maximum(norms[at : at + BUCKET] ** 2 - (b[:, f] ** 2).sum(1), 0))
                    some = np.nonzero(part + rest >= least[i] - 1e-6 * (1 + abs(least[i])))[0]
                    _merge(i, q_ids, b_ids[some], b[some] @ q[i], best, best_ids)
                    if stats is not None:
                        stats["verified"] = stats.get("verified", 0) + len(some)
                continue
            # by length: the bucket's vectors are in descending length, so each query takes a prefix of them
            if len(rows):
                need = np.where(q_norms[rows] > 0, least[rows] / np.maximum(q_norms[rows], 1e-300), -np.inf)
                take = int(np.searchsorted(-norms[at : at + BUCKET], -(need.min() - 1e-9), side="right"))
                scores = q[rows] @ b[:take].T
                if stats is not None:
                    stats["verified"] = stats.get("verified", 0) + scores.size
                for n, i in enumerate(rows.tolist()):
                    some = np.nonzero(scores[n] >= least[i])[0]
                    _merge(i, q_ids, b_ids[:take][some], scores[n, some], best, best_ids)
    return [(int(q_ids[i]), int(best_ids[i, n]), int(best[i, n])) for i in range(len(q)) for n in range(k) if best[i, n] > -np.inf]


def _least_sum(q: np.ndarray, v: np.ndarray) -> float:
    """A bound on every partial sum of products and of squares."""
    with np.errstate(over="ignore"):
        return q.shape[1] * max(np.abs(q).max(), np.abs(v).max()) ** 2


def top_of_large(q_ids: np.ndarray, q: np.ndarray, v_ids: np.ndarray, v: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """As :func:`top_in_cell`, of components of any size: float products with their error bound choose, integers score.

    Each float product of the scaled matrices is within an error of the exact one that goes with its vector's largest
    component; only vectors that this leaves among the k best are multiplied as integers.
    """
    found = []
    # one scale for all candidates, so that products compare
    qs, vs = np.ldexp(q, -np.frexp(np.abs(q).max(1))[1][:, None]), np.ldexp(v, -np.frexp(np.abs(v).max())[1])
    dim = v.shape[1]
    # of the rounding of products and their sums, and of components that fall below the least float
    error = dim * (4 * dim * 2.0**-53 * np.abs(vs).max(1) + 2.0**-1000)
    for i in range(len(q)):
        others = np.nonzero(v_ids != q_ids[i])[0]
        about, off = vs[others] @ qs[i], error[others]
        if len(others) > k:
            others = others[about + off >= np.partition(about - off, -k)[-k]]
        ints = [int(x) for x in q[i].tolist()]
        scores = [(-sum(x * int(y) for x, y in zip(ints, v[j].tolist())), int(v_ids[j])) for j in others.tolist()]
        found += [(int(q_ids[i]), c, -n) for n, c in sorted(scores)[:k]]
    return found


def score_key(score: int) -> bytes:
    """Bytes that sort as the integers do: its sign and length, then its magnitude, turned round below zero."""
    m = abs(score)
    b = m.to_bytes((m.bit_length() + 7) // 8, "big")
    b = len(b).to_bytes(2, "big") + b
    return b"\1" + b if score >= 0 else b"\0" + bytes(255 - x for x in b)


def _merge(i: int, q_ids, ids: np.ndarray, scores: np.ndarray, best: np.ndarray, best_ids: np.ndarray) -> None:
    own = ids != q_ids[i]
    ids, scores = np.concatenate([best_ids[i], ids[own]]), np.concatenate([best[i], scores[own]])
    k = best.shape[1]
    if len(scores) > 4 * k:
        some = scores >= np.partition(scores, -k)[-k]
        ids, scores = ids[some], scores[some]
    order = np.lexsort((ids, -scores))[:k]
    best[i], best_ids[i] = scores[order], ids[order]


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, x, n): components floor(scale * x) as doubles, without vectors that take no part, and their length squared.

    Doubles from 2^52 on are integers, which a 64-bit floor would cut off. Lengths may be infinite; they only deal rows.
    """

    def floor(v):
        y = v.cast("double") * scale
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)

    x = F.transform(F.col(vector_col), floor)
    fine = F.col(vector_col).isNotNull() & F.coalesce(
        F.forall(F.col(vector_col), lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))), F.lit(False)
    )
    kept = vectors.where(fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
    return kept.withColumn("n", F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))


def top_products(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, one_in: int = QUERIES_ONE_IN, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best inner products with all other rows, ties to smaller ids.

    Queries are the rows whose id is divisible by one_in. They are dealt to blocks of about BLOCK_BYTES by a hash of
    their id, and each block is searched for in all rows; a task keeps k vectors a query.

    Vectors that are null or hold a null or non-finite component, and rows with a null id take no part. Scores rank
    exactly however large; one beyond 64 bits is given as null, at its rank. Components of over 2^1024 / scale raise. Vectors of different dimension aren't compared. Rows that repeat an id are candidates each, but
    not for queries of their own id; a query id that repeats is answered over all its rows' vectors. Empty vectors
    score 0. Empty table: empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    all_ = quantised(vectors, id_col, vector_col, scale)
    asks = F.col("vec_id") % one_in == 0
    rows, size = all_.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(asks, F.size("x") * 8 + 64)), F.lit(0))).first()
    blocks = -(-size // BLOCK_BYTES)
    longest = all_.where(F.col("n") >= all_.approxQuantile("n", [1 - ROWS_A_CELL / rows], 0.01)[0]) if rows > 4 * ROWS_A_CELL else None
    kind = "query_id long, vec_id long, score long, _key binary"
    order = Window.partitionBy("query_id").orderBy(F.desc("_key"), "vec_id")
    best_of = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    parts = []
    for block in range(blocks):
        asked = all_.where(asks & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block)).select("vec_id", "x").toArrow()
        queries = [(ids, q) for _, ids, q in _by_dimension([asked])]
        least: dict[int, float] = {}
        if longest is not None:
            first = best_of(longest.select("vec_id", "x").mapInArrow(_search(spark.sparkContext.broadcast((queries, least)), k), kind))
            least = {r.query_id: float(r.score) for r in first.where(F.col("rank") == k).collect() if r.score is not None}  # a row a query of the block
        found = best_of(all_.select("vec_id", "x").mapInArrow(_search(spark.sparkContext.broadcast((queries, least)), k), kind))
        parts.append(found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
        if blocks > 1:  # one job a block, so that the next one's queries come when these are through
            parts[-1] = stored(parts[-1], "top-k")
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _by_dimension(batches: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, ids, matrix) of the vectors of batches or tables, for each dimension there is."""
    ids, lengths, flat = [], [], []
    for b in batches:
        for x in b.column("x").chunks if isinstance(b, pa.Table) else [b.column("x")]:
            lengths.append(x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            flat.append(x.flatten().to_numpy(zero_copy_only=False))
        ids.append(b.column("vec_id").to_numpy().astype(np.int64))
    if not ids:
        return
    ids, lengths, flat = np.concatenate(ids), np.concatenate(lengths or [np.zeros(0, np.int64)]), np.concatenate(flat or [np.zeros(0)])
    if not (np.isfinite(flat).all()):
        raise ValueError("a finite component is beyond a double when scaled")
    for dim in np.unique(lengths).tolist():
        own = lengths == dim
        yield dim, ids[own], flat[np.repeat(own, lengths)].reshape(int(own.sum()), dim)


def _search(shared, k: int):
    """For mapInArrow: each query's k best of a task's vectors, which are searched ROWS_A_CELL at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, known = shared.value
        best: dict[int, list[tuple[int, int, int]]] = {}

        def search(held: list) -> None:
            for dim, v_ids, v in _by_dimension(held):
                for q_ids, q in queries:
                    if q.shape[1] != dim:
                        continue
                    # a query has k here, or somewhere else, of at least this score
                    own = [(-best[i][k - 1][0] if len(best.get(i, ())) >= k else float("-inf")) for i in q_ids.tolist()]
                    least = np.array([max(a, known.get(i, float("-inf"))) for a, i in zip(own, q_ids.tolist())], float)
                    found: dict[int, list[tuple[int, int, int]]] = {}
                    for i, c, score in top_in_cell(q_ids, q, v_ids, v, k, least=least):
                        found.setdefault(i, []).append((-score, c))
                    for i, more in found.items():
                        best[i] = sorted([*best.get(i, ()), *more])[:k]

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= ROWS_A_CELL:
                search(held)
                held, n = [], 0
        search(held)
        out = [(i, c, -s) for i, top in best.items() for s, c in top]
        fits = lambda s: s if -(1 << 63) <= s < 1 << 63 else None
        yield pa.RecordBatch.from_arrays([
            pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([fits(x[2]) for x in out], pa.int64()),
            pa.array([score_key(x[2]) for x in out], pa.binary()),
        ], ["query_id", "vec_id", "score", "_key"])

    return run


def op10_topk(spark, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every fiftieth vector with all the others."""
    return top_products(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
