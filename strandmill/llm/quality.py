"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A bounded sample of labelled documents is turned into weighted counts of terms (hashed byte bigrams, bigrams of kinds of
characters, words said twice, classes of length), of which a truncated singular value decomposition gives the latent
directions. Documents are compared along those directions only. The labelled vectors (a few thousand, so a few
megabytes, whatever the corpus holds) are broadcast, and every document's cosines to all of them are computed exactly,
in blocks, as matrix products. The nearest vote with their labels, weighted by similarity.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, give_back, table

#: Bounds of what is fitted and broadcast: labelled rows, hashed terms, latent directions.
MOST_LABELLED, TERMS, DIRECTIONS = 4096, 2048, 64
NEIGHBOURS, SHARPNESS = 15, 16
#: Kinds of bytes (their bigrams are terms), classes of a text's number of words, and how heavy these terms are.
KINDS, LENGTHS, SHAPE_WEIGHT = 6, 8, 2.0
SHAPES = KINDS * KINDS + 1 + LENGTHS
#: Documents from this score on are accepted.
ACCEPT = 0.7
#: Documents whose cosines are computed as one product, and labelled rows weighted at a time: a worker's memory is small.
BLOCK = 128


@dataclass
class QualityModel:
    weights: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


def _kinds() -> np.ndarray:
    """Of each byte: 0 white space, 1 capital, 2 small letter, 3 digit, 4 other ASCII, 5 part of another character."""
    chars = [chr(b) for b in range(128)]
    ascii_ = [0 if c.isspace() else 1 if c.isupper() else 2 if c.islower() else 3 if c.isdigit() else 4 for c in chars]
    return np.array(ascii_ + [5] * 128, np.int64)


_KIND = _kinds()


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of a text's terms: hashed byte bigrams, and after them what its shape gives."""
    raw = (text or "").encode("utf-8")
    out = np.zeros(TERMS + SHAPES, np.float32)
    n = len(raw)
    words = raw.split()
    if n > 1:
        b = np.frombuffer(raw, np.uint8)
        pairs = (b[:-1].astype(np.uint32) * np.uint32(257) + b[1:]) * np.uint32(0x9E3779B1) >> np.uint32(15)
        out[:TERMS] = np.bincount((pairs & np.uint32(TERMS - 1)).astype(np.int64), minlength=TERMS) / n
        kinds = _KIND[b]
        out[TERMS : TERMS + KINDS * KINDS] = np.bincount(kinds[:-1] * KINDS + kinds[1:], minlength=KINDS * KINDS) / n
    out[TERMS + KINDS * KINDS] = sum(map(bytes.__eq__, words, words[1:])) / max(1, len(words))
    # a class for each doubling of the number of words, the last from 2^(2 * LENGTHS - 3) on
    out[TERMS + KINDS * KINDS + 1 + min(LENGTHS - 1, (len(words).bit_length() + 1) // 2)] = 0.1
    return np.sqrt(out)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _embed(x: np.ndarray, weights: np.ndarray, directions: np.ndarray) -> np.ndarray:
    return _unit(_unit(x.astype(np.float64) * weights) @ directions)


def fit(x: np.ndarray, y: np.ndarray, seed: int = 42) -> QualityModel:
    """The model of labelled feature rows: weights of terms, directions by a randomised decomposition, labelled vectors."""
    if not len(y):
        return QualityModel(np.ones(TERMS + SHAPES), np.zeros((TERMS + SHAPES, 1)), np.zeros((0, 1)), np.zeros(0), 0.5)
    weights = np.log((len(y) + 1) / (1 + (x > 0).sum(0))) + 1
    weights[TERMS:] *= SHAPE_WEIGHT
    m = np.empty(x.shape)  # the one whole copy of x
    for at in range(0, len(x), BLOCK):
        m[at : at + BLOCK] = _unit(x[at : at + BLOCK].astype(np.float64) * weights)
    q = m.T @ (m @ np.random.default_rng(seed).standard_normal((m.shape[1], min(DIRECTIONS + 16, m.shape[1]))))
    for _ in range(3):
        q, _ = np.linalg.qr(q)
        q = m.T @ (m @ q)
    q, _ = np.linalg.qr(q)
    directions = q @ np.linalg.svd(m @ q, full_matrices=False)[2].T[:, :DIRECTIONS]
    return QualityModel(weights, directions, _unit(m @ directions), y.astype(np.float64), float(y.mean()))


def vote(model: QualityModel, x: np.ndarray) -> np.ndarray:
    """Scores of feature rows: cosines to all labelled vectors, the nearest weighted by a power of their cosine.

    All vectors as near as the last of the nearest vote too, so ties don't depend on the order of the labels.
    """
    if not len(model.labels):
        return np.full(len(x), model.prior)
    out = np.empty(len(x))
    for at in range(0, len(x), BLOCK):
        cosines = np.round(_embed(x[at : at + BLOCK], model.weights, model.directions) @ model.vectors.T, 6)
        k = min(NEIGHBOURS, cosines.shape[1])
        last = np.partition(cosines, -k, axis=1)[:, -k, None]
        near = np.where(cosines >= last, np.maximum(cosines, 0), 0) ** SHARPNESS
        total = near.sum(1)
        out[at : at + BLOCK] = np.where(total > 0, near @ model.labels / np.maximum(total, 1e-300), model.prior)
    return np.round(np.clip(out, 0, 1), 6)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELLED) -> QualityModel:
    """Fit on at most ``most`` labelled documents, chosen by a hash of their id, none of them held out.

    Labels without a document, null labels and held-out ids are not used; of repeated ids one row is. No such row: a
    model that scores 0.5. Null texts count as empty; very long ones are taken whole.
    """
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("double").alias("_y"))
        .orderBy(F.xxhash64(F.col("_id").cast("string"), F.lit(7)), "_id").limit(most)
    )
    texts = (
        docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
        .join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min("_y").alias("_y"), F.min("_text").alias("_text"))
    )

    def featurise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("_id").cast(pa.string()), b.column("_y"), pa.array([features(t).tobytes() for t in b.column("_text").to_pylist()], pa.binary())], ["_id", "_y", "_x"]
            )

    def fitted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("_id", "_y", "_x"))))
        x = np.array([np.frombuffer(r[2], np.float32) for r in rows]) if rows else np.zeros((0, TERMS + SHAPES), np.float32)
        y = np.array([r[1] for r in rows])
        del rows
        model = fit(x, y)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # at most `most` rows of 8 KB go to one task, and a model of a few megabytes to the driver, whose memory is small
    found = texts.mapInArrow(featurise, "_id string, _y double, _x binary").repartition(1).mapInArrow(fitted, "model binary").collect()
    return pickle.loads(found[0].model) if found else fit(np.zeros((0, TERMS + SHAPES), np.float32), np.zeros(0))


def score_documents(docs: DataFrame, model: QualityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 for every whole text, the higher the likelier label 1; nothing else is an input.

    Null text: scored as the empty text. A text without any similar labelled text, or a model without labels: the
    share of label 1 (0.5 if there are no labels). Repeated rows: each is scored, alike. Very long texts are taken
    whole. Empty table: empty result. A column of the input named like the new one is replaced.
    """
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores: list[float] = []
            texts = b.column(text_col)
            for at in range(0, len(texts), BLOCK):
                scores.extend(vote(shared.value, np.array([features(t) for t in texts.slice(at, BLOCK).to_pylist()])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, out])
        give_back()

    return docs.mapInArrow(run, T.StructType(list(docs.schema.fields)).add(out, T.DoubleType()))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's quality score; a quarter of the ids is held out from fitting."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted")
    )


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts, unchanged, whatever their other columns are named.

    See :func:`fit_quality` and :func:`score_documents` for odd rows; without any label all have 0.5, and none is kept.
    """
    model, score = fit_quality(docs, table(spark, sf_dir, "labels")), free_name(docs, "_score")
    return score_documents(docs, model, out=score).where(F.col(score) >= ACCEPT).drop(score)
