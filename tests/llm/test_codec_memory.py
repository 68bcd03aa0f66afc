"""Of a large batch of texts few are Python objects, or encoded, at a time; the pipeline's batches are small in the first place."""

import pyarrow as pa
import pytest

import corpus_pipeline
from strandmill.llm import spm_codec

from .test_memory import peak_mb


class Docs:
    """A table that only keeps what is to be run on its batches."""

    def __init__(self, schema):
        self.schema = schema

    def drop(self, *names):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def encoder(spark):
    run = spm_codec.encode_documents(Docs(spark.createDataFrame([], "doc_id long, text string").schema))
    return lambda texts: run(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])]))


def test_a_large_batch_is_encoded_in_small_parts(spark):
    run, n = encoder(spark), []
    list(run(["loads the model"]))
    texts = [f"{i} some words  and {'more ' * 400}" for i in range(2000)]
    assert peak_mb(lambda: n.extend(b.num_rows for b in run(texts))) < 6
    assert sum(n) == len(texts)


def test_parts_give_what_each_text_alone_gives(spark):
    texts = ["x" * 90_000, None, "", "a b  c", "y " * 140_000, "é漢\n", *("z" * n for n in range(40)), "w" * 200_000]
    parts = list(encoder(spark)(texts))
    rows = [r for b in parts for r in b.to_pylist()]
    assert len(parts) > 1 and [r["text"] for r in rows] == texts and [r["doc_id"] for r in rows] == list(range(len(texts)))
    c = spm_codec.codec(spm_codec.MODEL_PATH)
    for r in rows:
        assert r["token_ids"] == (None if r["text"] is None else c.encode([r["text"]])[0])
        assert r["round_trip"] is r["parity"] is (None if r["text"] is None else True)


@pytest.mark.parametrize("stage", [corpus_pipeline.good_quality, corpus_pipeline.no_near_copies, corpus_pipeline.tokens])
def test_stages_send_texts_in_small_batches(spark, tmp_path, stage):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "repeat('some words ', 500) AS text")
    spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        stage(spark, docs.limit(20), str(tmp_path))
        assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) < 6 << 20
        spark.conf.set(key, "1m")  # a limit of the session's own stays
        stage(spark, docs.limit(20), str(tmp_path))
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
