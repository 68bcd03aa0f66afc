"""What Python workers hold stays small: an executor's limit is for its JVM and for them together."""

import tracemalloc

import numpy as np
import pyarrow as pa

from strandmill.llm import quality, shingle_sets, spm_codec, suffix_dedup


def peak_mb(f) -> float:
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_fitting_holds_one_copy_of_the_rows():
    x = np.random.default_rng(1).random((2048, quality.TERMS + quality.SHAPES), np.float32)
    y = np.arange(len(x)) % 2
    assert peak_mb(lambda: quality.fit(x, y)) < 1.5 * x.size * 8 / 1e6


def test_votes_are_counted_in_small_blocks():
    rng = np.random.default_rng(2)
    x = rng.random((512, quality.TERMS + quality.SHAPES), np.float32)
    vectors = rng.random((quality.MOST_LABELLED, quality.DIRECTIONS))
    model = quality.QualityModel(np.ones(x.shape[1]), rng.random((x.shape[1], quality.DIRECTIONS)), vectors, np.ones(len(vectors)), 0.5)
    assert peak_mb(lambda: quality.vote(model, x)) < 24


def test_buckets_are_paired_in_small_blocks():
    n = 1024
    rows = np.stack([np.zeros(n), np.arange(n), np.full(n, 10), np.zeros(n), np.arange(n)], axis=1).astype(np.int64)
    found = []
    assert peak_mb(lambda: found.extend(b.num_rows for b in shingle_sets._across(4, 5)(rows))) < 40
    assert sum(found) >= n * (n - 1) // 2


def test_memory_of_encoded_batches_is_given_back():
    anon = lambda: next(int(line.split()[1]) for line in open("/proc/self/smaps_rollup") if line.startswith("Pss_Anon")) / 1024
    spm_codec.give_back()
    before = anon()
    kept = [bytes(1000) for _ in range(100_000)]
    del kept[:-1]  # the last one keeps the allocator from lowering the heap's end
    spm_codec.give_back()
    assert anon() - before < 20


def test_anchors_take_few_bytes_of_text_at_a_time():
    texts = [np.random.default_rng(i).integers(97, 123, 4000, np.uint8).tobytes() for i in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.binary())], ["_id", "_text"])
    found = []
    assert peak_mb(lambda: found.extend(b.num_rows for b in suffix_dedup._anchor_rows(200, True)([batch]))) < 48
    assert sum(found) > 10_000


def test_digests_are_made_where_spans_are(spark, tmp_path):
    spark.createDataFrame([(1, "a" * 300), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = suffix_dedup.op1_suffix_dedup(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert "MapInArrow" in plan[0] and not any("MapInArrow" in line for line in plan[1:3])
