"""The one-pass state of a summary against the separate aggregates, and the prefix sums behind medians and N50."""

import os
import random

import pytest
from pyspark.sql import functions as F

from strandmill import settings
from strandmill.operators import metrics as M
from strandmill.operators.annotate import annotate
from strandmill.operators.summary import Summary, cells, merge, middle, quality_cells, state
from strandmill.plans import qc, registry

DATA = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def assessed(spark):
    df = registry.assessed(spark, DATA).persist()
    yield df
    df.unpersist()


def rows(df, *columns):
    return {tuple(r[c] for c in columns): r for r in df.collect()}


def same(got, want):
    assert set(want) <= set(got)
    assert all(got[k] == pytest.approx(v) for k, v in want.items())


@needs_tables
def test_state_holds_what_the_aggregates_give(spark, assessed):
    s = registry.query_settings()
    reads = registry.reads(spark, DATA)
    found = Summary(state(cells(assessed, s).unionByName(quality_cells(reads))).collect())
    want = M.totals(assessed, s).first()
    got = found.totals()
    assert got["reads"] == want.total_reads and all(got[k] == want[k] for k in got if k != "reads")
    lengths = found.histogram("length")
    assert sum(v * n for v, n in lengths.items()) == want.total_bases and (min(lengths), max(lengths)) == (want.min_read_length, want.max_read_length)
    for kind, hist, key in (("length", M.length_histogram(assessed), "length"), ("qscore", M.qscore_histogram(assessed), "qscore")):
        assert found.histogram(kind) == {r[key]: r["count"] for r in hist.collect()}
    length = M.length_summary(M.length_histogram(assessed)).first()
    assert middle(lengths) == (length.median, length.n50)
    assert {(r.n, r.m * M.Q_BIN, r["count"]) for r in found.of("bin")} == {tuple(r) for r in M.length_q_bins(assessed).collect()}
    assert {r.n: r.v0 for r in found.of("phred")} == {r.phred: r["count"] for r in M.base_quality_histogram(reads).collect()}
    for names, columns in ((("a",), ("label",)), (("b",), ("bucket",)), (("b", "a"), ("bucket", "label")), (("a", "c"), ("label", "orientation"))):
        want = {k if len(k) > 1 else k[0]: (r["count"], r["first"]) for k, r in rows(M.counts_by(assessed, *columns), *columns).items()}
        assert found.counts("class", *names) == want
    for anchor, r in rows(M.anchor_stats(assessed), "anchor").items():
        same(found.anchors()[anchor[0]], {k: v for k, v in r.asDict().items() if k != "anchor"})
    for name, r in rows(M.segment_stats(assessed), "name").items():
        same(found.segments()[name[0]], {k: v for k, v in r.asDict().items() if k != "name"})
    assert set(found.coverage()) == {tuple(r) for r in M.heatmap(assessed).select("bucket", "label", "bin", "reads").collect()}
    assert {k: v[0] for k, v in found.counts("barcode_status", "a").items()} == {r.barcode_status: r["count"] for r in M.counts_by(assessed, "barcode_status").collect()}


@needs_tables
def test_barcodes_of_a_summary(assessed):
    s = registry.query_settings()
    out = qc.summarise(assessed, s)["barcode_qc"]
    assert out["top_raw_barcodes"] == [[r.raw_barcode, r["count"]] for r in M.top_barcodes(assessed).collect()]
    umi = M.umi_stats(assessed).first()
    assert (out["unique_raw_umis"], out["umi_singleton_ratio"]) == (umi.unique_raw_umis, pytest.approx(umi.umi_singleton_ratio))
    assert out["unique_raw_barcodes"] == assessed.where(F.length("raw_barcode") > 0).agg(F.count_distinct("raw_barcode")).first()[0]
    far = assessed.where("nearest_distance is not null").groupBy("nearest_distance").count()
    assert out["edit_distance_counts"] == {r.nearest_distance: r["count"] for r in far.collect()}


def as_set(df):
    return {tuple(None if x is None else round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()}


@needs_tables
def test_states_merge_and_keep_samples_apart(assessed):
    s = registry.query_settings()
    halves = [assessed.where(F.col("read_index") % 2 == k) for k in (0, 1)]
    assert as_set(merge(*[state(cells(h, s)) for h in halves])) == as_set(state(cells(assessed, s)))
    keyed = state(cells(assessed.withColumn("sample", F.concat(F.lit("s"), F.col("read_index") % 2)), s, "sample"), "sample")
    for k, half in enumerate(halves):
        assert as_set(keyed.where(F.col("sample") == f"s{k}").drop("sample")) == as_set(state(cells(half, s)))


@needs_tables
def test_a_summary_is_one_or_two_jobs(spark, assessed):
    assessed.count()
    tracker = spark.sparkContext.statusTracker()
    plain = settings.from_dict({"anchors": [{"name": "left", "type": "fixed", "sequence": registry.LEFT}]})
    for s, df, most in ((registry.query_settings(), assessed, 2), (plain, annotate(registry.reads(spark, DATA), plain), 1)):
        spark.sparkContext.setJobGroup(f"summary{most}", "")
        spark.conf.set("spark.sql.adaptive.enabled", "false")  # it submits each exchange as a job of its own
        try:
            qc.summarise(df, s)
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        jobs = len(tracker.getJobIdsForGroup(f"summary{most}"))
        spark.sparkContext.setJobGroup("", "")
        assert jobs <= most + 1, jobs  # a top-k may look at one partition first


def test_no_reads_give_zeros(spark):
    s = settings.from_dict({"anchors": [{"name": "left", "type": "fixed", "sequence": registry.LEFT}]})
    none = spark.createDataFrame([], "read_index long, read_id string, sequence string, quality string")
    out = qc.summarise(annotate(none, s), s)
    assert (out["total_reads"], out["n50"], out["median_read_length"], out["max_read_length"], out["structure_counts"]) == (0, 0, 0.0, 0, {})


def test_stream_of_states(spark, tmp_path):
    from strandmill.streaming import summary_stream

    shape = "read_index long, read_id string, sequence string, quality string"
    made = [(i, f"r{i}", "ACGT" * (i + 5), "I" * 4 * (i + 5)) for i in range(6)]
    spark.createDataFrame(made, shape).repartition(3).write.parquet(str(tmp_path / "in"))
    s = settings.from_dict({"anchors": [{"name": "left", "type": "fixed", "sequence": registry.LEFT}]})
    source = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = summary_stream(source, s).writeStream.outputMode("complete").format("memory").queryName("states").start()
    q.processAllAvailable()
    q.stop()
    found = Summary(spark.table("states").collect())
    assert found.totals()["reads"] == 6 and found.histogram("length") == {4 * (i + 5): 1 for i in range(6)}


@pytest.mark.parametrize(("top", "n"), [(1, 1), (50, 30), (5000, 200), (3_000_000, 300), (2**31 - 1, 200)])
def test_prefix_sums(spark, top, n):
    rng = random.Random(top)
    hist = {v: rng.randrange(1, 6) for v in rng.sample(range(top), n)}
    df = spark.createDataFrame([*hist.items(), (None, 4)], "length int, count long")
    run = M.prefix_sums(df, "length", n=F.col("count"))
    before, want = 0, {}
    for v in sorted(hist):
        want[v] = (before, before + hist[v], sum(hist.values()))
        before += hist[v]
    assert {r.length: (r.n_before, r.n_to, r.n_all) for r in run.collect()} == want
    ascending = dict(sorted(hist.items()))
    assert M.length_summary(df).first()[:2] == (middle(ascending).n50, middle(ascending).median)


def test_prefix_sums_read_a_histogram_once(spark):
    df = M.length_histogram(spark.range(5000).select((F.col("id") % 1500).cast("int").alias("length")))
    run = M.prefix_sums(df, "length", n=F.col("count"))
    run.collect()
    assert run._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("ReusedExchange") >= 2


def test_bytes_are_counted_in_their_buffer():
    import pyarrow as pa

    texts = pa.array(["II5", None, "", "A"])
    assert M.byte_counts(texts).sum() == 4 and M.byte_counts(texts.slice(1))[ord("A")] == 1 and M.byte_counts(texts.slice(0, 2))[ord("I")] == 2
    assert M.byte_counts(pa.array([], pa.string())).sum() == 0 == M.byte_counts(pa.array([None], pa.string())).sum()


@needs_tables
def test_nothing_stays_persisted(spark, tmp_path):
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    registry.barcode_status(spark, DATA).count()
    (tmp_path / "s.fastq").write_text("@a\nAAAAACGTGGCCCC\n+\nIIIIIIIIIIIIII\n")
    (tmp_path / "wl.txt").write_text("ACGT\n")
    s = settings.from_dict({
        "anchors": [{"name": "l", "type": "fixed", "sequence": "AAAA"}], "structure": {"expected_order": ["l"]},
        "barcode": {"enabled": True, "left_anchor": "l", "barcode_length": 4, "umi_length": 2, "whitelist_path": str(tmp_path / "wl.txt")},
    })
    assert qc.run_qc(spark, str(tmp_path / "s.fastq"), s, str(tmp_path / "o"), export_csv=True)["barcode_qc"]["status_counts"] == {"exact": 1}
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) <= before
