"""Odd tables: empty ones, very long texts, columns whose names clash, rows that repeat."""

import math
import random

import numpy as np
import pytest

import corpus_pipeline
from strandmill.llm import decontaminate, quality, spm_codec, suffix_dedup, url_filter, warc

CLASHES = ("_doc", "_gone", "_drop", "_found", "_score", "_text", "_fp", "_line", "_id", "score", "node", "root")


def words(rng, n, vocabulary=3000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder, rng = str(tmp_path_factory.mktemp("edges")), random.Random(50)
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, words(rng, 30)), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_let_columns_of_any_name_through(spark, tables, stage):
    rng = random.Random(51)
    rows = [(i, words(rng, 40) if i % 3 else "SPAM!! " * 30, "en", "s", 1, *(f"{c}{i}" for c in CLASHES)) for i in range(60)]
    rows += [rows[4], (None, None, "en", "s", 0, *CLASHES), (77, "", "en", "s", 0, *CLASHES)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
    docs = spark.createDataFrame(rows, kind)
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, tables)
    assert out.columns[: len(docs.columns)] == docs.columns
    got = out.collect()
    assert got and all(r[c] == f"{c}{r.doc_id}" for r in got if r.doc_id is not None and r.doc_id < 60 for c in CLASHES)
    none = dict(corpus_pipeline.STAGES)[stage](spark, docs.limit(0), tables)
    assert none.count() == 0 and none.columns == out.columns


def test_voting_is_brute_force():
    rng = np.random.default_rng(52)
    texts = ["".join(rng.choice(list("abc ABC!é"), int(n))) for n in rng.integers(0, 200, 60)]
    x, y = np.array([quality.features(t) for t in texts]), rng.integers(0, 2, 60)
    model = quality.fit(x[:40], y[:40])
    embed = lambda v: [sum(a * b for a, b in zip(v, d)) for d in model.directions.T]
    size = lambda v: math.sqrt(sum(a * a for a in v)) or 1.0
    for k in range(40, 60):
        v = [a * w for a, w in zip(x[k].tolist(), model.weights.tolist())]
        v = embed([a / size(v) for a in v])
        near = []
        for label, u in zip(model.labels.tolist(), model.vectors.tolist()):
            near.append((round(sum(a * b for a, b in zip(v, u)) / size(v), 6), label))
        last = sorted((c for c, _ in near), reverse=True)[quality.NEIGHBOURS - 1]
        votes = [(max(c, 0) ** quality.SHARPNESS, label) for c, label in near if c >= last]
        want = sum(w * label for w, label in votes) / sum(w for w, _ in votes)
        assert abs(quality.vote(model, x[k : k + 1])[0] - want) < 1e-4


def test_quality_of_odd_tables(spark, tables):
    docs = spark.createDataFrame([(i, "good words here " * 5 if i % 3 else "JUNK!! " * 9) for i in range(60)], "doc_id long, text string")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    empty = quality.fit_quality(docs.limit(0), labels)
    assert quality.score_documents(docs.limit(2), empty).first().score == 0.5
    model = quality.fit_quality(docs, labels)
    odd = spark.createDataFrame([(1, "good words here " * 100_000), (1, "good words here " * 100_000), (2, None), (3, "")], "doc_id long, text string")
    got = [r.score for r in quality.score_documents(odd, model).orderBy("doc_id").collect()]
    assert got[0] == got[1] > 0.7 and got[2] == got[3]
    assert quality.score_documents(docs.limit(0), model).count() == 0


def test_codec_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "long  text, " * 50_000), (2, ""), (3, None), (4, "a"), (4, "a")], "doc_id long, token_ids string")
    coded = spm_codec.encode_documents(docs.withColumnRenamed("token_ids", "text"))
    back = spm_codec.decode_documents(coded.drop("parity"), out="text")
    want = sorted((r.doc_id, str(r.token_ids)) for r in docs.collect())
    assert sorted((r.doc_id, str(r.text)) for r in back.collect()) == want
    assert coded.where("not round_trip or not parity").count() == 0
    assert spm_codec.encode_documents(coded.select("doc_id", "text").limit(0)).count() == 0
    assert spm_codec.decode_documents(coded.limit(0)).count() == 0


def test_texts_with_and_without_double_spaces():
    c = spm_codec.Codec(spm_codec.MODEL_PATH)
    texts = ["the words of a text", "  and of\nanother,  with▁marks ", "", "été 日本", " a", "▁", "a ▁b"]
    assert c.encode(texts) == c.reference(texts)
    assert c.encode([]) == []


def test_benchmark_passage_in_a_very_long_text(spark):
    rng = random.Random(53)
    item = words(rng, 20)
    long = words(rng, 60_000)
    docs = spark.createDataFrame([(1, long + " " + item + " " + long), (2, long)], "doc_id long, text string")
    got = decontaminate.find_overlaps(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.n_matched) for r in got] == [(1, 7, 20)]


def test_operators_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.find_repeats(docs).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.judge_urls(pages).count() == 0
    assert warc.read_records(warc.write_archives(pages)).count() == 0


@pytest.mark.parametrize("bound", [32 << 20, 0])
def test_very_long_payloads_and_both_ways_to_their_first(spark, monkeypatch, bound):
    monkeypatch.setattr(warc, "small", lambda df, n: df if not bound else warc.F.broadcast(df))
    pages = [(1, "u", "x" * 3_000_000), (2, "u", "x" * 3_000_000), (3, "u", "y"), (4, "u", "y"), (None, "u", "x" * 3_000_000)]
    got = warc.read_records(warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"))).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in got) == [
        ("1", "revisit", 2, 3_000_000), ("2", "response", None, 3_000_000), ("3", "response", None, 1), ("4", "response", None, 1), ("None", "revisit", 2, 3_000_000)]


def test_urls_of_hosts_that_the_model_has_not_seen():
    """Five folds by host word: unseen good hosts are let through; of unseen bad ones, it knows some."""
    words_of = lambda url: next((w for w in (*url_filter._GOOD_HOSTS, *url_filter._BAD_HOSTS) if w in url_filter.split_url(url)[0].split(".")), "")
    names = sorted({words_of(u) for u, _ in url_filter.LABELLED_URLS} - {""})
    right = {0: [], 1: []}
    for fold in range(5):
        held = set(names[fold::5])
        bias, weights = url_filter.fit_weights(tuple(x for x in url_filter.LABELLED_URLS if words_of(x[0]) not in held))
        for url, label in url_filter.LABELLED_URLS:
            if words_of(url) in held:
                host, path = url_filter.split_url(url)
                grams = url_filter._grams(host, url_filter.HOST_SALT) + url_filter._grams(path, url_filter.PATH_SALT)
                right[label].append((bias * max(1, len(grams)) + sum(weights[g] for g in grams) > 0) == bool(label))
    assert np.mean(right[0]) > 0.95 and np.mean(right[1]) > 0.5


@pytest.mark.parametrize("name", url_filter.JUDGED)
def test_urls_with_ids_of_any_name(spark, name):
    pages = spark.createDataFrame([(7, "https://net/x"), (8, None)], f"{name} long, url string")
    got = url_filter.judge_urls(pages, id_col=name)
    assert got.columns == [name + "_", *url_filter.JUDGED]
    assert {(r[0], r.rule) for r in got.collect()} == {(7, "net/"), (8, None)}
