"""The pipeline's stages on planted cases, and its queries on the smallest tables."""

import os
import random

import pytest

import __spark_entry__
import corpus_pipeline
from strandmill.llm import registry

DATA = "/root/testdata/sf0.001"


def text(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(13)
    folder = str(tmp_path_factory.mktemp("sf"))
    clean = [(i, text(rng, 90) + "\n" + text(rng, 60)) for i in range(60)]
    item = text(rng, 40)
    rows = [*clean, (100, text(rng, 80).upper().replace(" ", "!! ")), (101, clean[3][1]), (102, clean[4][1].replace("w1", "v1", 1)), (103, text(rng, 50) + " " + item + " " + text(rng, 50)), (104, None), (105, "")]
    junk = [(200 + i, text(rng, 60).upper().replace(" ", "!! ")) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows + junk], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in clean] + [(i, 0, 0) for i, _ in junk], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_keep_clean_documents_and_catch_the_rest(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    names, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, planted)
        seen[name] = {r.doc_id: r for r in docs.collect()}
        assert docs.columns[: len(names)] == names
        assert set(range(60)) <= set(seen[name]), name
    assert 100 not in seen["quality"]
    assert 101 not in seen["near_copies"] or not seen["lines"][101].text.strip()
    assert 103 in seen["near_copies"] and 103 not in seen["benchmark"]
    assert all(r.round_trip for r in seen["tokens"].values() if r.text is not None)
    assert {r.doc_id for r in corpus_pipeline.run(spark, planted).collect()} == set(seen["tokens"])


def test_empty_documents(spark, planted, tmp_path):
    folder = str(tmp_path)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{planted}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", registry.queries())
def test_queries(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = __spark_entry__.queries()[name](spark, DATA)
    form = lambda v: "null" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    rows = lambda found, columns: sorted(tuple(form(r[i]) for i in sorted(range(len(columns)), key=columns.__getitem__)) for r in found)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    cursor = con.execute(sql)
    assert got == rows(cursor.fetchall(), [c[0] for c in cursor.description])
