"""Benchmark items that are very long, or that stand many times."""

import random

from strandmill.llm import decontaminate


def test_long_and_repeated_items(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(100_000)]
    passage = [f"p{k}" for k in range(40)]
    items = [(1, " ".join(words)), *((10 + k, " ".join(passage)) for k in range(10_000))]
    docs = [
        (1, "x " * 50 + " ".join(words[500:600]) + " y" * 50), (2, " ".join(words)), (3, "nothing of the kind " * 20), (4, "a " + " ".join(passage[:5] + ["zz"] + passage[6:20])),
        (5, " ".join(words[:6] + words[50:56])),
    ]
    got = decontaminate.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = {(r.doc_id, r.item_id): (r.best_window, r.n_matched, r.n_aligned) for r in got.collect()}
    assert rows.pop((1, 1)) == (13, 100, 200) and rows.pop((2, 1)) == (13, 100_000, 100_000)
    assert rows == {(4, 10 + k): (13, 19, 20) for k in range(10_000)} | {}
