"""Ranked search against brute force: odd tables, ties, blocks, and what is skipped."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np

from strandmill.llm import lexical_search as ls

KIND = "doc_id long, text string, _item long, docs string, rank int, score string"


def terms(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def ranked(docs, items, top=ls.TOP):
    bags = [(i, terms(t)) for i, t in docs]
    bags = [(i, Counter(b), len(b)) for i, b in bags if b]
    total, df = sum(n for _, _, n in bags), Counter(w for _, b, _ in bags for w in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in asked.items():
        rows = []
        for i, b, n in bags:
            m = 100 - 50 + (50 * n * len(bags)) // total
            s = sum(math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * df[w] + 1))) * (10**9 * b[w] // (1000 * b[w] + 20 * m)) for w in words if b[w])
            if s > 0:
                rows.append((-s, i is None, i or 0))
        out += [(item, k, None if no else i, -s) for k, (s, no, i) in enumerate(sorted(rows)[:top], 1)]
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def searched(spark, docs, items, **kw):
    d = spark.createDataFrame([(*r, 1, "d", 2, "s") for r in docs], KIND).repartition(5)
    q = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    got = ls.search(d, q, **kw)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return order(map(tuple, got.collect()))


def corpus(rng, n):
    common, rare = ["the", "of", "Der", "una"], [f"w{k}" for k in range(300)]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else rng.choice(rare)
    return [(i, " ".join(word() for _ in range(rng.choice([1, 5, 40, 200])))) for i in range(n)]


def test_search_is_brute_force(spark):
    rng = random.Random(13)
    docs = corpus(rng, 400)
    docs += [(i, docs[7][1]) for i in range(1000, 1120)]  # more ties than results
    docs += [(None, docs[7][1]), (7, docs[7][1]), (2000, None), (2001, ""), (2002, " ,.\x85!"), (2003, "ÉÀ étE ÉÀ x_y"), (2004, "w1 " * 50000)]
    items = [(1, docs[7][1]), (2, "W1 w2, the"), (2, "w3"), (3, None), (4, "?!"), (5, "nowhere"), (6, "ÉÀ x"), (None, "w9 of"), (8, "the " * 3000 + "w5")]
    assert searched(spark, docs, items) == order(ranked(docs, items))
    assert searched(spark, docs, items, top=3, block_bytes=200) == order(ranked(docs, items, 3))


def test_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == []
    assert searched(spark, [(1, "a")], []) == []
    assert searched(spark, [(1, None), (2, "..")], [(1, "a")]) == []


def test_blocks_are_the_cheapest(monkeypatch):
    monkeypatch.setattr(ls, "LONGEST_BLOCK", 5)
    monkeypatch.setattr(ls, "STRETCH", 12)
    rng = np.random.default_rng(13)
    for _ in range(20):
        sizes = rng.integers(1, 12, 4)
        scores = rng.integers(0, 10, sizes.sum()) * ls.BLOCK_COST // 4
        lists = np.cumsum(sizes) - sizes
        places = np.concatenate([np.sort(rng.choice(30, n, replace=False)) for n in sizes])
        starts = ls.block_starts(scores, places, lists).tolist()
        assert set(lists.tolist()) <= set(starts)
        for a, n in zip(lists.tolist(), sizes.tolist()):
            v, d = scores[a : a + n].tolist(), places[a : a + n].tolist()
            cost = lambda cuts: sum((d[e - 1] + 1 - d[s]) * max(v[s:e]) + ls.BLOCK_COST for s, e in itertools.pairwise([0, *cuts, n]))  # noqa: E731, B023
            every = [c for k in range(n) for c in itertools.combinations(range(1, n), k) if all(e - s <= 5 for s, e in itertools.pairwise([0, *c, n]))]
            mine = [s - a for s in starts if a < s < a + n]
            assert cost(mine) == min(map(cost, every))


def test_stretches_of_long_lists():
    scores = np.random.default_rng(14).integers(0, 10**6, 3000)
    starts = ls.block_starts(scores, np.arange(3000), np.array([0, 1, 1700]))
    assert {0, 1, 1700} <= set(starts.tolist()) and len(set(starts.tolist())) == len(starts)
    assert np.diff(np.append(starts, 3000)).max() <= ls.LONGEST_BLOCK


def test_skipping_reads_less_and_loses_nothing():
    rng = random.Random(15)
    docs = corpus(rng, 6000)
    words = sorted({w for _, t in docs for w in ls.terms_of(t)})
    numbers = {w: k for k, w in enumerate(words)}
    s = ls._Shard()
    for i, t in docs:
        s.add(i, t, numbers)
    row = s.row().to_pylist()[0]
    df = dict(zip(row["terms"], row["df"]))
    weights = [ls.weight(row["n_docs"], df.get(k, 0)) for k in range(len(words))]
    found = ls._Searched(row, row["n_docs"], row["n_terms"], weights)
    query = "the of der w1 w2 w3 w4"
    mine = {numbers[w]: weights[numbers[w]] for w in ls.terms_of(query)}
    places, scores, read = found.search(mine, 10)
    assert [(1, k, i, x) for k, (i, x) in enumerate(ls._best(found.ids, places, scores, 10), 1)] == ranked(docs, [(1, query)], 10)
    assert read < 0.8 * sum(df[t] for t in mine)
