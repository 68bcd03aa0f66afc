"""The pipeline's near-copy stage: what its bounds let through, and the fingerprints by which sets meet."""

import itertools
import random

import numpy as np

from strandmill.llm import shingle_sets, simhash


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def changed(rng, text, n):
    w = text.split()
    for at in rng.sample(range(len(w)), n):
        w[at] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def test_parities_differ_in_no_more_than_the_sets_do():
    rng = np.random.default_rng(60)
    for n, m, shared in [(0, 0, 0), (0, 1, 0), (1, 1, 1), (60, 70, 55), (127, 130, 120), (128, 129, 128), (900, 1100, 800), (5000, 9000, 4000)]:
        h = np.unique(rng.integers(0, 1 << 63, n + m - shared, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        rng.shuffle(h)
        x, y = np.sort(h[:n]), np.sort(h[n - shared :])
        odd = [shingle_sets.parities(s) for s in (x, y)]
        assert shingle_sets.apart(*odd) == shingle_sets.apart(*odd[::-1]) <= len(np.setxor1d(x, y))
        assert shingle_sets.apart(odd[0], odd[0]) == 0


def test_texts_of_pairs_that_cannot_be_similar_stay(spark):
    rng = random.Random(61)
    rows = [(0, ""), (1, "one")]
    for size in (12, 40, 150, 400, 3000):
        base = words(rng, size)
        rows += [(len(rows), base), (len(rows) + 1, changed(rng, base, max(1, size // 60))), (len(rows) + 2, changed(rng, base, size // 4)), (len(rows) + 3, words(rng, size))]
    classes = shingle_sets.sets_of(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 5).withColumnRenamed("doc_id", "_least")
    fp = {r._least: r._fp for r in classes.collect()}
    assert len(set(fp.values())) == len(rows)
    pairs = spark.createDataFrame([(fp[a], fp[b]) for a, b in itertools.combinations(fp, 2)], "u long, v long")
    got = {(r._uid, r._vid) for r in shingle_sets.near_pairs(pairs, classes, 4, 5).collect()}
    sets = {d: shingle_sets.shingle_set(t, 5) for d, t in rows}
    alike = {(a, b): len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) for a, b in itertools.combinations(fp, 2)}
    assert {p for p, s in alike.items() if s >= 0.8} <= got
    assert all(alike[p] >= 0.3 for p in got) and len(got) < len(alike) / 10


def test_classes_meet_by_fingerprints(spark):
    rows = [(1, 5), (2, 5), (3, 5 ^ 0b1111), (4, 5 ^ (0b11111 << 20)), (7, -1), (8, -2 ^ (1 << 62))]
    classes = spark.createDataFrame(rows, "_fp long, _print long")
    got = {(r.u, r.v) for r in shingle_sets.print_pairs(classes).collect()}
    assert got == {(1, 2), (1, 3), (7, 8)}


def test_near_copies_that_only_fingerprints_bring_together(spark, monkeypatch):
    nothing = lambda num, den: lambda rows: iter(())
    monkeypatch.setattr(shingle_sets, "_star", nothing)
    monkeypatch.setattr(shingle_sets, "_across", nothing)
    rng = random.Random(62)
    rows = [(i, words(rng, 2000)) for i in range(6)]
    near = [(10 + i, changed(rng, t, 1)) for i, t in rows]
    prints = {d: simhash.print_of(shingle_sets.shingle_set(t, 5)) for d, t in rows + near}
    linked = {d for d, _ in near if (prints[d] ^ prints[d - 10]).bit_count() <= simhash.BITS}
    assert linked
    kept = {r.doc_id for r in simhash.keep_one(spark, spark.createDataFrame(rows + near, "doc_id long, text string"), "").collect()}
    assert kept == {d for d, _ in rows + near} - linked
