"""Substring dedup against brute force: the index, its statistics, odd tables, anchors with very many regions."""

import collections
import random

import numpy as np
import pytest

from strandmill.llm import substring_dedup as sd

KIND = "doc_id long, text string, _row string, _anchor int, _id string, _text int"


def brute(texts, window):
    bags = [(t or "").encode().split() for t in texts]
    count = collections.Counter(tuple(w[i : i + window]) for w in bags for i in range(len(w) - window + 1))
    out = []
    for w in bags:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((w, sorted(gone)))
    return out


def found(spark, docs, window):
    rows = sd.find_repeated_words(spark.createDataFrame([(*r, "r", 1, "i", 2) for r in docs], KIND), window=window).collect()
    out = []
    for r in rows:
        out.append((r.doc_id, bytes(r._text).split(), [i for s in r._spans for i in range(s.start, s.end)]))
        assert all(a.end < b.start for a, b in zip(r._spans, r._spans[1:]))
    return sorted(out, key=repr)


def wanted(docs, window):
    return sorted([(i, w, g) for (i, _), (w, g) in zip(docs, brute([t for _, t in docs], window))], key=repr)


@pytest.mark.parametrize("kinds", [1, 2, 5, 50])
def test_matching_statistics_are_brute_force(kinds):
    rng = np.random.default_rng(kinds)
    for _ in range(8):
        sizes = rng.integers(1, 40, rng.integers(1, 12))
        copies = rng.choice([1, 1, 2], len(sizes))
        words = rng.integers(0, kinds, sizes.sum()).astype(np.uint64)
        texts = np.split(words, np.cumsum(sizes)[:-1])
        texts = [tuple(t.tolist()) for t in texts]
        unique = dict(zip(texts, copies.tolist()))  # texts that meet are different ones
        sizes, copies = np.array([len(t) for t in unique]), np.array(list(unique.values()))
        got = sd.matching_statistics(np.array([w for t in unique for w in t], np.uint64), sizes, copies).tolist()
        count = collections.Counter()
        for t, n in unique.items():
            for i in range(len(t)):
                for j in range(i + 1, len(t) + 1):
                    count[t[i:j]] += n
        want = [max((j - i for j in range(i + 1, len(t) + 1) if count[t[i:j]] > 1), default=0) for t in unique for i in range(len(t))]
        assert got == want


def test_wavelets_count():
    rng = np.random.default_rng(3)
    for kinds, n in ((1, 5), (2, 64), (7, 200), (300, 1000)):
        s = rng.integers(0, kinds, n)
        w = sd._Wavelets(s, kinds)
        place, symbol = rng.integers(0, n + 1, 300), rng.integers(0, kinds, 300)
        assert w.rank(place, symbol).tolist() == [int((s[:p] == c).sum()) for p, c in zip(place, symbol)]


def test_words_are_those_between_white_space():
    texts = ["a b", "", "  é\tü\x0b\x0cx\r\n", "\x1c\x85\xa0 b", "a"]
    h, count = sd.word_hashes([t.encode() for t in texts])
    assert count.tolist() == [len(t.encode().split()) for t in texts]
    words = [w for t in texts for w in t.encode().split()]
    assert [h[i] == h[j] for i in range(len(words)) for j in range(len(words))] == [a == b for a in words for b in words]


def corpus(rng):
    text = lambda n, kinds=1000: " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))
    passage, doc = text(60), text(120)
    docs = [(i, f"{text(rng.randrange(50))} {passage} {text(rng.randrange(50))}") for i in range(12)]
    docs += [(20, doc), (21, doc), (22, doc.replace("w", "W")), (23, doc + " end"), (24, None), (25, ""), (26, " \t "), (27, "one"), (None, None), (None, doc)]
    docs += [(28, text(40) + "\n" + passage[: len(passage) // 2]), (29, "same " * 90), (30, "a b " * 60), (31, text(30000, 10**6) + " " + passage)]
    return [*docs, docs[0], docs[13]]


@pytest.mark.parametrize("window", [35, 12, 1])
def test_dedup_is_brute_force(spark, window):
    docs = corpus(random.Random(12))
    assert found(spark, docs, window) == wanted(docs, window)


def test_anchors_with_many_regions(spark, monkeypatch):
    monkeypatch.setattr(sd, "MOST_REGIONS", 3)
    docs = corpus(random.Random(13))
    assert found(spark, docs, 35) == wanted(docs, 35)
    monkeypatch.setattr(sd, "MOST_REGIONS", 0)
    assert found(spark, docs, 12) == wanted(docs, 12)


def test_an_empty_table(spark):
    assert found(spark, [], 35) == []
