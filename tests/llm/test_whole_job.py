"""Cases that a shorter way of doing an operator's job would miss."""

import random
import re

import numpy as np
import pytest

from strandmill.llm import line_dedup, simhash, spm_codec, topk


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# ---------------------------------------------------------------- pipeline, near copies


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_kept(rows, least=0.8):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if not union or len(sets[i] & sets[j]) >= least * union:
                root[find(i)] = find(j)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        smallest[find(i)] = min(d, smallest.get(find(i), d))
    return sorted(smallest.values())


def test_near_copies_of_similarity_0_8(spark):
    rng = random.Random(31)
    passage, rows = words(rng, 30), [(1, ""), (2, None), (3, " \n"), (4, "one two"), (5, "One  two"), (6, "one two three")]
    for i in range(40):
        w = words(rng, rng.choice([12, 40, 120, 300])).split()
        rows.append((100 + 10 * i, " ".join(w)))
        for j in range(1, rng.choice([2, 3, 5])):
            changed = list(w)
            for _ in range(rng.randrange(1, max(2, len(w) // 25))):
                changed[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
            rows.append((100 + 10 * i + j, " ".join(changed)))
    rows += [(1000 + i, passage + " " + words(rng, 40)) for i in range(20)]
    big = words(rng, 200).split()
    rows += [(2000 + i, " ".join([*big[:i], "y", *big[i + 1 :]])) for i in range(30)]
    docs = spark.createDataFrame([*rows, (None, rows[8][1])], "doc_id long, text string")
    kept = [r.doc_id for r in simhash.keep_one(spark, docs, "").collect()]
    assert None in kept
    assert sorted(d for d in kept if d is not None) == brute_kept(rows)
    near = [rows[8], (rows[8][0] + 5, rows[8][1])]
    assert len(brute_kept(near)) == 1


# ---------------------------------------------------------------- 8, short lines


def brute_gone(rows):
    """(document, line number) of lines with words that an earlier one is similar to, of however few words."""
    lines = []
    for d, t in rows:
        for no, line in enumerate(t.split("\n")):
            w = {x for x in re.split(r"[\x20\x09-\x0D]+", line) if x}
            if w:
                lines.append((d, no, w))
    return {a[:2] for a in lines for b in lines if b[:2] < a[:2] and 9 * len(a[2] & b[2]) >= 4 * (len(a[2]) + len(b[2]))}


def test_short_lines_go(spark):
    rng = random.Random(32)
    rows = [(1, "All rights reserved.\n\t\n\nLes."), (2, "Les.\nall rights reserved.\n\t\n"), (3, "reserved.  rights All\nLes. Les.")]
    # four of five words are similar, three of four aren't
    rows += [(4, "p q r s"), (5, "p q r s t\np q r"), (6, "long " * 80), (7, "long"), (8, "t s r q p")]
    rows += [(10 + i, "\n".join(" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 7))) for _ in range(6))) for i in range(40)]
    got = {(r._doc, r._no) for r in line_dedup.similar_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_gone(rows)
    assert got == want
    assert {(2, 0), (3, 0), (3, 1), (5, 0), (7, 0)} <= want and (5, 1) not in want and (2, 2) not in want


# ---------------------------------------------------------------- 10, large components


@pytest.mark.parametrize("cell", [65_536, 100])
def test_large_vectors_take_part(spark, monkeypatch, cell):
    monkeypatch.setattr(topk, "ROWS_A_CELL", cell)
    rng = np.random.default_rng(33)
    sizes = [1, 3e4, 16384.5, 1e6, 1e12, 1e30, 3e38]
    rows = [(i, [float(np.float32(x)) for x in rng.uniform(-1, 1, 9) * sizes[i % 7 if i % 4 else 0]]) for i in range(300)]
    rows += [(i, [float(np.float32(x)) for x in rng.uniform(-1, 1, 4) * sizes[i % 4]]) for i in range(300, 420)]
    rows[8], rows[9] = (8, rows[50][1]), (9, rows[50][1])
    ints = [(i, [int(np.floor(np.float64(x) * 256)) for x in v]) for i, v in rows]
    want = set()
    for q, a in ints:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in ints if c != q and len(a) == len(b))[:5]
            want |= {(q, n + 1, c, -s if abs(s) < 1 << 63 else None) for n, (s, c) in enumerate(best)}
    got = topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert {tuple(r) for r in got.collect()} == want
    assert any(s is None for *_, s in want) and any(s is not None for *_, s in want)


def test_score_keys_sort_as_scores():
    scores = [s * (1 << n) + d for n in (0, 7, 8, 62, 63, 64, 300) for s in (-1, 1) for d in (-1, 0, 1)]
    assert sorted(scores) == sorted(scores, key=topk.score_key)


# ---------------------------------------------------------------- 6, parity


def test_every_text_is_verified(spark, tmp_path):
    rows = [(i, f"text {i}, été") for i in range(40)] + [(40, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.parity for r in spm_codec.op6_sentencepiece(spark, str(tmp_path)).collect()}
    assert got.pop(40) is None and all(got.values())
