"""The work of substring dedup: each text is cut once, and results don't depend on how regions come in batches and shards."""

import glob
import random
import uuid

import numpy as np
import pyarrow as pa
import pytest

from strandmill.llm import substring_dedup as sd

from .test_substring_dedup import corpus, found, wanted


def test_texts_are_cut_once(spark, monkeypatch, tmp_path):
    # anchors with over three regions have them split: both kinds of rows come from one pass over the texts
    cut = sd._cut_regions

    def counted(window):
        inner = cut(window)

        def run(batches):
            def seen():
                for b in batches:
                    (tmp_path / uuid.uuid4().hex).write_text(str(b.num_rows))
                    yield b

            return inner(seen())

        return run

    monkeypatch.setattr(sd, "MOST_REGIONS", 3)
    monkeypatch.setattr(sd, "_cut_regions", counted)
    docs = corpus(random.Random(14))
    assert found(spark, docs, 35) == wanted(docs, 35)
    rows = sum(int(open(p).read()) for p in glob.glob(f"{tmp_path}/*"))
    assert 0 < rows <= len(docs)


def regions(rng):
    """(group, anchor, region, copies, start, words) of anchors' regions and of windows, sorted as the tasks get them."""
    rows, ident = [], 0
    for anchor in range(40):
        base = rng.integers(0, 50, 62).astype(np.uint64)
        for _ in range(rng.integers(1, 4)):
            lo = rng.integers(0, 20)
            rows.append((anchor * 3, anchor * 3, ident, int(rng.integers(1, 3)), 0, base[lo : lo + 35 + rng.integers(0, 8)].tobytes()))
            ident += 1
    for group in range(60):
        for anchor in sorted(rng.integers(200, 203, rng.integers(1, 5)).tolist()):
            rows.append((group * 2, anchor, ident, int(rng.choice([1, 1, 2])), int(rng.integers(0, 9)), None))
            ident += 1
    return sorted(rows, key=lambda r: r[:2])


def matched(rows, size):
    kinds = [pa.int64()] * 4 + [pa.int32(), pa.binary()]
    names = [c.split()[0] for c in sd._CUT.split(", ")]
    batches = (pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[at : at + size]], t) for k, t in enumerate(kinds)], names) for at in range(0, len(rows), size))
    return sorted(tuple(r.values()) for b in sd._match_regions(35)(batches) for r in b.to_pylist())


@pytest.mark.parametrize("size, shard", [(1, 1), (3, 100), (7, 1 << 17), (1000, 1), (1000, 300)])
def test_batches_and_shards_change_nothing(monkeypatch, size, shard):
    rows = regions(np.random.default_rng(size))
    whole = matched(rows, len(rows))
    single = [r for r in rows if r[5] is None]
    twice = {k for k in {r[:2] for r in single} if sum(r[3] for r in single if r[:2] == k) > 1}
    assert [r for r in whole if r[0] >= 200] == sorted((r[1], r[2], r[4], r[4] + 1) for r in single if r[:2] in twice)
    assert any(r[0] < 200 for r in whole)
    monkeypatch.setattr(sd, "SHARD_WORDS", shard)
    assert matched(rows, size) == whole


def test_suffixes_are_in_order():
    rng = np.random.default_rng(5)
    for kinds, n in ((1, 40), (2, 200), (30, 500)):
        s = np.append(rng.integers(0, kinds, n) + 1, 0)
        order, by = sd._suffixes(s)
        text = s.tolist()
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        for j, names in enumerate(by):
            heads = [tuple(text[i : i + (1 << j)]) for i in range(len(text))]
            assert len(set(zip(heads, names.tolist()))) == len(set(heads)) == len(set(names.tolist()))


def test_words_of_any_length():
    words = [("ab" * 90)[: n + 1] for n in range(150)] + ["b" * n for n in (7, 8, 9, 64, 65, 72)] + ["\x00", "\x00" * 8, "\x00" * 9, "a\x00"]
    rng = random.Random(6)
    seen = [*words, *rng.sample(words, len(words))]
    h, count = sd.word_hashes([" \t".join(seen[:100]).encode(), b"", "\n".join(seen[100:]).encode() + b" "])
    assert count.tolist() == [100, 0, len(seen) - 100]
    assert len(set(h.tolist())) == len(set(words)) == len(set(zip(h.tolist(), seen)))
    h, count = sd.word_hashes([])
    assert len(h) == len(count) == 0


def test_long_texts_are_cut_alone():
    sizes = [10, sd.CHUNK, 1, sd.CHUNK * 2, 5, sd.CHUNK - 5, 1, 0]
    batch = pa.RecordBatch.from_arrays([pa.array([b"x" * n for n in sizes])], ["_text"])
    parts = [[len(t) for t in p.column("_text").to_pylist()] for p in sd._by_bytes(batch)]
    assert parts == [[10], [sd.CHUNK], [1], [sd.CHUNK * 2], [5, sd.CHUNK - 5], [1, 0]]
