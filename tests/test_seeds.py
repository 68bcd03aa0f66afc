"""Hits by the seed join against those of the kernel that looks everywhere."""

import random

import pytest

from strandmill import settings
from strandmill.operators import annotate, matching, seeds


def reads_of(spark, texts):
    rows = [(i, f"r{i}", t, None if t is None else "I" * len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "read_index long, read_id string, sequence string, quality string")


def anchor(name, motif, **kw):
    return settings.Anchor(name=name, type="fixed", sequence=motif, **kw)


def texts(rng):
    bases = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    near = ["ACGTTGCAGT", "ACGTGCAGT", "ACGTTTGCAGT", "ACCTTGCAGT", "TTGACCA", "acgttgcagt", "ACGTTGCAGTACGTTGCAGT"]
    some = ["".join(x if rng.random() < 0.5 else matching.reverse_complement(x) for x in (bases(rng.randrange(30)), rng.choice(near), bases(rng.randrange(30)), rng.choice(near), "NXé"[: rng.randrange(4)])) for _ in range(120)]
    return [None, "", "A", "ACGTTGCAG", "ACGTTGCAGT", "éACGTTGCAGTé", "A" * 30, "ACGTTGCAGT" * 6, *some]


@pytest.mark.parametrize("anchors", [
    [anchor("a", "ACGTTGCAGT")], [anchor("a", "ACGTTGCAGT", max_mismatches=2), anchor("it's", "TTGACCA", max_mismatches=1)], [anchor("a", "AC", max_mismatches=3)],
    [anchor("a", "ACGTTGCAGT", max_mismatches=1, search_region="5p", search_window_bp=25), anchor("b", "TTGACCA", search_region="3p", search_window_bp=18)],
    [anchor("a", "ACGTTGCAGT", max_edits=2)], [anchor("a", "acgttgcagt", max_edits=1, search_region="3p", search_window_bp=30), anchor("b", "TTGACCA", max_edits=0), anchor("c", "GATTACAGATTACAGATTACA", max_mismatches=0)],
])
def test_seeds_find_what_the_kernel_does(spark, anchors):
    some = texts(random.Random(len(anchors)))
    got = seeds.with_hits(reads_of(spark, some), anchors).collect()
    assert len(got) == len(some)
    probes = matching.compile_anchors(anchors)
    for r in got:
        t = r.sequence or ""
        for strand, found in ((t, r._forward), (matching.reverse_complement(t), r._reverse)):
            want = matching.find_hits(strand, probes)
            if not strand.isascii():
                want = [(*h[:8], h[8].encode("ascii", "replace").decode()) for h in want]
            assert sorted(map(tuple, found)) == sorted(want), (strand, anchors)


def test_annotated_alike(spark):
    s = settings.from_dict({"anchors": [{"name": n, "type": "fixed", "sequence": m, "max_edits": 1} for n, m in (("l", "ACGTTGCAGT"), ("r", "TTGACCA"))], "structure": {"expected_order": ["l", "r"], "segments": [{"name": "s", "start_anchor": "l", "end_anchor": "r"}]}})
    reads = reads_of(spark, [t for t in texts(random.Random(7)) if t is None or t.isascii()])
    names = ["read_index", "label", "is_reversed", "detected", "hits", "segments", "bucket"]
    rows = lambda df: sorted(map(tuple, df.select(*names).collect()))
    assert rows(seeds.annotate(reads, s)) == rows(annotate.annotate(reads, s))


def test_expressions_are_refused(spark):
    with pytest.raises(ValueError, match="fixed anchors"):
        seeds.annotate(reads_of(spark, ["A"]), settings.from_dict({"anchors": [{"name": "x", "type": "regex", "pattern": "A+"}]}))
