"""Cases that a shorter way of doing a query's job would miss."""

import collections
import hashlib

from strandmill.plans import registry


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_whitelist_is_of_all_suppliers(spark, tmp_path):
    keys = [*range(61), *range(150, 900)]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(400).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    code = lambda k: hashlib.md5(f"w:{k}".encode()).hexdigest().translate(str.maketrans("0123456789abcdef", "ACGT" * 4))[:8]
    entries = sorted({code(k) for k in keys})
    assert sorted(r.barcode for r in registry.whitelist(spark, str(tmp_path)).collect()) == entries
    seen = collections.Counter()
    for r in registry.barcode_status(spark, str(tmp_path)).collect():
        if r.raw_barcode is None or r.min_barcode_q < 15:
            continue
        (d1, near), (d2, _) = sorted((edits(r.raw_barcode, e), e) for e in entries)[:2]
        if d1 == 0:
            want = ("exact", 0, None, near)
        elif d1 > 1:
            want = ("unrecoverable", d1 if d1 == 2 else None, None, None)
        else:
            want = ("ambiguous" if d2 == 1 else "uniquely_recoverable", 1, d2 if d2 <= 2 else None, near)
        assert (r.barcode_status, r.nearest_distance, r.second_distance, r.nearest_barcode) == want
        seen[r.barcode_status] += 1
    assert set(seen) >= {"exact", "unrecoverable", "uniquely_recoverable"}
    counts = {r.barcode_status: r["count"] for r in registry.barcode_counts(spark, str(tmp_path)).collect()}
    assert all(counts[s] == n for s, n in seen.items())


def test_edit_distances_of_both_strands(spark, tmp_path):
    # reads with hits on both strands, of which one has more or nearer ones
    ids = [*range(48), 2584, 4419, 4579, 8204, 42119]
    spark.createDataFrame([(i,) for i in ids], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    turned = lambda s: s.translate(str.maketrans("ACGTN", "TGCAN"))[::-1]
    want = set()
    for r in registry.reads(spark, str(tmp_path)).collect():
        for rev, s in ((False, r.sequence.upper()), (True, turned(r.sequence.upper()))):
            for name, motif in (("left", registry.LEFT), ("right", registry.RIGHT)):
                least = min((edits(s[i : i + k], motif) for i in range(len(s)) for k in (15, 16, 17)), default=9)
                if least <= 1:
                    want.add((r.read_index, rev, name, least))
    assert any((i, not rev) in {x[:2] for x in want} for i, rev, *_ in want)
    got = [(r.read_index, r.is_reversed, r.anchor, r.distance) for r in registry.edit_distances(spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want)
