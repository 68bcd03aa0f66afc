"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import collections
import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandmill.llm import common, decontaminate, line_dedup, quality, sharding, simhash, spm_codec, suffix_dedup, topk, url_filter, warc

DOCS = "doc_id long, text string, _row string, _text int, _key string, node int, size string"


def frame(spark, rows, schema=DOCS):
    """Documents with columns named like some that the operators make inside."""
    return spark.createDataFrame([(i, t, "q", 1, "k", 2, "s") for i, t in rows], schema)


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# ---------------------------------------------------------------- 1


def brute_repeats(texts, window=200):
    count = collections.Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if count[t[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        out.append(bytes(gone))
    return out


def test_suffix_order():
    rng = random.Random(1)
    for n, alphabet, depth in itertools.product((0, 1, 2, 3, 4, 7, 50, 400), (1, 2, 4, 200), (3, 20, 200)):
        b = bytes(rng.randrange(alphabet) for _ in range(n))
        order = suffix_dedup.suffix_order(np.frombuffer(b, np.uint8), depth).tolist()
        assert sorted(order) == list(range(n))
        heads = [b[i : i + depth] for i in order]
        assert heads == sorted(heads)


@pytest.mark.parametrize("most", [1 << 14, 2])
def test_suffix_dedup_is_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_REGIONS", most)
    rng = random.Random(3)
    passages = [words(rng, 60) for _ in range(5)]
    rows = []
    for i in range(70):
        t = words(rng, rng.choice([0, 3, 40, 90]))
        if i % 2:
            p = rng.choice(passages)
            t = t[: len(t) // 2] + p[rng.randrange(40) :][: rng.choice([150, 199, 200, 201, 290])] + t[len(t) // 2 :]
        rows.append((i if i % 30 else None, t))
    rows += [(100, "ab " * 300), (101, "é" * 150), (102, None), (103, ""), (104, "x" * 199), (105, "y" * 200), (106, "z" * 201), *rows[:4], *rows[:4]]
    got = suffix_dedup.find_repeats(frame(spark, rows)).collect()
    texts = [(t or "").encode() for _, t in rows]
    want = collections.Counter()
    for (i, _), t, gone in zip(rows, texts, brute_repeats(texts)):
        edge = np.diff(np.concatenate([[0], np.frombuffer(gone, np.int8) if gone else np.zeros(0, np.int8), [0]]))
        want[i, t, tuple(zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist()))] += 1
    assert collections.Counter((r.doc_id, bytes(r._text), tuple((s.start, s.end) for s in r._spans)) for r in got) == want


# ---------------------------------------------------------------- 2


def test_urls(spark):
    urls = ["HTTP://A.Example.NET/en/x?y", "http://example.net/EN/", "http://badexample.net/en/", "x://net/", "x://net", "http://m.example.com/de/1", "https://a.org/fr/é😀#f", "no scheme", "", None, "http://cheap-pills.com/" + "a" * 5000, "://", "a://b?c://d/net/", "http://ex%6D.ORG\n/fr/", "http://cheap-pills.com/en/7"]
    rows = [(i, u, "h", "r") for i, u in enumerate(urls)]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string, rule string")).collect()}
    for i, u, *_ in rows:
        assert (got[i].host, got[i].path) == url_filter.split_url(u), u
    assert [(got[i].rule, got[i].verdict) for i in (0, 1, 2, 3, 5, 6)] == [("example.net/en/", "allow"), ("net/", "block"), ("net/", "block"), ("net/", "block"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    assert got[4].rule is None and got[7].host == got[9].path == "" and got[14].verdict == "block" and got[9].verdict == "allow"


def test_url_model_tells_hosts_it_has_not_seen():
    bias, weights = url_filter.fit_weights()
    def odds(url):
        h, p = url_filter.split_url(url)
        g = url_filter._grams(h, url_filter.HOST_SALT) + url_filter._grams(p, url_filter.PATH_SALT)
        return bias + sum(weights[k] for k in g) / max(1, len(g))
    assert odds("http://casino-bonus.example.com/en/5") > 0 > odds("https://gardens.example.org/de/12.html")


# ---------------------------------------------------------------- 3


def test_warc_round_trip(spark, tmp_path):
    big = "p" * 1000
    rows = [(1, "http://a/é", big, "q"), (5, "http://b", big, "q"), (3, None, big, "q"), (2, "x\r\ny", "small", "q"), (4, "u", "small", "q"), (7, "u", None, "q"), (None, "n", big, "q"), (8, "long", "ü" * 300_000, "q"), (8, "long", "ü" * 300_000, "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    index = warc.write_archives(pages, f"file://{tmp_path}/w")
    got = warc.read_records(index).collect()
    assert len(got) == len(rows) == index.count()
    kinds = collections.Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert kinds == {(1, "revisit", 5, 1000): 1, (3, "revisit", 5, 1000): 1, (None, "revisit", 5, 1000): 1, (5, "response", None, 1000): 1, (2, "response", None, 5): 1, (4, "response", None, 5): 1, (7, "response", None, 0): 1, (8, "response", None, 600_000): 2}
    for r in got:
        if r.record_type == "response":
            assert hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest
    one = warc.read_records(index.where("url = 'http://a/é'")).collect()
    assert [r.page_id for r in one] == [1] and one[0].url == "http://a/é"
    damaged = bytearray(warc.encode_record(1, "u", b"abc", hashlib.sha1(b"abd").digest(), "response", None))
    with pytest.raises(ValueError):
        warc.decode_record(bytes(damaged))
    assert warc.read_records(warc.write_archives(pages.limit(0))).count() == 0


# ---------------------------------------------------------------- 4


def plain_fingerprint(text, k):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_and_spark_hash(spark):
    rng = random.Random(4)
    for t in [None, "", " \t\x0b", "A b", "É a B c d", "a b c d", words(rng, 200), "a " * 50]:
        assert simhash.fingerprint(t) == plain_fingerprint(t, 4)
    assert simhash.fingerprint("one two") == spark.range(1).select(F.xxhash64(F.lit("one two"))).first()[0] % (1 << 64)


@pytest.mark.parametrize("most", [8192, 0])
def test_components_are_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST_IN_BUCKET", most)  # 0: every bucket is split
    rng = random.Random(6)
    base = [words(rng, 150) for _ in range(12)]
    rows = []
    for i in range(120):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 1, 3, 6])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        rows.append((rng.randrange(10**6), " ".join(w)))
    rows += [(7_000_000 + i, t) for i, t in enumerate(["", None, "\n", "a", "a"])] + [(None, "lone words here now indeed"), rows[0]]
    got = simhash.components(frame(spark, rows)).collect()
    prints = [plain_fingerprint(t, 4) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    want = collections.Counter((d, f"{prints[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows))
    assert collections.Counter(tuple(r) for r in got) == want
    assert simhash.components(frame(spark, [(1, "x")]).limit(0)).count() == 0


def test_pigeonring_loses_no_pair():
    rng = np.random.default_rng(8)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 6), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    found = set()
    for k in range(len(simhash.SEGMENTS)):
        for i in range(len(a)):
            if simhash._segment(a[i : i + 1], k) == simhash._segment(b[i : i + 1], k) and len(simhash.pairs_within(a[i : i + 1], b[i : i + 1], k)[0]):
                found.add(i)
    assert found == {i for i in range(len(a)) if int(a[i] ^ b[i]).bit_count() <= 4}


def test_long_chain_of_links(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(5, 5), (1000, 1001), (1001, 1000)], "u long, v long")
    got = dict(common.connected_components(spark.createDataFrame([(i,) for i in [*range(n), 1000, 1001, 2000]], "node long"), edges).collect())
    assert set(got[i] for i in range(n)) == {0} and got[1001] == got[1000] == 1000 and got[2000] == 2000


# ---------------------------------------------------------------- 5


@pytest.mark.parametrize("overfull", [2, 0])
def test_shards(spark, monkeypatch, overfull):
    monkeypatch.setattr(sharding, "OVERFULL", overfull)  # 0: every range of two rows is subdivided
    monkeypatch.setattr(sharding, "LEAST_RANGES", 4 if not overfull else 64)
    rng = random.Random(5)
    rows = [(i, words(rng, rng.randrange(0, 60))) for i in range(400)] + [(1000 + i, "the same text again " * 9) for i in range(200)] + [(2000, None), (2001, ""), (None, "null id"), (None, "null id"), (3, words(rng, 3))]
    docs = frame(spark, rows)
    got = sharding.shard_by_bytes(docs).collect()
    assert len(got) == len(rows)
    total = sum(r.size for r in got)
    for k in range(8):
        part = [r for r in got if r.shard == k]
        assert sorted(r.slot for r in part) == list(range(len(part)))
        assert abs(sum(r.size for r in part) - total / 8) <= 2 * max(r.size for r in got)
    for r in got:
        if r.doc_id in (2000, 2001):
            assert (r.size, r.text_crc32) == (1, 0)
    again = sharding.shard_by_bytes(docs.repartition(7)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))
    assert sharding.shard_by_bytes(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- 6


def test_sentencepiece_parity(spark):
    rng = random.Random(2)
    texts = ["", " ", "  a  b", "\n\n a", "<s> <0x0A>", "aaaaaaaaaaaa bababababab", "日本語😀é́\x00", "x" * 3000, " " * 40 + "b", "a\tb\r\n", None, words(rng, 3000)]
    rows = list(enumerate(texts))
    out = {r.doc_id: r for r in spm_codec.encode_documents(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, parity int"), parity_one_in=1).collect()}
    for i, t in rows:
        r = out[i]
        assert (r.token_ids is None) == (t is None)
        assert t is None or (r.parity and r.round_trip), t
    back = {r.doc_id: r.decoded for r in spm_codec.decode_documents(spark.createDataFrame(list(out.values())).select("doc_id", "token_ids")).collect()}
    assert back == dict(rows)
    assert spm_codec.encode_documents(frame(spark, [(1, "x")]).limit(0)).count() == 0


def test_unigram_model_and_normaliser_flags():
    def field(number, kind, payload):
        key = bytes([number << 3 | kind]) if number < 16 else bytes([(number << 3 | kind) & 127 | 128, number >> 4])
        return key + (bytes([len(payload)]) + payload if kind == 2 else payload)
    import struct

    def piece(text, score, kind):
        return field(1, 2, field(1, 2, text.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind])))
    data = piece("<unk>", 0, 2) + piece("▁a", -1, 1) + piece("b", -2, 1) + piece("▁ab", -2.5, 1) + field(2, 2, field(3, 0, b"\1") + field(40, 0, b"\0")) + field(3, 2, field(3, 0, b"\1") + field(4, 0, b"\0"))
    m = spm_codec.parse_model(data)
    assert (m.model_type, m.unk_id, m.add_dummy_prefix, m.remove_extra_whitespaces, len(m.pieces)) == (1, 0, True, False, 4)
    assert spm_codec.build_tokenizer(m).encode("ab").ids == [3]


# ---------------------------------------------------------------- 7


def test_quality_on_held_out_rows(spark):
    rng = random.Random(7)
    rows, marks = [], []
    for i in range(400):
        good = i % 4 != 0
        t = words(rng, rng.randrange(5, 80))
        rows.append((i, t if good else rng.choice([t.upper().replace(" ", "!! "), t.replace(" ", "### "), "spam " * 60])))
        marks.append((i, int(good), 0))
    labels = spark.createDataFrame(marks + [(9999, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, [*rows, (500, None), (501, ""), (None, "null id")])
    model = quality.fit_quality(docs, labels)
    ids = {r.doc_id for r in docs.select("doc_id").where(~quality.held_out()).collect()}
    assert len(model.labels) <= len(ids)
    got = [r for r in quality.score_documents(docs, model).withColumn("held", quality.held_out()).collect()]
    held = [r for r in got if r.held and r.doc_id is not None and r.doc_id < 400]
    assert np.mean([(r.score >= 0.7) == (r.doc_id % 4 != 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(rows) + 3
    blank = [r.score for r in got if r.doc_id in (500, 501)]
    assert blank[0] == blank[1]
    none = quality.fit_quality(docs, labels.limit(0))
    assert quality.score_documents(docs.limit(3), none).first().score == 0.5
    small = quality.fit_quality(docs, labels, most=20)
    assert len(small.labels) == 20


# ---------------------------------------------------------------- 8


def brute_lines(rows, least=1):
    lines = []
    for d, t in rows:
        for no, line in enumerate((t or "").split("\n")):
            w = {x for x in __import__("re").split(r"[\x20\x09-\x0D]+", line) if x}
            if len(w) >= least:
                lines.append(((d is not None, d or 0, no), d, no, w))
    gone = set()
    for a in lines:
        for b in lines:
            if b[0] < a[0] and 9 * len(a[3] & b[3]) >= 4 * (len(a[3]) + len(b[3])):
                gone.add((a[1], a[2]))
    return gone


def test_lines_are_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    base = [words(rng, rng.choice([5, 6, 9, 20, 45, 150]), 300) for _ in range(25)]
    rows = []
    for i in range(60):
        out = []
        for _ in range(rng.randrange(0, 5)):
            w = rng.choice(base).split()
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
            out.append(rng.choice([" ", "\t "]).join(w))
        rows.append((i - 20, "\n".join(out)))
    rows += [(100, None), (101, ""), (102, "a b\nshort"), (103, "\n\n"), (None, base[0]), (9, rows[29][1])]
    got = line_dedup.similar_lines(frame(spark, rows))
    assert {(r._doc, r._no) for r in got.collect()} == brute_lines(rows)
    gone = brute_lines(rows)
    want = {(d, None if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if (d, no) not in gone)) for d, t in rows}
    for bound, hot in ((32 << 20, 1 << 16), (0, 1 << 16), (0, 3)):
        monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", bound)
        monkeypatch.setattr(line_dedup, "HOT_WORD", hot)
        assert {(r.doc_id, r.text) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()} == want
    assert want == {(d, None if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if (d, no) not in gone)) for d, t in rows}
    assert line_dedup.dedup_lines(frame(spark, rows)).columns == frame(spark, rows).columns
    assert line_dedup.dedup_lines(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("hot", [1 << 16, 2])
def test_large_group_of_near_copies(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT_WORD", hot)  # words of more occurrences have several slots
    rng = random.Random(9)
    line = words(rng, 60).split()
    rows = []
    for i in range(150):
        w = list(line)
        w[rng.randrange(60)] = f"y{i}"
        rows.append((i, " ".join(w)))
    assert {(r._doc, r._no) for r in line_dedup.similar_lines(frame(spark, rows)).collect()} == {(i, 0) for i in range(1, 150)}


def test_lines_whose_neighbour_fails_meet_the_others(spark, monkeypatch):
    """A test so loose that neighbours are chosen that aren't similar: their lines must still find those that are."""
    monkeypatch.setattr(line_dedup, "_near", lambda x, y, num, den: line_dedup._both(x, y) >= 0)
    rng = random.Random(10)
    base = [words(rng, 30, 60) for _ in range(12)]
    rows = [(i, "\n".join(" ".join({**dict(enumerate(b.split())), rng.randrange(30): f"z{i}"}.values()) for b in rng.sample(base, 3))) for i in range(40)]
    assert {(r._doc, r._no) for r in line_dedup.similar_lines(frame(spark, rows)).collect()} == brute_lines(rows)


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c\nd", 1, 2, "x", "y"), (2, "a b c", 3, 4, "x", None)], "doc_id long, text string, _doc int, _gone int, _row string, _text string")
    got = line_dedup.dedup_lines(docs)
    assert got.columns == docs.columns
    assert {tuple(r) for r in got.collect()} == {(1, "a b c\nd", 1, 2, "x", "y"), (2, "", 3, 4, "x", None)}


# ---------------------------------------------------------------- 9


def test_masks_miss_no_short_item():
    for n in range(decontaminate.SHORT, decontaminate.WINDOW):
        for a in range(n):
            assert any(a not in {s + k for k, c in enumerate(m) if c == "1"} for m in decontaminate.MASKS for s in range(n - len(m) + 1)), (n, a)


def test_masks_miss_no_window():
    for a, b in itertools.combinations(range(decontaminate.WINDOW), 2):
        differ = {a, b}
        assert any(
            not differ & {s + k for k, c in enumerate(m) if c == "1"} for m in decontaminate.MASKS for s in range(decontaminate.WINDOW - len(m) + 1)
        ), (a, b)


@pytest.mark.parametrize("block", [4 << 20, 300])
def test_overlaps(spark, block):
    rng = random.Random(10)
    items = [(k, words(rng, n)) for k, n in enumerate([13, 30, 60, 8, 5, 4, 20, 1, 12, 7, 2])] + [(90, None), (91, ""), (None, words(rng, 15))]
    docs, want = [], set()
    for i in range(80):
        t = words(rng, rng.randrange(0, 40)).split()
        k, item = items[i % 11]
        w = item.split()
        wrong = rng.sample(range(len(w)), min(len(w), rng.choice([0, 1, 2, 3])))
        at = rng.randrange(len(t) + 1)
        planted = [x if j not in wrong else "zz" for j, x in enumerate(w)]
        docs.append((i, " ".join(t[:at] + planted + t[at:]).replace(" ", ", ").upper()))
    docs += [(500, None), (501, ""), (None, items[1][1]), (0, docs[0][1])]
    for d, t in docs:
        dw = [x.strip(",").lower() for x in (t or "").split()]
        for k, item in items:
            w = (item or "").split()
            if not w:
                continue
            span, need = (13, 11) if len(w) >= 13 else (len(w), len(w) - (len(w) >= 8))
            for shift in range(-len(w), len(dw)):
                same = [0 <= shift + j < len(dw) and dw[shift + j] == w[j] for j in range(len(w))]
                if any(sum(same[s : s + span]) >= need for s in range(len(w) - span + 1)):
                    want.add((d, k))
    got = decontaminate.find_overlaps(frame(spark, docs), spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, _seed int"), block_bytes=block)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert decontaminate.find_overlaps(frame(spark, docs), spark.createDataFrame([], "item_id long, text string")).count() == 0


# ---------------------------------------------------------------- 10


def test_top_products_are_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(600):
        v = rng.normal(size=16) * rng.choice([0.05, 1, 3])
        rows.append((i, [float(np.float32(x)) for x in v], "s"))
    rows[7] = (7, rows[100][1], "s")
    rows += [(1000, None, "s"), (1050, [float("nan")] * 16, "s"), (1100, [None] + [0.1] * 15, "s"), (1150, [float("inf")] * 16, "s"), (1200, [0.0] * 16, "s"), (None, [1.0] * 16, "s"), (1250, [1.0] * 3, "s"), (1300, [], "s")]
    frame_ = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    fine = [(i, np.floor(256 * np.array(np.float32(v), np.float64)).astype(int)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, a in fine:
        if q % 50 == 0:
            best = sorted((-int(a @ b), c) for c, b in fine if c != q and len(a) == len(b))[:5]
            want |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(best)}
    for cell, block in ((65_536, 1 << 20), (100, 700)):
        monkeypatch.setattr(topk, "ROWS_A_CELL", cell)
        monkeypatch.setattr(topk, "BLOCK_BYTES", block)
        assert {tuple(r) for r in topk.top_products(frame_).collect()} == want
    assert topk.top_products(frame_.limit(0)).count() == 0


def test_norm_buckets_prune(monkeypatch):
    monkeypatch.setattr(topk, "BUCKET", 50)
    rng = np.random.default_rng(12)
    v = np.floor(rng.normal(size=(2000, 8)) * np.exp(rng.normal(size=(2000, 1)) * 1.5) * 50)
    ids = np.arange(2000)
    stats = {}
    got = topk.top_in_cell(ids[:20], v[:20], ids, v, 5, stats)
    want = [(int(q), int(c), int(s)) for q in ids[:20] for s, c in [(-s, c) for s, c in sorted((-(v[q] @ v[c]), c) for c in ids if c != q)[:5]]]
    assert got == want and stats["verified"] < 20 * 2000 / 2
