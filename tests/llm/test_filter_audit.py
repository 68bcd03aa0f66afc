"""The filter audit against a plain replay, with odd tables."""

import functools
import itertools
import random
import re

from strandmill.llm import filter_audit
from strandmill.llm.filter_audit import COUNTS

KIND = "doc_id long, text string, source string, part string, failures string, _id int, good int, bits string"


@functools.cache
def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
    }


def replayed(docs, labels):
    """{(part, order, step): counts} of documents (id, text, source)."""
    docs = [(i, t or "", s or "") for i, t, s in docs]
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    out, shapley = {}, {}
    for part in {s for _, _, s in docs}:
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                n = dict.fromkeys(COUNTS, 0)
                for i, t, s in docs:
                    if s != part:
                        continue
                    x = fails(t) | {"E": i is not None and i > least[t]}
                    before = any(x[g] for g in order[: step - 1])
                    gone = x[f] and not before
                    n["kept"] += not before and not x[f]
                    n["removed"] += gone
                    n["redundant"] += x[f] and before
                    n["unique_fails"] += x[f] and sum(x.values()) == 1
                    n["good_lost"] += gone and (i, "q", 1) in labels
                    n["toxic_lost"] += gone and (i, "t", 1) in labels
                shapley[part, f] = shapley.get((part, f), 0) + n["removed"]
                out[part, order, step] = n
    return {k: (*n.values(), shapley[k[0], k[1][k[2] - 1]]) for k, n in out.items()}


def audited(spark, docs, labels):
    d = spark.createDataFrame([(*r, "p", "f", 1, 2, "b") for r in docs], KIND)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    rows = filter_audit.audit(filter_audit.document_flags(d, lab)).collect()
    out = {(r.part, r.filter_order, r.step): tuple(r[c] for c in (*COUNTS, "shapley")) for r in rows}
    assert len(out) == len(rows)
    return out


def test_audit_is_a_replay(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = [None, "", " \t\n ", "é" * 10 + " A", "a b#", "\x1f\x1f x", " ".join(word() for _ in range(200)), " ".join(["same"] * 400), "WORDS " * 250]
    texts += [" ".join(word() for _ in range(rng.randrange(150, 260))) + rng.choice(["", "|", " ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEF" * 3]) for _ in range(12)]
    docs = [(rng.randrange(40), rng.choice(texts), rng.choice([None, "", "web", "books", "empty shelf"])) for _ in range(120)]
    docs += [(None, texts[6], "web"), (None, None, None), docs[0], docs[0], (99, " ".join(word() for _ in range(60000)), "long")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "x") for i in range(0, 40, 2)] + [(4, 1, 0, "x"), (4, 0, 1, "x"), (None, 1, 1, "x"), (500, 1, 1, "x")]
    said = {(i, "q", q) for i, q, _, _ in labels if i is not None} | {(i, "t", t) for i, _, t, _ in labels if i is not None}
    assert audited(spark, docs, labels) == replayed(docs, said)


def test_a_hot_text_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HOT_ONE_IN", 8)
    docs = [(i, "copy" if i % 3 else f"other {i // 6}", "s") for i in range(60)]
    assert audited(spark, docs, []) == replayed(docs, set())
    assert audited(spark, [], [(1, 1, 1, "x")]) == {}
