"""Structure as column expressions against the rules in plain Python, on random hits, rules and orders."""

import random

import pytest
from pyspark.sql import functions as F

from strandmill import settings
from strandmill.operators import structure
from strandmill.operators.annotate import HIT
from tests import plain_structure as plain


def random_rules(rng):
    names = ["a", "b", "c"][: rng.randrange(1, 4)]
    rule = lambda: settings.Rule(
        required=rng.random() < 0.6, min_count=rng.choice([1, 1, 2]), max_count=rng.choice([None, 1, 2, 3]), terminal=rng.choice(["any", "any", "5p", "3p", "internal"]),
        max_terminal_offset=rng.choice([None, 0.3]), min_distance_from_previous=rng.choice([None, None, 5]), max_distance_from_previous=rng.choice([None, None, 30]),
    )
    return settings.Structure(
        expected_order=rng.choice([[], names, names, names[::-1]]), anchor_rules={n: rule() for n in names + ["d"] if rng.random() < 0.7},
        expected_orientation=rng.choice(["either", "either", "forward", "reverse"]), concatemer_min_cycles=rng.choice([2, 2, 3]), split_concatemers=rng.random() < 0.5,
    )


def random_hits(rng, rules):
    out, at = [], 0
    likely = rules.expected_order * rng.randrange(1, 4) or ["a"]
    for k in range(rng.choice([0, 1, 2, 3, 3, 4, 6, 9])):
        at += rng.choice([0, 1, 4, 9, 25])
        name = likely[k % len(likely)] if rng.random() < 0.8 else rng.choice("abcd")
        out.append((at, at + rng.choice([0, 4, 6]), name, rng.randrange(3), 0, 0, 0, "", ""))
    return sorted(out, key=lambda h: h[:3])


@pytest.mark.parametrize("seed", range(12))
def test_columns_say_what_the_rules_do(spark, seed):
    rng = random.Random(seed)
    rules = random_rules(rng)
    rows = [(k, random_hits(rng, rules), random_hits(rng, rules), rng.choice([0, 60, 120, 300])) for k in range(150)]
    df = spark.createDataFrame(rows, f"k int, _forward array<{HIT}>, _reverse array<{HIT}>, length int")
    sequence, quality = "ACGTTGCAAT" * 40, "0123456789" * 40
    df = df.withColumns({"s": F.lit(sequence), "q": F.lit(quality)})
    found = structure.choose_strand(df, rules).withColumn("molecules", structure.molecules(rules, "s", "q"))
    labels = set()
    for r in found.collect():
        _, forward, reverse, length = rows[r.k]
        v, hits = plain.choose_strand(forward, reverse, rules, length)
        assert (r.label, r.order_valid, r.is_reversed, r.detected, r.violations, r.cycle_count) == (v.label, v.order_valid, v.is_reversed, v.detected, v.violations, v.cycle_count), (rows[r.k], rules)
        assert list(map(tuple, r.hits)) == hits
        split = plain.molecules(sequence, quality, hits, rules.expected_order) if rules.split_concatemers and v.label == "concatemer_candidate" else []
        assert list(map(tuple, r.molecules)) == split
        labels.add(v.label)
    assert len(labels) > 2
