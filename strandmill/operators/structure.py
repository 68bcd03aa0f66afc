"""What the order of a read's hits says about the molecule: label, orientation, cycles, segments, molecules.

All of it is column expressions over arrays of hits: a fold with a state for the cycles, comparisons of structs for the
strand, filters and literal maps for the rules. Columns that several expressions read are made in a step of their own, so
that they are worked out once.
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions import columns as C
from strandmill.settings import Rule, Segment, Structure

# How labels rank when a read's two strands are compared.
RANK = {
    "full_structure": 6, "anchors_detected": 5, "anchor_order_invalid": 4, "partial_structure": 3, "missing_5p_anchor": 2,
    "missing_3p_anchor": 2, "concatemer_candidate": 1, "internal_5p_anchor": 1, "internal_3p_anchor": 1,
    "duplicated_anchor": 1, "structure_rule_violation": 1, "no_anchor_detected": 0,
}
#: The offset within which an anchor is terminal, for rules that give none.
TERMINAL_OFFSET = 0.15
UNLIMITED = (1 << 31) - 1
_SPANS = "array<struct<start:int,end:int>>"


def text(word: str) -> str:
    """A word as an SQL literal."""
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _map(pairs: dict) -> str:
    return f"map({', '.join(f'{text(k)}, {v}' for k, v in pairs.items())})"


def _words(words: list[str]) -> str:
    return f"cast(array({', '.join(map(text, words))}) as array<string>)"


def _places(order: list[str]) -> str:
    return _map({name: k for k, name in enumerate(order)})


def _count(names: str, name: str) -> str:
    return f"size(filter({names}, n -> n = {name}))"


def cycles(hits: str, order: list[str]) -> str:
    """SQL of where complete passes through the expected order start and end, one after the other.

    The state is the place in the order that is waited for, the running pass's start, and the passes done. Anchors outside
    the order are passed over; one of the order at the wrong place breaks a pass off, and the first one starts another.
    """
    none = f"cast(array() as {_SPANS})"
    if not order:
        return none
    place = f"try_element_at({_places(order)}, h.anchor)"
    start = f"if({place} = 0, h.start, s.start)"
    # passed over, the last of a pass, the next one, the first of another pass, or none of these
    return f"""aggregate({hits}, named_struct('at', 0, 'start', 0, 'done', {none}), (s, h) -> CASE
        WHEN {place} IS NULL THEN s
        WHEN {place} = {len(order) - 1} AND {place} = s.at THEN named_struct('at', 0, 'start', {start}, 'done', concat(s.done, array(named_struct('start', {start}, 'end', h.end))))
        ELSE named_struct('at', CASE WHEN {place} = s.at THEN s.at + 1 WHEN {place} = 0 THEN 1 ELSE 0 END, 'start', {start}, 'done', s.done) END, s -> s.done)"""


def _rule_checks(rules: Structure, names: str, best: dict[str, str]) -> str:
    """SQL of what is broken, as an array of ``anchor:what``."""
    out: list[tuple[str, str]] = []
    for name, r in rules.anchor_rules.items():
        n, b = _count(names, text(name)), best[name]
        if r.required:
            out.append((f"{n} < {r.min_count}", f"{name}:below_min_count"))
        if r.max_count is not None:
            out.append((f"{n} > {r.max_count}", f"{name}:above_max_count"))
        if r.terminal != "any":
            limit = TERMINAL_OFFSET if r.max_terminal_offset is None else r.max_terminal_offset
            left, right = f"{b}.start / length", f"(length - {b}.end) / length"
            broken = {"5p": f"{left} > {limit}D", "3p": f"{right} > {limit}D", "internal": f"least({left}, {right}) <= {limit}D"}[r.terminal]
            out.append((f"{b} IS NOT NULL AND length > 0 AND {broken}", f"{name}:not_internal" if r.terminal == "internal" else f"{name}:not_{r.terminal}_terminal"))
    for before, name in pairwise(rules.expected_order):
        r: Rule | None = rules.anchor_rules.get(name)
        gap = f"{best[name]}.start - {best[before]}.end"  # null, and so never broken, unless both are there
        if r and r.min_distance_from_previous is not None:
            out.append((f"{gap} < {r.min_distance_from_previous}", f"{name}:distance_below_min"))
        if r and r.max_distance_from_previous is not None:
            out.append((f"{gap} > {r.max_distance_from_previous}", f"{name}:distance_above_max"))
    return f"cast(array_compact(array({', '.join(f'CASE WHEN {broken} THEN {text(what)} END' for broken, what in out)})) as array<string>)"


def _label(rules: Structure, hits: str, names: str, runs: str, passes: str, broken: str) -> str:
    order = rules.expected_order
    limits = {n: UNLIMITED if r.max_count is None else max(1, r.max_count) for n, r in rules.anchor_rules.items()}
    most = f"coalesce(try_element_at({_map(limits)}, x), 1)" if limits else "1"
    excess = f"exists(array_distinct({names}), x -> {_count(names, 'x')} > {most})"
    if not order:
        return f"CASE WHEN size({hits}) = 0 THEN 'no_anchor_detected' WHEN {excess} THEN 'duplicated_anchor' ELSE 'anchors_detected' END"
    first, last, again = text(order[0]), text(order[-1]), [*order, order[0]]
    # somewhere the whole order is followed by its first anchor
    restarts = f"exists(sequence(1, size({runs})), k -> slice({runs}, k, {len(again)}) = {_words(again)})"
    wanted = [n for n in order if n not in rules.anchor_rules or rules.anchor_rules[n].required]
    places = f"filter(transform({runs}, n -> try_element_at({_places(order)}, n)), k -> k IS NOT NULL)"
    return f"""CASE WHEN size({hits}) = 0 THEN 'no_anchor_detected' WHEN {passes} >= {rules.concatemer_min_cycles} THEN 'concatemer_candidate'
        WHEN {excess} THEN CASE WHEN {restarts} THEN 'concatemer_candidate' WHEN {_count(names, first)} > 1 THEN 'internal_5p_anchor' WHEN {_count(names, last)} > 1 THEN 'internal_3p_anchor' ELSE 'duplicated_anchor' END
        WHEN size(array_except({_words(wanted)}, {runs})) > 0 THEN CASE WHEN NOT array_contains({names}, {first}) THEN 'missing_5p_anchor' WHEN NOT array_contains({names}, {last}) THEN 'missing_3p_anchor' ELSE 'partial_structure' END
        WHEN {places} <> array_sort({places}) THEN 'anchor_order_invalid' WHEN size({broken}) > 0 THEN 'structure_rule_violation' ELSE 'full_structure' END"""


def with_strand(df: DataFrame, hits: str, out: str, rules: Structure) -> DataFrame:
    """df with a column ``out``: what one strand's hits say, with a score that sorts as strands are preferred. df has the read's ``length``."""
    names, runs, passes, broken, label = f"{out}_names", f"{out}_runs", f"size({out}_cycles)", f"{out}_broken", f"{out}_label"
    named = {n: f"b{k}" for k, n in enumerate(dict.fromkeys([*rules.anchor_rules, *rules.expected_order]))}
    best = ", ".join(f"'{b}', {C.best_of(hits, n)}" for n, b in named.items())
    df = df.withColumn(names, F.expr(f"transform({hits}, h -> h.anchor)"))
    df = df.withColumns({
        runs: F.expr(f"filter({names}, (n, i) -> i = 0 OR n <> get({names}, i - 1))"), f"{out}_cycles": F.expr(cycles(hits, rules.expected_order)),
        f"{out}_best": F.expr(f"named_struct('none', 0{', ' * bool(best)}{best})"),
    })
    df = df.withColumn(broken, F.expr(_rule_checks(rules, names, {n: f"{out}_best.{b}" for n, b in named.items()})))
    df = df.withColumn(label, F.expr(_label(rules, hits, names, runs, passes, broken)))
    valid, counted = f"{label} IN ('full_structure', 'anchors_detected')", f"{label} = 'concatemer_candidate' AND {passes} >= {rules.concatemer_min_cycles}"
    told = f"""named_struct('label', {label}, 'order_valid', {valid}, 'detected', {runs}, 'violations', if({label} = 'structure_rule_violation', {broken}, cast(array() as array<string>)),
        'cycle_count', if({label} = 'structure_rule_violation' OR {counted}, {passes}, 0), 'hits', {hits}, 'cycles', {out}_cycles,
        'score', named_struct('valid', {valid}, 'rank', try_element_at({_map(RANK)}, {label}), 'runs', size({runs}), 'hits', size({hits}), 'distance', -aggregate({hits}, 0, (s, h) -> s + h.distance)))"""
    return df.withColumn(out, F.expr(told)).drop(names, runs, f"{out}_cycles", f"{out}_best", broken, label)


def choose_strand(df: DataFrame, rules: Structure, forward: str = "_forward", reverse: str = "_reverse") -> DataFrame:
    """df, which has the reads' ``length``, with the better strand's label, order_valid, is_reversed, detected, violations, cycle_count, hits and _cycles; the forward one's on a tie."""
    df = with_strand(with_strand(df, forward, "_f", rules), reverse, "_r", rules)
    df = df.withColumn("is_reversed", F.expr("_r.score > _f.score")).withColumn("_s", F.expr("if(is_reversed, _r, _f)"))
    label, valid, violations = "_s.label", "_s.order_valid", "_s.violations"
    if rules.expected_orientation != "either":
        against = "is_reversed" if rules.expected_orientation == "forward" else "NOT is_reversed"
        label = f"if({against} AND _s.label = 'full_structure', 'orientation_unexpected', _s.label)"
        valid = f"_s.order_valid AND NOT ({against} AND _s.label = 'full_structure')"
        violations = f"if({against}, concat(_s.violations, {_words(['orientation_unexpected'])}), _s.violations)"
    columns = {"label": label, "order_valid": valid, "detected": "_s.detected", "violations": violations, "cycle_count": "_s.cycle_count", "hits": "_s.hits", "_cycles": "_s.cycles"}
    return df.withColumns({name: F.expr(sql) for name, sql in columns.items()}).drop("_f", "_r", "_s", forward, reverse)


def with_segments(df: DataFrame, segments: list[Segment], sequence: str, quality: str, scores) -> DataFrame:
    """df with what lies between each segment's anchors on the oriented read; scores: a function of an array of qualities."""
    if not segments:
        return df.withColumn("segments", F.expr("cast(array() as array<struct<name:string,role:string,start:int,end:int,length:int,mean_qscore:double,gc_fraction:double,n_fraction:double,status:string>>)"))
    parts, out = [], []
    for k, g in enumerate(segments):
        lo, hi = f"try_element_at(best, {text(g.start_anchor)}).end", f"try_element_at(best, {text(g.end_anchor)}).start"
        parts.append(f"CASE WHEN {hi} >= {lo} THEN named_struct('lo', {lo}, 'hi', {hi}, 'bases', upper(substring({sequence}, {lo} + 1, {hi} - {lo})), 'quality', substring({quality}, {lo} + 1, {hi} - {lo})) END")
        p = f"get(_parts, {k})"
        n = f"length({p}.bases)"
        short = [f"WHEN {n} < {g.min_length} THEN 'too_short'"] * (g.min_length is not None) + [f"WHEN {n} > {g.max_length} THEN 'too_long'"] * (g.max_length is not None)
        share = lambda c: f"CASE WHEN {n} > 0 THEN ({n} - length(translate({p}.bases, '{c}', ''))) / {n} WHEN {n} = 0 THEN 0D END"  # noqa: E731, B023
        out.append(f"""named_struct('name', {text(g.name)}, 'role', {text(g.role)}, 'start', {p}.lo, 'end', {p}.hi, 'length', {n}, 'mean_qscore', if({p} IS NOT NULL, get(_scores, {k}), cast(null as double)),
            'gc_fraction', {share('GC')}, 'n_fraction', {share('N')}, 'status', CASE WHEN {p} IS NULL THEN 'missing' {' '.join(short)} ELSE 'pass' END)""")
    df = df.withColumn("_parts", F.expr(f"array({', '.join(parts)})"))
    df = df.withColumn("_scores", scores(F.expr("transform(_parts, p -> p.quality)")))
    return df.withColumn("segments", F.expr(f"array({', '.join(out)})")).drop("_parts", "_scores")


def molecules(rules: Structure, sequence: str, quality: str) -> Column:
    """(cycle's number from 1, start, end, sequence, quality) of each complete cycle of an oriented read that is a concatemer."""
    none = "cast(array() as array<struct<cycle:int,start:int,end:int,sequence:string,quality:string>>)"
    if not rules.split_concatemers:
        return F.expr(none)
    cut = lambda c: f"substring({c}, c.start + 1, c.end - c.start)"
    numbered = "transform(_cycles, (c, i) -> named_struct('cycle', i + 1, 'start', c.start, 'end', c.end))"
    whole = f"transform(filter({numbered}, c -> c.start < c.end), c -> named_struct('cycle', c.cycle, 'start', c.start, 'end', c.end, 'sequence', {cut(sequence)}, 'quality', {cut(quality)}))"
    return F.expr(f"if(label = 'concatemer_candidate', {whole}, {none})")
