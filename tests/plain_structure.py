"""The rules of structure one read at a time, in plain Python, which the column expressions are held against."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import groupby, pairwise

from strandmill.operators.matching import DISTANCE, END, NAME, START, best_hits
from strandmill.operators.structure import RANK, TERMINAL_OFFSET
from strandmill.settings import Structure



@dataclass
class Verdict:
    label: str
    order_valid: bool = False
    detected: list[str] = field(default_factory=list)
    violations: list[str] = field(default_factory=list)
    cycle_count: int = 0
    is_reversed: bool = False


def cycles(hits: list[tuple], order: list[str]) -> list[list[tuple]]:
    """Complete passes through the expected order, one after the other.

    Anchors outside the order are passed over; one of the order at the wrong place breaks a pass off, and the first
    one starts another.
    """
    place = {name: i for i, name in enumerate(order)}
    done: list[list[tuple]] = []
    run: list[tuple] = []
    for h in sorted(hits, key=lambda h: h[:3]):
        at = place.get(h[NAME])
        if at is None:
            continue
        run = [*run, h] if at == len(run) else [h] if at == 0 else []
        if len(run) == len(order):
            done.append(run)
            run = []
    return done


def violations(hits: list[tuple], rules: Structure, length: int | None) -> list[str]:
    """Which rules the hits break, as ``anchor:what``."""
    count, best = Counter(h[NAME] for h in hits), best_hits(hits)
    out = []
    for name, r in rules.anchor_rules.items():
        n, b = count[name], best.get(name)
        out += [f"{name}:below_min_count"] * (r.required and n < r.min_count)
        out += [f"{name}:above_max_count"] * (r.max_count is not None and n > r.max_count)
        if b is None or not length or r.terminal == "any":
            continue
        limit = TERMINAL_OFFSET if r.max_terminal_offset is None else r.max_terminal_offset
        left, right = b[START] / length, (length - b[END]) / length
        broken = {"5p": left > limit, "3p": right > limit, "internal": min(left, right) <= limit}[r.terminal]
        out += [f"{name}:not_internal" if r.terminal == "internal" else f"{name}:not_{r.terminal}_terminal"] * broken
    for before, name in pairwise(rules.expected_order):
        r = rules.anchor_rules.get(name)
        if r and name in best and before in best:
            gap = best[name][START] - best[before][END]
            out += [f"{name}:distance_below_min"] * (r.min_distance_from_previous is not None and gap < r.min_distance_from_previous)
            out += [f"{name}:distance_above_max"] * (r.max_distance_from_previous is not None and gap > r.max_distance_from_previous)
    return out


def _restarts(runs: list[str], order: list[str]) -> bool:
    """Whether somewhere the whole order is followed by its first anchor."""
    wanted = [*order, order[0]]
    return any(runs[i : i + len(wanted)] == wanted for i in range(len(runs)))


def _excess(count: Counter, rules: Structure) -> bool:
    for name, n in count.items():
        rule = rules.anchor_rules.get(name)
        if n > 1 and (rule is None or (rule.max_count is not None and n > rule.max_count)):
            return True
    return False


def label(hits: list[tuple], rules: Structure, length: int | None = None) -> Verdict:
    """The structure of one strand's hits."""
    if not hits:
        return Verdict("no_anchor_detected")
    order, names = rules.expected_order, [h[NAME] for h in hits]
    runs, count = [n for n, _ in groupby(names)], Counter(names)
    passes = len(cycles(hits, order)) if order else 0
    if passes >= rules.concatemer_min_cycles:
        return Verdict("concatemer_candidate", False, runs, cycle_count=passes)
    if _excess(count, rules):
        checks = ((_restarts(runs, order), "concatemer_candidate"), (count[order[0]] > 1, "internal_5p_anchor"), (count[order[-1]] > 1, "internal_3p_anchor")) if order else ()
        return Verdict(next((name for holds, name in checks if holds), "duplicated_anchor"), False, runs)
    if not order:
        return Verdict("anchors_detected", True, runs)
    optional = {n for n, r in rules.anchor_rules.items() if not r.required}
    if set(order) - set(runs) - optional:
        name = "missing_5p_anchor" if order[0] not in count else "missing_3p_anchor" if order[-1] not in count else "partial_structure"
        return Verdict(name, False, runs)
    places = [order.index(n) for n in runs if n in order]
    if places != sorted(places):
        return Verdict("anchor_order_invalid", False, runs)
    broken = violations(hits, rules, length)
    if broken:
        return Verdict("structure_rule_violation", False, runs, broken, passes)
    return Verdict("full_structure", True, runs)


def _score(v: Verdict, hits: list[tuple]) -> tuple:
    return v.order_valid, RANK.get(v.label, 0), len(v.detected), len(hits), -sum(h[DISTANCE] for h in hits)


def choose_strand(forward: list[tuple], reverse: list[tuple], rules: Structure, length: int | None = None) -> tuple[Verdict, list[tuple]]:
    """The better strand's structure and hits; the forward one's on a tie."""
    f, r = label(forward, rules, length), label(reverse, rules, length)
    r.is_reversed = True
    v, hits = (r, reverse) if _score(r, reverse) > _score(f, forward) else (f, forward)
    if rules.expected_orientation not in ("either", "reverse" if v.is_reversed else "forward"):
        v.violations = [*v.violations, "orientation_unexpected"]
        if v.label == "full_structure":
            v.label, v.order_valid = "orientation_unexpected", False
    return v, hits


def molecules(sequence: str, quality: str, hits: list[tuple], order: list[str]) -> list[tuple[int, int, int, str, str]]:
    """(cycle's number from 1, start, end, sequence, quality) of each complete cycle of an oriented read."""
    spans = [(k, c[0][START], c[-1][END]) for k, c in enumerate(cycles(hits, order) if order else [], 1)]
    return [(k, s, e, sequence[s:e], quality[s:e]) for k, s, e in spans if s < e]
