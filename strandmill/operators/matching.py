"""Anchors in sequences: exact, with mismatches, with edits, and regular expressions. NumPy only, no Spark.

A hit is a tuple that sorts by place: (start, end, anchor, distance, substitutions, insertions, deletions, cigar, text).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import groupby

import numpy as np

from strandmill.settings import Anchor

#: The complements of bases; all other characters stand for themselves.
COMPLEMENT = str.maketrans("ACGTNacgtn", "TGCANtgcan")

START, END, NAME, DISTANCE, SUBSTITUTIONS, INSERTIONS, DELETIONS, CIGAR, TEXT = range(9)


@dataclass(frozen=True)
class Probe:
    """An anchor ready to be looked for."""

    anchor: Anchor
    motif: str = ""
    codes: np.ndarray | None = None
    regex: re.Pattern | None = None

    def bounds(self, n: int) -> tuple[int, int]:
        reach = min(n, self.anchor.search_window_bp or n)
        return {"5p": (0, reach), "3p": (n - reach, n)}.get(self.anchor.search_region, (0, n))


def compile_anchors(anchors: list[Anchor]) -> list[Probe]:
    out = []
    for a in anchors:
        if a.type == "regex":
            if not a.pattern:
                raise ValueError(f"Regex anchor '{a.name}' needs a pattern")
            out.append(Probe(a, regex=re.compile(a.pattern)))
        elif a.type == "fixed":
            if not a.sequence:
                raise ValueError(f"Fixed anchor '{a.name}' needs a sequence")
            if not isinstance(a.max_mismatches, int) or isinstance(a.max_mismatches, bool):
                raise ValueError(f"Anchor '{a.name}': max_mismatches must be an integer")
            if a.max_mismatches < 0:
                raise ValueError(f"Anchor '{a.name}': max_mismatches must be non-negative")
            motif = a.sequence.upper()
            out.append(Probe(a, motif, codes(motif)))
        else:
            raise ValueError(f"Unsupported anchor type: {a.type}")
    return out


def codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le"), np.uint32)


def reverse_complement(s: str) -> str:
    return s.translate(COMPLEMENT)[::-1]


def backend(anchors: list[Anchor]) -> dict[str, str]:
    """Which kinds of matching the anchors need: mode and detail."""
    fixed = [a for a in anchors if a.type == "fixed"]
    edit = [a.name for a in fixed if a.max_edits is not None]
    hamming = [a.name for a in fixed if a.max_edits is None]
    mode = {(True, True): "mixed", (True, False): "edit", (False, True): "hamming"}.get((bool(edit), bool(hamming)), "regex-only")
    detail = [f"{kind}: {', '.join(names)}" for kind, names in (("Hamming distance", hamming), ("edit distance", edit)) if names]
    return {"mode": mode, "detail": "; ".join(detail) or "no fixed-sequence anchors"}


def mismatch_places(text: np.ndarray, motif: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts, overlapping ones too, at which at most ``most`` characters differ, and how many do.

    At least one of most + 1 near-equal pieces of the motif must be unchanged. That follows from the number of
    mismatches unless the motif has no more characters than may differ; then one character must be the same.
    """
    m = len(motif)
    differ = np.zeros(len(text) - m + 1, np.int32)
    for k in range(m):
        differ += text[k : k + len(differ)] != motif[k]
    starts = np.nonzero((differ <= most) & (differ < m))[0]
    return starts, differ[starts]


def edit_matrix(text: np.ndarray, motif: np.ndarray) -> np.ndarray:
    """Least edits of each prefix of the motif to a stretch of text that ends at each place.

    Row by row; the running minimum along a row is that of the values less their index, so no inner loop is needed.
    """
    n = len(text)
    d = np.empty((len(motif) + 1, n + 1), np.int32)
    d[0] = 0
    index = np.arange(n + 1, dtype=np.int32)
    step = np.empty(n + 1, np.int32)
    for i, c in enumerate(motif, 1):
        above = d[i - 1]
        step[0] = i
        np.minimum(above[1:] + 1, above[:-1] + (text != c), out=step[1:])
        d[i] = np.minimum.accumulate(step - index) + index
    return d


def _walk_back(d: np.ndarray, text: np.ndarray, motif: np.ndarray, end: int) -> tuple[int, str]:
    """Where an alignment that ends at ``end`` starts, and its operations: match or substitution before insertion before deletion."""
    i, j, ops = len(motif), end, []
    while i:
        here = d[i, j]
        unlike = j and int(motif[i - 1] != text[j - 1])
        if j and here == d[i - 1, j - 1] + unlike:
            ops.append("MX"[unlike])
            i, j = i - 1, j - 1
        elif j and here == d[i, j - 1] + 1:
            ops.append("I")
            j -= 1
        else:
            ops.append("D")
            i -= 1
    return j, "".join(reversed(ops))


def _apart(found: list[tuple], name: str, text: str, m: int) -> list[tuple]:
    """Of alignments (distance, start, end, operations) those that don't overlap: the best first, then by length's closeness and place."""
    taken: list[tuple] = []
    for distance, _, start, end, ops in sorted((d, abs(e - s - m), s, e, ops) for d, s, e, ops in found if s < e):
        if all(end <= t[START] or t[END] <= start for t in taken):
            cigar = "".join(f"{len(list(run))}{op}" for op, run in groupby(ops))
            taken.append((start, end, name, distance, ops.count("X"), ops.count("I"), ops.count("D"), cigar, text[start:end]))
    return taken


def edit_hits(name: str, text: str, probe: Probe, most: int) -> list[tuple]:
    """Alignments of one text with at most ``most`` edits that don't overlap."""
    arr = codes(text)
    d = edit_matrix(arr, probe.codes)
    m = len(probe.codes)
    found = []
    for end in (np.nonzero(d[m, 1:] <= most)[0] + 1).tolist():
        start, ops = _walk_back(d, arr, probe.codes, end)
        found.append((int(d[m, end]), start, end, ops))
    return _apart(found, name, text, m)


class _Laid:
    """Many texts one after the other as one array, so far apart that no alignment reaches from one into the next."""

    def __init__(self, texts: list[str], gap: int):
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.lengths + gap) - self.lengths - gap
        self.codes = codes(("\0" * gap).join(texts) + "\0" * gap)

    def owners(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The text that each place is in, or the one before it, and the place there."""
        owner = np.searchsorted(self.starts, places, "right") - 1
        return owner, places - self.starts[owner]


def hamming_batch(laid: _Laid, motif: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, mismatches) of all places of all texts, as :func:`mismatch_places` finds them in one."""
    if len(laid.codes) < len(motif):
        return (np.zeros(0, np.int64),) * 3
    places, differ = mismatch_places(laid.codes, motif, most)
    owner, at = laid.owners(places)
    inside = at + len(motif) <= laid.lengths[owner]
    return owner[inside], at[inside], differ[inside]


def edit_batch(laid: _Laid, motif: np.ndarray, most: int) -> list[tuple[int, int, int, int, str]]:
    """(text, distance, start, end, operations) of the best alignment to each end with at most ``most`` edits.

    Least edits for all ends at once, row by row; then the alignments of the ends found, each from the stretch of text
    that one of so few edits can lie in. Both are as in :func:`edit_matrix` and :func:`_walk_back` of a single text.
    """
    text, m = laid.codes, len(motif)
    index = np.arange(len(text) + 1, dtype=np.int32)
    row = np.zeros(len(text) + 1, np.int32)
    for i, c in enumerate(motif, 1):
        step = np.empty_like(row)
        step[0] = i
        np.minimum(row[1:] + 1, row[:-1] + (text != c), out=step[1:])
        row = np.minimum.accumulate(step - index) + index
    ends = np.nonzero(row[1:] <= most)[0]
    owner, last = laid.owners(ends)
    inside = last < laid.lengths[owner]
    ends, owner, last = ends[inside], owner[inside], last[inside] + 1
    out = []
    width = m + 2 * most + 2
    for at in range(0, len(ends), _ENDS):
        out += _alignments(text, motif, ends[at : at + _ENDS], owner[at : at + _ENDS], last[at : at + _ENDS], width)
    return out


#: Ends whose alignments are worked out together.
_ENDS = 8192


def _alignments(text, motif, ends, owner, last, width: int) -> list[tuple[int, int, int, int, str]]:
    m, k = len(motif), len(ends)
    # the stretch before each end; what would lie before the text's own start is closed
    places = ends[:, None] + np.arange(1 - width, 1)
    window = text[np.maximum(places, 0)]
    closed = np.maximum(width - last, 0)
    column = np.arange(width + 1)
    shut, first = column[None, :] < closed[:, None], column[None, :] == closed[:, None]
    d = np.empty((m + 1, k, width + 1), np.int16)
    d[0] = np.where(shut, 1 << 12, 0)
    for i, c in enumerate(motif, 1):
        step = np.full((k, width + 1), 1 << 12, np.int16)
        np.minimum(d[i - 1][:, 1:] + 1, d[i - 1][:, :-1] + (window != c), out=step[:, 1:], casting="unsafe")
        step[shut] = 1 << 12
        step[first] = i
        d[i] = np.minimum.accumulate(step - column.astype(np.int16), axis=1) + column.astype(np.int16)
        d[i][shut] = 1 << 12
    out = []
    for e in range(k):
        rows, chars, low = d[:, e].tolist(), window[e].tolist(), int(closed[e])
        i, j, ops = m, width, []
        while i:
            here = rows[i][j]
            unlike = j > low and int(motif[i - 1] != chars[j - 1])
            if j > low and here == rows[i - 1][j - 1] + unlike:
                ops.append("MX"[unlike])
                i, j = i - 1, j - 1
            elif j > low and here == rows[i][j - 1] + 1:
                ops.append("I")
                j -= 1
            else:
                ops.append("D")
                i -= 1
        end = int(last[e])
        out.append((int(owner[e]), rows[m][width], end - (width - j), end, "".join(reversed(ops))))
    return out


def probe_hits(sequence: str, probe: Probe) -> list[tuple]:
    """One anchor's hits in an upper-cased sequence, in no particular order."""
    a = probe.anchor
    lo, hi = probe.bounds(len(sequence))
    text = sequence[lo:hi]
    if probe.regex is not None:
        return [(lo + m.start(), lo + m.end(), a.name, 0, 0, 0, 0, "", m[0]) for m in probe.regex.finditer(text)]
    if not text:
        return []
    if a.max_edits is not None:
        return [(s + lo, e + lo, *rest) for s, e, *rest in edit_hits(a.name, text, probe, a.max_edits)]
    m = len(probe.motif)
    if len(text) < m:
        return []
    if a.max_mismatches == 0:
        starts = [x.start() for x in re.finditer(f"(?={re.escape(probe.motif)})", text)]
        return [(lo + s, lo + s + m, a.name, 0, 0, 0, 0, "", probe.motif) for s in starts]
    starts, differ = mismatch_places(codes(text), probe.codes, a.max_mismatches)
    return [(lo + s, lo + s + m, a.name, k, 0, 0, 0, "", text[s : s + m]) for s, k in zip(starts.tolist(), differ.tolist())]


def find_hits_in_all(sequences: list[str], probes: list[Probe]) -> list[list[tuple]]:
    """:func:`find_hits` of each sequence; those with mismatches or edits are looked for in all at once."""
    upper = [s.upper() for s in sequences]
    hits: list[list[tuple]] = [[] for _ in upper]
    laid: dict[tuple, _Laid] = {}
    gap = 1 + max((p.anchor.max_edits or 0 for p in probes), default=0)
    for p in probes:
        a = p.anchor
        if p.regex is not None or a.max_edits is None and a.max_mismatches == 0:
            for own, s in zip(hits, upper):
                own.extend(probe_hits(s, p))
            continue
        bounds = [p.bounds(len(s)) for s in upper]
        where = (a.search_region, a.search_window_bp)
        if where not in laid:
            laid[where] = _Laid([s[lo:hi] for s, (lo, hi) in zip(upper, bounds)], gap)
        if a.max_edits is None:
            m = len(p.motif)
            for k, at, differ in zip(*(x.tolist() for x in hamming_batch(laid[where], p.codes, a.max_mismatches))):
                s = bounds[k][0] + at
                hits[k].append((s, s + m, a.name, differ, 0, 0, 0, "", upper[k][s : s + m]))
            continue
        found = edit_batch(laid[where], p.codes, a.max_edits)
        for k, group in groupby(found, key=lambda f: f[0]):
            lo, hi = bounds[k]
            for s, e, *rest in _apart([f[1:] for f in group], a.name, upper[k][lo:hi], len(p.motif)):
                hits[k].append((s + lo, e + lo, *rest))
    for own in hits:
        own.sort(key=lambda h: h[:3])
    return hits


def find_hits(sequence: str, probes: list[Probe]) -> list[tuple]:
    """All anchors' hits, sorted by (start, end, anchor)."""
    upper = sequence.upper()
    return sorted((h for p in probes for h in probe_hits(upper, p)), key=lambda h: h[:3])


def best_hits(hits: list[tuple]) -> dict[str, tuple]:
    """Each anchor's hit with the least distance, the first place among equals."""
    best: dict[str, tuple] = {}
    for h in sorted(hits, key=lambda h: (h[DISTANCE], h[START], h[END])):
        best.setdefault(h[NAME], h)
    return best
