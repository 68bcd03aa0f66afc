"""Self-contained HTML reports with inline SVG."""

from __future__ import annotations

from html import escape

#: Bars of a histogram and groups of the heat map.
BARS, HEAT_GROUPS = 24, 18
_STYLE = "body{font:15px/1.5 system-ui,sans-serif;margin:2rem auto;max-width:70rem;color:#1c2733}h2{margin-top:2rem}table{border-collapse:collapse}td,th{padding:.25rem .75rem;border-bottom:1px solid #d5dbe1;text-align:left}.pass{color:#15703c}.warn{color:#9a5b00}.fail{color:#b3261e}svg{max-width:100%}.cards{display:flex;flex-wrap:wrap;gap:1rem}.cards div{border:1px solid #d5dbe1;border-radius:6px;padding:.5rem 1rem}"


def rebin(counts: dict[float, int], bars: int = BARS) -> tuple[float, float, list[int]]:
    """Counts of exact values in equal bins between the least and the greatest; half a unit around a single value."""
    lo, hi = min(counts), max(counts)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    out = [0] * bars
    for value, n in counts.items():
        out[min(bars - 1, int((value - lo) / (hi - lo) * bars))] += n
    return lo, hi, out


def svg(body: str, width: int = 640, height: int = 220) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" role="img">{body}</svg>'


def bars(counts: dict[float, int], label: str) -> str:
    if not counts:
        return svg(f'<text x="10" y="30">{escape(label)}: no data</text>')
    lo, hi, bins = rebin(counts)
    top = max(bins) or 1
    rects = "".join(f'<rect x="{10 + i * 26}" y="{180 - 150 * n / top:.1f}" width="24" height="{150 * n / top:.1f}" fill="#3d6fa5"><title>{n}</title></rect>' for i, n in enumerate(bins))
    return svg(f'{rects}<text x="10" y="200">{lo:g}</text><text x="590" y="200">{hi:g}</text><text x="250" y="214">{escape(label)}</text>')


def dots(bins: list[tuple[float, float, int]]) -> str:
    if not bins:
        return svg('<text x="10" y="30">no reads</text>')
    right, top, most = max(b[0] for b in bins) or 1, max(b[1] for b in bins) or 1, max(b[2] for b in bins)
    return svg("".join(f'<circle cx="{20 + 600 * x / right:.1f}" cy="{190 - 170 * y / top:.1f}" r="{1.5 + 5 * (n / most) ** 0.5:.1f}" fill="#2f7f6f" fill-opacity=".6"><title>{x:g} bp, Q{y:g}: {n}</title></circle>' for x, y, n in bins))


def tracks(places: dict[str, float]) -> str:
    rows = "".join(f'<text x="5" y="{24 + 26 * i}">{escape(name)}</text><line x1="160" x2="620" y1="{20 + 26 * i}" y2="{20 + 26 * i}" stroke="#9aa7b4"/><circle cx="{160 + 460 * p:.1f}" cy="{20 + 26 * i}" r="6" fill="#b3541e"/>' for i, (name, p) in enumerate(places.items()))
    return svg(rows, height=max(40, 26 * len(places) + 20))


def heat(groups: list[tuple[str, int, dict[int, int]]]) -> str:
    """Rows (name, reads, reads by hundredth), the largest groups first."""
    shown = sorted(groups, key=lambda g: (-g[1], g[0]))[:HEAT_GROUPS]
    cells = "".join(
        f'<text x="5" y="{14 + 18 * i}" font-size="11">{escape(name)} ({n})</text>' + "".join(f'<rect x="{300 + 3.3 * b:.1f}" y="{3 + 18 * i}" width="3.3" height="14" fill="#3d6fa5" fill-opacity="{c / n:.2f}"/>' for b, c in sorted(bins.items()))
        for i, (name, n, bins) in enumerate(shown)
    )
    return svg(cells, height=max(40, 18 * len(shown) + 10))


def table(header: list[str], rows) -> str:
    cell = lambda x: f"{x:.4g}" if isinstance(x, float) else escape(str(x))
    body = "".join("<tr>" + "".join(f"<td>{cell(x)}</td>" for x in row) + "</tr>" for row in rows)
    return f"<table><tr>{''.join(f'<th>{escape(h)}</th>' for h in header)}</tr>{body}</table>"


def page(title: str, body: str) -> str:
    return f"<!DOCTYPE html><html lang='en'><head><meta charset='utf-8'><title>{escape(title)}</title><style>{_STYLE}</style></head><body><h1>{escape(title)}</h1>{body}</body></html>"


def run_report(s: dict, plots: dict) -> str:
    """plots: lengths, base_qualities, qscores (value to count), bins, places, heat."""
    cards = "".join(f"<div>{escape(v['label'])}<br><b class='{v['status']}'>{v['status'].upper()}</b>{'' if v['value'] is None else f' {v['value']:.1%}'}</div>" for v in s["qc_verdicts"].values())
    facts = (("Reads", "total_reads"), ("Bases", "total_bases"), ("Mean length", "mean_read_length"), ("Median length", "median_read_length"), ("N50", "n50"), ("Median Q", "median_read_qscore"))
    cards2 = "".join(f"<div>{t}<br><b>{s[k]:,.10g}</b></div>" for t, k in facts)
    c = s["config_summary"]
    parts = [
        f"<div class='cards'>{cards}</div><div class='cards'>{cards2}</div>",
        "<h2>Configuration</h2>" + table(["Setting", "Value"], c.items()),
        "<h2>Anchors</h2>" + table(["Anchor", "Detected", "Mean distance", "Several hits"], ((a, v["detection_ratio"], v["mean_best_mismatches"], v["multi_hit_ratio"]) for a, v in s["anchor_quality_stats"].items())),
        "<h2>Buckets</h2>" + table(["Bucket", "Reads", "Share"], ((b, n, s["qc_bucket_ratios"][b]) for b, n in s["qc_bucket_counts"].items())),
        "<h2>Structures</h2>" + table(["Structure", "Orientation", "Reads"], ((a, o, n) for a, per in s["structure_orientation_counts"].items() for o, n in per.items())),
    ]
    if s["segment_qc"]:
        parts.append("<h2>Segments</h2>" + table(["Segment", "Observed", "Median length", "Median Q", "Within bounds"], ((g, v["observed_ratio"], v["median_length"], v["median_qscore"], v["within_length_ratio"]) for g, v in s["segment_qc"].items())))
    if s["barcode_qc"]:
        parts.append("<h2>Barcodes</h2>" + table(["Status", "Reads"], s["barcode_qc"]["status_counts"].items()))
    parts += ["<h2>Plots</h2>", bars(plots["lengths"], "read length"), bars(plots["base_qualities"], "base quality"), bars(plots["qscores"], "read quality"), dots(plots["bins"]), tracks(plots["places"]), heat(plots["heat"])]
    return page(f"Library QC: {s['sample_name']}", "".join(parts))


def batch_report(s: dict) -> str:
    good = [r for r in s["results"] if r["status"] == "success"]
    rows = ((r["summary"]["sample_name"], r["summary"]["total_reads"], r["summary"]["long_high_quality_ratio"], r["summary"]["correct_anchor_order_ratio"], r["summary"]["qc_verdicts"]["overall"]["status"]) for r in good)
    facts = f"<p>{s['success_count']} of {s['total_count']} files succeeded ({s['success_rate']:.1%}).</p>"
    return page("Batch QC", facts + table(["Sample", "Reads", "Long high-quality", "Anchor order", "Overall"], rows))
