"""A page of its own: escaped tables and drawn charts, without outside files."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from html import escape
from typing import TYPE_CHECKING, Any

from ..operators.charts import PIE_LABEL, share_text
from ..operators.types import LABELS
from .recommendations import by_step

if TYPE_CHECKING:
    from .pipeline import Analysis

TOP = 20
STYLE = "body{font:15px/1.5 system-ui,sans-serif;margin:2em auto;max-width:70em;padding:0 1em;color:#223}table{border-collapse:collapse;margin:1em 0}td,th{border:1px solid #ccd;padding:.2em .6em;text-align:left}th{background:#eef}svg{max-width:34em;margin:.5em}.high,.critical{color:#a11}.medium{color:#a60}"


def measure(x: Any) -> str:
    if x is None or isinstance(x, float) and not math.isfinite(x):
        return "∞" if isinstance(x, float) and x == math.inf else "-"
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        return str(x)
    if isinstance(x, int):
        return f"{x:,}"
    if x == 0 or 1e-3 <= abs(x) < 1e6:
        return f"{x:,.3f}".rstrip("0").rstrip(".")
    return f"{x:.3g}"


def p_value(p: float | None) -> str:
    return "-" if p is None or math.isnan(p) else "<0.0001" if p < 0.0001 else f"{p:.4f}"


def vif_text(v: float) -> str:
    return "∞" if math.isinf(v) else f"{v:.1f}" if v < 1000 else f"{v:,.0f}"


def list_text(columns: list[str]) -> str:
    """The columns as a Python list, to copy."""
    return "[" + ", ".join(repr(c) for c in columns) + "]"


def file_name(label: str, used: set[str], most: int = 50) -> str:
    """A safe name for a chart, unlike any used before whatever the case."""
    base = re.sub(r'[<>:"/\\|?*\x00-\x1f]', "_", label)[:most].strip() or "chart"
    name, k = base, 1
    while name.lower() in used:
        k += 1
        name = f"{base}_{k}"
    used.add(name.lower())
    return name


def table(head: list[str], rows: list[list[Any]]) -> str:
    if not rows:
        return ""
    return "<table><tr>" + "".join(f"<th>{escape(h)}</th>" for h in head) + "</tr>" + "".join("<tr>" + "".join(f"<td>{escape(measure(x))}</td>" for x in r) + "</tr>" for r in rows) + "</table>"


def section(title: str, body: str) -> str:
    return f'<section id="{re.sub(r"[^a-z]+", "-", title.lower())}"><h2>{escape(title)}</h2>{body}</section>' if body else ""


def _frame(title: str, inner: str, w: int = 480, h: int = 240) -> str:
    return f'<svg viewBox="0 0 {w} {h}" role="img" aria-label="{escape(title)}"><text x="8" y="16" font-size="13">{escape(title[:70])}</text>{inner}</svg>'


def bar_chart(title: str, items: list[tuple[str, float]]) -> str:
    if not items:
        return ""
    top, step = max(n for _, n in items) or 1, 460 / len(items)
    return _frame(title, "".join(f'<rect x="{10 + i * step:.1f}" y="{220 - 190 * n / top:.1f}" width="{max(1, step - 1):.1f}" height="{190 * n / top:.1f}" fill="#47a"><title>{escape(str(k))}: {escape(measure(n))}</title></rect>' for i, (k, n) in enumerate(items)))


def density(bins: list[tuple[float, float, float]]) -> list[float]:
    """A smooth curve over (low, high, n) bins: a Gaussian kernel of Scott's width on their middles, per bin."""
    total = sum(n for _, _, n in bins)
    if not total:
        return []
    mid = [(a + b) / 2 for a, b, _ in bins]
    mean = sum(m * n for m, (_, _, n) in zip(mid, bins)) / total
    std = math.sqrt(sum((m - mean) ** 2 * n for m, (_, _, n) in zip(mid, bins)) / total)
    width = std * total**-0.2 or 1.0
    step = bins[0][1] - bins[0][0]
    return [sum(n * math.exp(-(((x - m) / width) ** 2) / 2) for m, (_, _, n) in zip(mid, bins)) * step / (width * math.sqrt(2 * math.pi)) for x in mid]


SHADES = ("#47a", "#a33", "#3a5", "#a73", "#73a", "#399", "#777")


def dot_chart(title: str, points: list[tuple[float, float]], log: tuple[bool, bool] = (False, False), groups: list[str] | None = None) -> str:
    """Points on axes that may be logarithmic, where values up to 0 have no place; groups: one of each point, as its colour."""
    seen = list(dict.fromkeys(groups or []))
    placed = []
    for k, point in enumerate(points):
        if all(v is not None and (v > 0 or not is_log) for v, is_log in zip(point, log)):
            placed.append((*(math.log10(v) if is_log else float(v) for v, is_log in zip(point, log)), SHADES[seen.index(groups[k]) % len(SHADES)] if groups else SHADES[0]))
    if not placed:
        return ""
    (x0, x1), (y0, y1) = ((min(vs), max(vs)) for vs in (([p[i] for p in placed]) for i in (0, 1)))
    dots = "".join(f'<circle cx="{10 + 460 * (x - x0) / ((x1 - x0) or 1):.1f}" cy="{225 - 200 * (y - y0) / ((y1 - y0) or 1):.1f}" r="2" fill="{shade}" fill-opacity=".5"/>' for x, y, shade in placed)
    axes = " ".join(f"{name} log10" for name, is_log in zip("xy", log) if is_log)
    return _frame(f"{title} ({axes})" if axes else title, dots)


def box_chart(title: str, rows: list[tuple]) -> str:
    """(name, q25, median, q75, low whisker, high whisker) as boxes on one scale."""
    rows = [r for r in rows if None not in r[1:6]]
    if not rows:
        return ""
    low, high = min(r[4] for r in rows), max(r[5] for r in rows)
    at = lambda v: 90 + 375 * (v - low) / ((high - low) or 1)
    step = min(40.0, 205 / len(rows))
    parts = []
    for i, (name, a, m, b, lo, hi, *_) in enumerate(rows):
        y, half = 25 + (i + 0.5) * step, step * 0.35
        parts.append(f'<text x="4" y="{y + 4:.1f}" font-size="9">{escape(str(name)[:16])}</text><line x1="{at(lo):.1f}" x2="{at(hi):.1f}" y1="{y:.1f}" y2="{y:.1f}" stroke="#777"/>')
        parts.append(f'<rect x="{at(a):.1f}" y="{y - half:.1f}" width="{max(1, at(b) - at(a)):.1f}" height="{2 * half:.1f}" fill="#47a" fill-opacity=".6"><title>{escape(", ".join(map(measure, (lo, a, m, b, hi))))}</title></rect><line x1="{at(m):.1f}" x2="{at(m):.1f}" y1="{y - half:.1f}" y2="{y + half:.1f}" stroke="#a33"/>')
    return _frame(title, "".join(parts))


def pie_chart(title: str, items: list[tuple[str, float]]) -> str:
    """(name, share) as slices; those of a twentieth or more are labelled in place."""
    parts, turn = [], 0.0
    for i, (name, share) in enumerate(items):
        a, b = (2 * math.pi * x - math.pi / 2 for x in (turn, turn + min(share, 0.99999)))
        (x0, y0), (x1, y1) = ((120 + 90 * math.cos(w), 130 + 90 * math.sin(w)) for w in (a, b))
        shade = SHADES[i % len(SHADES)]
        parts.append(f'<path d="M120,130 L{x0:.1f},{y0:.1f} A90,90 0 {int(share > 0.5)} 1 {x1:.1f},{y1:.1f} Z" fill="{shade}" fill-opacity=".7"/><text x="250" y="{45 + 18 * i}" font-size="11" fill="{shade}">{escape(str(name)[:24])}: {escape(share_text(share))}</text>')
        if share >= PIE_LABEL:
            middle = (a + b) / 2
            parts.append(f'<text x="{120 + 55 * math.cos(middle):.1f}" y="{133 + 55 * math.sin(middle):.1f}" font-size="10" text-anchor="middle">{escape(share_text(share))}</text>')
        turn += share
    return _frame(title, "".join(parts)) if parts else ""


def grouped_bars(title: str, rows: list[tuple[str, str, int]], labels: int = 24) -> str:
    """(class, category, n): a group of bars for each class, a colour for each category; numbers on few bars."""
    kinds, groups = list(dict.fromkeys(r[1] for r in rows)), list(dict.fromkeys(r[0] for r in rows))
    if not rows:
        return ""
    top, step = max(r[2] for r in rows) or 1, 460 / len(groups)
    width = step * 0.9 / len(kinds)
    parts = [f'<text x="{10 + (i + 0.45) * step:.1f}" y="236" font-size="9" text-anchor="middle">{escape(str(g)[:12])}</text>' for i, g in enumerate(groups)]
    for g, k, n in rows:
        x, high = 10 + groups.index(g) * step + kinds.index(k) * width, 180 * n / top
        parts.append(f'<rect x="{x:.1f}" y="{222 - high:.1f}" width="{max(1, width - 1):.1f}" height="{high:.1f}" fill="{SHADES[kinds.index(k) % len(SHADES)]}"><title>{escape(f"{g}, {k}: {n}")}</title></rect>')
        if len(rows) <= labels:
            parts.append(f'<text x="{x + width / 2:.1f}" y="{219 - high:.1f}" font-size="8" text-anchor="middle">{n}</text>')
    return _frame(title, "".join(parts))


def heat_chart(title: str, values: dict[tuple[str, str], float], written: int = 15) -> str:
    """A coloured cell for each pair; the values stand in the cells of up to `written` columns."""
    names = list(dict.fromkeys(a for a, _ in values))
    if len(names) < 2:
        return ""
    size = 200 / len(names)
    shade = lambda v: f"rgb({int(255 - 160 * max(0, -v))},{int(255 - 160 * abs(v))},{int(255 - 160 * max(0, v))})"
    parts = []
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            v, x, y = values.get((a, b)), 20 + j * size, 25 + i * size
            parts.append(f'<rect x="{x:.1f}" y="{y:.1f}" width="{size:.1f}" height="{size:.1f}" fill="{shade(v or 0.0)}"><title>{escape(a)}, {escape(b)}: {escape(measure(v))}</title></rect>')
            if len(names) <= written and v is not None:
                parts.append(f'<text x="{x + size / 2:.1f}" y="{y + size / 2 + 2:.1f}" font-size="{min(9.0, size / 3):.1f}" text-anchor="middle">{v:.2f}</text>')
    return _frame(title, "".join(parts))


def pair_grid(title: str, columns: list[str], rows: list[tuple], log: list[str]) -> str:
    """All pairs of columns as small scatters in one drawing; a further cell of a row is its colour. On the diagonal stand the names."""
    k = len(columns)
    size, groups = 600 / k, list(dict.fromkeys(r[k] for r in rows if len(r) > k))
    place: list[list[float | None]] = []
    for i, c in enumerate(columns):
        raw = [None if r[i] is None else float(r[i]) for r in rows]
        v = [None if x is None or c in log and x <= 0 else math.log10(x) if c in log else x for x in raw]
        there = [x for x in v if x is not None]
        low, high = (min(there), max(there)) if there else (0.0, 1.0)
        place.append([None if x is None else (x - low) / ((high - low) or 1) for x in v])
    parts = []
    for i, c in enumerate(columns):
        parts.append(f'<text x="{i * size + size / 2:.1f}" y="{20 + i * size + size / 2:.1f}" font-size="10" text-anchor="middle">{escape(c[:18])}{" (log10)" if c in log else ""}</text>')
        for j in range(k):
            parts.append(f'<rect x="{j * size:.1f}" y="{20 + i * size:.1f}" width="{size:.1f}" height="{size:.1f}" fill="none" stroke="#ddd"/>')
            if i != j:
                parts += (f'<circle cx="{j * size + 4 + (size - 8) * x:.1f}" cy="{20 + i * size + size - 4 - (size - 8) * y:.1f}" r="1" fill="{SHADES[groups.index(r[k]) % len(SHADES)] if groups else SHADES[0]}" fill-opacity=".4"/>' for r, x, y in zip(rows, place[j], place[i]) if x is not None and y is not None)
    return _frame(title, "".join(parts), 600, 620)


def missing_chart(mask: list[list[bool]]) -> str:
    cell = lambda i, j, n: f'<rect x="{10 + 460 * j / n:.1f}" y="{25 + 200 * i / len(mask):.2f}" width="{460 / n:.1f}" height="{max(0.4, 200 / len(mask)):.2f}" fill="#a33"/>'
    return _frame("missing cells of sampled rows", "".join(cell(i, j, len(r)) for i, r in enumerate(mask) for j, gone in enumerate(r) if gone))


def histogram_chart(title: str, bins: list[tuple]) -> str:
    bars, curve = bar_chart(title, [(measure(r[1]), r[3]) for r in bins]), density([(r[1], r[2], r[3]) for r in bins])
    top, step = max((r[3] for r in bins), default=0) or 1, 460 / max(1, len(bins))
    line = " ".join(f"{10 + (i + 0.5) * step:.1f},{220 - 190 * min(1, y / top):.1f}" for i, y in enumerate(curve))
    return bars.replace("</svg>", f'<polyline points="{line}" fill="none" stroke="#a33"/></svg>') if curve else bars


#: How a chart is drawn, by what its name begins with; the first that fits.
DRAWN: list[tuple[str, Callable[[str, Any], str]]] = [
    ("histogram", histogram_chart),
    ("class_bars", grouped_bars),
    ("class_boxes", box_chart),
    ("boxes", lambda title, rows: "".join(box_chart(f"{title}: {r[0]}", [r]) for r in rows)),
    ("shares", lambda title, rows: pie_chart(title, [(str(r[0]), r[2]) for r in rows])),
    ("bars", lambda title, rows: bar_chart(title, [(str(r[0]), r[1]) for r in rows])),
    ("periods", lambda title, rows: bar_chart(title, rows)),
    ("hours", lambda title, rows: bar_chart(title, [(str(r[0]), r[1]) for r in rows])),
    ("target", lambda title, rows: bar_chart(title, sorted((str(r[0]), r[1]) for r in rows)) if rows and len(rows[0]) == 2 else histogram_chart(title, rows)),
    ("scatter", lambda title, data: dot_chart(title, data["points"], data["log"])),
    ("qq", lambda title, data: "".join(dot_chart(f"{title}, {when}", points) for when, points in data.items())),
    ("correlations", heat_chart),
    ("associations", heat_chart),
    ("missing", lambda title, mask: missing_chart(mask)),
    ("pair_plot", lambda title, data: pair_grid(title, data["columns"], data["rows"], data["log"])),
]


def drawings(svg: str) -> list[str]:
    """The drawings of a chart as files of their own."""
    return [x.replace("<svg ", '<svg xmlns="http://www.w3.org/2000/svg" ', 1) + "</svg>" for x in svg.split("</svg>") if x.strip()]


def chart(name: str, data: Any) -> str:
    draw = next((f for start, f in DRAWN if name.startswith(start)), None)
    return draw(name.replace("_", " "), data) if draw and data else ""


def contents(sections: list[str]) -> str:
    """Links to the sections that there are."""
    found = [re.match(r'<section id="([^"]*)"><h2>(.*?)</h2>', x) for x in sections if x]
    return "<ul>" + "".join(f'<li><a href="#{m[1]}">{m[2]}</a></li>' for m in found if m) + "</ul>"


def page(a: Analysis, name: str, run_id: str) -> str:
    q, o, t, m = a.quality, a.outliers, a.target, a.collinearity
    missing = sum(p or 0 for p in q.missing_per_column.values()) / max(1, len(q.missing_per_column))
    out = [section("Alerts", "".join(f'<p class="{x.severity}"><b>{escape(x.severity)}</b> {escape(x.message)}. {escape(x.recommendation)}.</p>' for x in q.alerts))]
    out.append(section("Failed steps", "".join(f"<p>{escape(s)}</p>" for s in a.failed)))
    out.append(section("Summary", table(["rows", "columns", "numbers", "categories", "missing %", "repeated rows"], [[a.rows, len(a.types), len(a.numbers), len(a.of("categorical", "boolean")), missing, q.duplicates]])))
    columns = sorted(q.missing_per_column.items(), key=lambda x: -(x[1] or 0))[:TOP]
    body = table(["column", "type", "missing %"], [[c, LABELS.get(a.types.get(c, ""), ""), p] for c, p in columns])
    for title, names in (("one value", q.constant_columns), ("nearly one value", list(q.quasi_constant_columns))):
        body += f"<p>Columns of {title}: <code>{escape(list_text(names))}</code></p>" if names else ""
    out.append(section("Data quality", body))
    if a.preview:
        out.append(section("First rows", table(list(a.preview[0]), [list(r.values()) for r in a.preview])))
    body = table(["column", "mean", "median", "std", "min", "max", "skewness", "missing"], [[r[k] for k in ("column", "mean", "median", "std", "min", "max", "skewness", "missing")] for r in a.numeric.values()])
    body += table(["column", "distinct", "mode", "missing"], [[r["column"], r["nunique"], r["mode"], r["missing"]] for r in a.categorical.values()])
    body += table(["column", "earliest", "latest", "peak hour"], [[c, r["earliest"], r["latest"], r["peak_hour"]] for c, r in a.time.items()])
    body += table(["column", "from", "to", "days", "frequency"], [[c, r["min_date"], r["max_date"], r["n_days"], r["frequency"]] for c, r in a.datetime.items()])
    body += table(["column", "distinct", "mean length", "longest"], [[c, r["nunique"], r["mean_length"], r["max_length"]] for c, r in a.text.items()])
    out.append(section("Column by column", body))
    body = table(["column", "column ", "r", "p"], [[r["var1"], r["var2"], r["r"], p_value(r["p"])] for r in a.numeric_pairs[:TOP]])
    body += table(["column", "column ", "Cramér's V"], [[r["var1"], r["var2"], r["cramers_v"]] for r in a.categorical_pairs[:TOP]])
    body += table(["category", "number", "adjusted η"], [[r["category"], r["number"], r["adjusted_eta"]] for r in a.mixed_pairs[:TOP]])
    out.append(section("Relationships", body))
    if o:
        body = f"<p>{o.union_count} rows are flagged by some method; {o.forest_count} by the isolation forest ({escape(o.forest_note)}).</p>"
        body += table(["column", "by IQR", "by MAD", "note"], [[c, o.iqr_counts.get(c), o.mad_counts.get(c), f.note] for c, f in o.fences.items()])
        out.append(section("Outliers", body))
    if t:
        body = table(["class", "rows", "share"], [[c, n, t.balance.shares[c]] for c, n in t.balance.counts.items()]) if t.balance else ""
        body += table(["feature", "test", "statistic", "p", "effect"], [[r.feature, r.test, r.statistic, p_value(r.p), r.effect] for r in t.relations[:TOP]])
        body += "".join(f"<p class=high>{escape(x)}</p>" for x in t.leakage)
        out.append(section("Target", body))
    body = ""
    if m:
        body += f"<p>{escape(m.note)}</p>" if m.note else ""
        body += "".join(f"<p><code>{escape(c.equation)}</code> on {c.rows} of {c.rows_checked} rows</p>" for c in m.exact)
        body += table(["column", "VIF", "explained by"], [[c, vif_text(v), ", ".join(m.partners.get(c, []))] for c, v in sorted(m.vif.items(), key=lambda x: -x[1])])
        body += table(["drop", "VIF", "explained by"], [[d.column, vif_text(d.vif), ", ".join(d.explained_by)] for d in m.drops])
        body += table(["VIF after the drops", ""], [[c, vif_text(v)] for c, v in m.vif_after.items()])
    out.append(section("Multicollinearity", body))
    body = "".join(f"<p>{escape(k)}: {escape(v)}</p>" for k, v in a.chart_notes.items()) + "".join(chart(k, v) for k, v in a.charts.items())
    out.append(section("Charts", body + ("" if "missing" in a.charts else "<p>No cell is missing.</p>")))
    out.append(section("Preprocessing plan", "".join(f"<h3>{escape(label)}</h3>" + table(["column", "action", "evidence"], [[r.column or "all", r.action, r.evidence] for r in rows]) for _, label, rows in by_step(a.recommendations))))
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{escape(name)}</title><style>{STYLE}</style></head><body><h1>{escape(name)}</h1><p>Run {escape(run_id)}</p>{contents(out)}{"".join(out)}</body></html>'
