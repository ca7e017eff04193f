"""The seven result tables, as CSV files."""

from __future__ import annotations

import csv
from pathlib import Path
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from .pipeline import Analysis

NUMERIC = ("column", "count", "missing", "mean", "median", "std", "min", "q25", "q75", "max", "iqr", "skewness", "kurtosis", "cv", "zeros", "negatives", "normality_p")


def tables(a: Analysis) -> dict[str, tuple[tuple[str, ...], list[tuple]]]:
    o = a.outliers
    pairs = [(r["var1"], r["var2"], "pearson", r["r"], r["p"]) for r in a.numeric_pairs]
    pairs += [(r["var1"], r["var2"], "cramer_v", r["cramers_v"], None) for r in a.categorical_pairs]
    pairs += [(r["category"], r["number"], "eta", r["adjusted_eta"], None) for r in a.mixed_pairs]
    found = []
    if o:
        found = [(c, "iqr", o.iqr_counts.get(c), f.low, f.high, f.note) for c, f in o.fences.items()]
        found += [(c, "mad", o.mad_counts.get(c), None, None, d.note) for c, d in o.deviations.items()]
        found.append((None, "isolation_forest", o.forest_count, None, None, o.forest_note))
        found.append((None, "any", o.union_count, None, None, ""))
    return {
        "numeric_stats": (NUMERIC, [tuple(r.get(k) for k in NUMERIC) for r in a.numeric.values()]),
        "categorical_stats": (("column", "count", "missing", "nunique", "mode", "mode_frequency"), [tuple(r[k] for k in ("column", "count", "missing", "nunique", "mode", "mode_frequency")) for r in a.categorical.values()]),
        "missing_per_column": (("column", "missing_pct"), list(a.quality.missing_per_column.items())),
        "correlations": (("var1", "var2", "method", "value", "p_value"), pairs),
        "outlier_summary": (("column", "method", "n_outliers", "low", "high", "note"), found),
        "alerts": (("severity", "column", "message", "recommendation"), [(x.severity, x.column, x.message, x.recommendation) for x in a.quality.alerts]),
        "recommendations": (("step", "column", "action", "evidence"), [(r.step, r.column, r.action, r.evidence) for r in a.recommendations]),
    }


def write_tables(a: Analysis, folder: Path) -> list[str]:
    folder.mkdir(parents=True, exist_ok=True)
    out = []
    for name, (head, rows) in tables(a).items():
        path = folder / f"{name}.csv"
        with path.open("w", newline="", encoding="utf-8") as f:
            w = csv.writer(f)
            w.writerow(head)
            w.writerows(rows)
        out.append(str(path))
    return out
