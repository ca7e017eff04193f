"""A preprocessing plan from what was measured: each step with its evidence."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from ..operators.quality import QualityReport
from ..operators.shape import Transform, TransformReport, verdict_text

#: The steps in their order, and the limits of their rules.
STEPS = {"convert": "Convert", "drop": "Drop", "impute": "Fill gaps", "encode": "Encode", "transform": "Transform", "scale": "Scale"}
MISSING_PCT, REDUNDANT, REDUNDANT_PAIRS = 60.0, 0.95, 15
MEAN_MEDIAN_GAP, MODE_PCT = 0.10, 5.0
ONE_HOT, ONE_HOT_ALWAYS, ROWS_PER_COLUMN, RARE_PCT = 15, 3, 20, 1.0
STD_RATIO, ROBUST_RATIO = 10.0, 2.0


@dataclass
class Recommendation:
    step: str
    column: str | None
    action: str
    evidence: str


def show(x: float | None) -> str:
    if x is None or not math.isfinite(x):
        return "-"
    return f"{x:,.0f}".replace(",", " ") if abs(x) >= 1000 else f"{x:.2f}" if abs(x) >= 1 else f"{x:.3g}"


def drops(types: dict[str, str], q: QualityReport, target: str | None) -> list[Recommendation]:
    out = []
    if q.duplicates:
        out.append(Recommendation("drop", None, "Remove repeated rows", f"{q.duplicates} of {q.rows} rows repeat an earlier one"))
    if target and (pct := q.missing_per_column.get(target) or 0) > 0:
        out.append(Recommendation("drop", target, "Remove rows without a target", f"{pct:.1f}% of the rows have none"))
    for c, kind in types.items():
        if c == target:
            continue
        missing = q.missing_per_column.get(c) or 0.0
        if missing >= MISSING_PCT:
            out.append(Recommendation("drop", c, "Remove the column", f"{missing:.1f}% of it is missing"))
        elif c in q.constant_columns or kind == "constant":
            out.append(Recommendation("drop", c, "Remove the column", "it has a single value"))
        elif c in q.quasi_constant_columns:
            out.append(Recommendation("drop", c, "Remove the column", f"one value fills {q.quasi_constant_columns[c]:.1f}% of the rows"))
        elif kind == "identifier":
            out.append(Recommendation("drop", c, "Leave it out of the model", "it names rows and says nothing about them"))
    return out


def conversions(types: dict[str, str], q: QualityReport, present: dict[str, int], skip: set[str]) -> list[Recommendation]:
    return [Recommendation("convert", c, "Convert it to numbers and analyse again", f"{n} of {present.get(c, n)} values are numbers kept as text") for c, n in q.numeric_as_text.items() if c not in skip and types.get(c) in ("categorical", "boolean", "text")]


def redundant(correlations: dict[tuple[str, str], float], skip: set[str]) -> list[Recommendation]:
    strong = sorted(((abs(r), a, b, r) for (a, b), r in correlations.items() if a < b and r is not None and abs(r) >= REDUNDANT and not {a, b} & skip), reverse=True)
    return [Recommendation("drop", b, f"Keep one of '{a}' and '{b}'", f"they correlate {r:.3f}") for _, a, b, r in strong[:REDUNDANT_PAIRS]]


def imputations(types: dict[str, str], q: QualityReport, numeric: dict[str, dict], modes: dict[str, tuple[str, float]], skip: set[str], target: str | None) -> list[Recommendation]:
    """modes: column -> (its most frequent value, its share in percent of the values)."""
    out = []
    for c, kind in types.items():
        pct = q.missing_per_column.get(c) or 0.0
        if c in skip or c == target or pct <= 0:
            continue
        if "numeric" in kind:
            s = numeric.get(c)
            if not s or s["median"] is None:
                continue
            gap = abs(s["mean"] - s["median"]) / s["std"] if s["std"] else 0.0
            why = f"the mean ({show(s['mean'])}) lies {gap:.2f} deviations from it, drawn by a tail" if gap >= MEAN_MEDIAN_GAP else f"the mean ({show(s['mean'])}) is {gap:.3f} deviations away, so either would do"
            out.append(Recommendation("impute", c, f"Fill with the median ({show(s['median'])})", f"{pct:.1f}% missing; {why}"))
        elif kind in ("categorical", "boolean") and c in modes:
            value, share = modes[c]
            if pct <= MODE_PCT:
                out.append(Recommendation("impute", c, f"Fill with the most frequent value ('{value[:40]}')", f"{pct:.1f}% missing, and it has {share:.1f}% of the values already"))
            else:
                out.append(Recommendation("impute", c, "Make a category 'Unknown'", f"{pct:.1f}% missing: too much for the most frequent value to take"))
    return out


def encodings(types: dict[str, str], rows: int, categories: dict[str, tuple[int, int, int]], skip: set[str], target: str | None) -> list[Recommendation]:
    """categories: column -> (categories, values, categories under 1% of the values)."""
    out = []
    for c, kind in types.items():
        if c in skip or c == target or kind not in ("categorical", "boolean") or c not in categories:
            continue
        k, present, rare = categories[c]
        if k <= 1:
            continue
        fits = k <= ONE_HOT and (k <= ONE_HOT_ALWAYS or k * ROWS_PER_COLUMN <= rows)
        if k == 2:
            out.append(Recommendation("encode", c, "One column of 0 and 1", "2 categories"))
        elif fits and rare:
            out.append(Recommendation("encode", c, "Put categories under 1% into 'Other', then one-hot", f"{k} categories in {rows} rows, {rare} of them rare"))
        elif fits:
            out.append(Recommendation("encode", c, f"One-hot ({k} columns)", f"{k} categories in {rows} rows, none rare"))
        elif k > ONE_HOT:
            out.append(Recommendation("encode", c, "No one-hot: group rare categories, or encode by frequency", f"{k} categories in {rows} rows"))
        else:
            out.append(Recommendation("encode", c, "No one-hot with so few rows: encode by frequency", f"{k} categories in {rows} rows"))
    return out


def _change(t: Transform) -> str:
    return f"skew {t.skew_before:.2f} to {t.skew_after:.2f}, QQ r {t.qq_before:.3f} to {t.qq_after:.3f}"


#: method -> (advice for a feature, name in the advice for a target, what turns predictions back)
ADVICE = {"log1p": ("log1p", "log1p", "expm1"), "yeo_johnson": ("Yeo-Johnson, with lambda from the training rows", "the Yeo-Johnson transform", "its inverse")}


def transforms(report: TransformReport | None, skip: set[str], target: str | None) -> list[Recommendation]:
    helped = [] if report is None else [t for t in report.columns.values() if t.method and t.column not in skip | {target}]
    out = [Recommendation("transform", t.column, ADVICE[t.method][0], "; ".join([_change(t), *([f"lambda {t.lmbda:.2f}", verdict_text(t, "log1p")] if t.method == "yeo_johnson" else [])])) for t in helped]
    if out:
        out.insert(0, Recommendation("transform", None, "Straighten long tails for linear or distance-based models; trees need none", f"columns that a transform helps: {len(out)}"))
    aim = report.target if report else None
    if aim and aim.method and aim.column not in skip:
        _, name, back = ADVICE[aim.method]
        out.append(Recommendation("transform", aim.column, f"Train on {name} of the target; {back} gives predictions in its own units", _change(aim)))
    return out


@dataclass(frozen=True)
class Spread:
    """What scaling a column depends on."""

    std: float
    iqr: float
    log: bool
    after: Transform | None


#: The first rule that applies: (whether it does, action, evidence).
SCALING: list[tuple[Callable[[Spread], bool], str, Callable[[Spread], str]]] = [
    (lambda s: s.after is not None, "Standard scaling after the transform", lambda s: f"its skew is {s.after.skew_after:.2f} then"),
    (lambda s: s.log, "log10, then standard scaling", lambda s: "its tail fills a linear axis"),
    (lambda s: s.iqr <= 0, "Standard scaling", lambda s: "the middle half of its values is one value (IQR = 0)"),
    (lambda s: s.std > ROBUST_RATIO * s.iqr, "Robust scaling (median and IQR)", lambda s: f"its deviation is {show(s.std / s.iqr)} times its IQR"),
    (lambda s: True, "Standard scaling", lambda s: f"deviation ({show(s.std)}) and IQR ({show(s.iqr)}) agree"),
]


def scalings(types: dict[str, str], numeric: dict[str, dict], log: set[str], skip: set[str], target: str | None, transformed: dict[str, Transform]) -> list[Recommendation]:
    usable = {c: Spread(numeric[c]["std"] or 0.0, numeric[c]["iqr"] or 0.0, c in log, transformed.get(c)) for c, k in types.items() if "numeric" in k and c in numeric and c not in skip | {target}}
    by_size = sorted((c for c in usable if usable[c].std), key=lambda c: usable[c].std)
    if len(by_size) < 2:
        return []
    narrow, wide = by_size[0], by_size[-1]
    ratio = usable[wide].std / usable[narrow].std
    if ratio < STD_RATIO:
        return [Recommendation("scale", None, "No scaling needed", f"the widest, {wide}, spreads {ratio:.1f} times as far as the narrowest, {narrow}")]
    first = Recommendation("scale", None, "Scale for penalties, distances and nets; trees need none", f"{wide} spreads {show(ratio)} times as far as {narrow}")
    rules = ((c, s, next(r for r in SCALING if r[0](s))) for c, s in usable.items())
    return [first, *(Recommendation("scale", c, action, evidence(s)) for c, s, (_, action, evidence) in rules)]


def build(types: dict[str, str], q: QualityReport, *, numeric: dict[str, dict], correlations: dict[tuple[str, str], float], modes: dict[str, tuple[str, float]], categories: dict[str, tuple[int, int, int]], present: dict[str, int], log: set[str] = frozenset(), transform_report: TransformReport | None = None, target: str | None = None) -> list[Recommendation]:
    """The whole plan. What is dropped or waits for conversion sits out the later steps."""
    if not q.rows or not types:
        return []
    gone = drops(types, q, target)
    skip = {r.column for r in gone if r.column and r.column != target}
    change = conversions(types, q, present, skip)
    skip |= {r.column for r in change}
    plan = change + gone + redundant(correlations, skip) + imputations(types, q, numeric, modes, skip, target) + encodings(types, q.rows, categories, skip, target)
    made = transforms(transform_report, skip, target)
    named = {r.column for r in made}
    changed = {c: t for c, t in (transform_report.columns if transform_report else {}).items() if t.method and c in named}
    plan += made + scalings(types, numeric, set(log), skip, target, changed)
    order = list(STEPS)
    return sorted(plan, key=lambda r: order.index(r.step))


def by_step(plan: list[Recommendation]) -> list[tuple[str, str, list[Recommendation]]]:
    return [(s, label, rows) for s, label in STEPS.items() if (rows := [r for r in plan if r.step == s])]
