"""Outliers of single columns by quartile fences and by median deviation, and of whole rows by an isolation forest."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, number
from ..functions.quantiles import exact_quantiles, spread
from .forest import Forest, fit_forest, score

#: Fence multiplier and deviation limit; share of a pinned value; rows that each method needs.
MULTIPLIER, Z = 1.5, 3.0
PINNED_SHARE = 0.25
LEAST_FENCE, LEAST_MAD, LEAST_FOREST = 4, 2, 30


@dataclass
class Fence:
    column: str
    low: float | None = None
    high: float | None = None
    q25: float | None = None
    q75: float | None = None
    pinned: float | None = None
    note: str = ""


@dataclass
class Deviation:
    column: str
    median: float | None = None
    mad: float | None = None
    note: str = ""


def fences(df: DataFrame, columns: list[str], multiplier: float = MULTIPLIER) -> dict[str, Fence]:
    """Tukey's fences of each column.

    Where one value fills at least a quarter of a column and is one of its quartiles, the quartiles are measured
    over the other values, if those have a spread. Without spread, or under 4 values, there is no fence.
    """
    if not columns:
        return {}
    nums = df.select(*(number(c).alias(f"x{i}") for i, c in enumerate(columns)))
    counts = nums.agg(*(F.count(c) for c in nums.columns)).first()
    quarts = exact_quantiles(nums, {c: [0.25, 0.5, 0.75] for c in nums.columns})
    # a value that fills a quarter of a sorted column covers one of these three points, so only they are counted
    same = nums.agg(*(F.count_if(F.col(c) == F.lit(q).cast("double")) for c in nums.columns for q in quarts[c])).first()
    out, again, share_of = {}, {}, {}
    for i, c in enumerate(columns):
        f = out[c] = Fence(c)
        x = f"x{i}"
        if counts[i] < LEAST_FENCE:
            continue
        f.q25, _, f.q75 = quarts[x]
        n, value = max((k, q in (f.q25, f.q75), q) for k, q in zip(same[3 * i : 3 * i + 3], quarts[x]))[::2]
        if n / counts[i] >= PINNED_SHARE and value in (f.q25, f.q75):
            again[c], share_of[c] = (x, value), n / counts[i] * 100
    if again:
        rest = nums.select(*(F.when(F.col(x) != v, F.col(x)).alias(x) for x, v in again.values()))
        quarts = exact_quantiles(rest, {x: [0.25, 0.75] for x, _ in again.values()})
        for c, (x, v) in again.items():
            q25, q75 = quarts[x]
            if q25 is not None and q75 > q25:
                f = out[c]
                f.q25, f.q75, f.pinned, f.note = q25, q75, v, f"quartiles without {v:g}, which fills {share_of[c]:.1f}% of the values"
    for f in out.values():
        if f.q25 is None:
            continue
        if f.q75 == f.q25:
            f.note = "IQR = 0"
        else:
            f.low, f.high = f.q25 - multiplier * (f.q75 - f.q25), f.q75 + multiplier * (f.q75 - f.q25)
    return out


def deviations(df: DataFrame, columns: list[str]) -> dict[str, Deviation]:
    """Median and median absolute deviation; none under 2 values."""
    if not columns:
        return {}
    nums = df.select(*(number(c).alias(f"x{i}") for i, c in enumerate(columns)))
    counts = nums.agg(*(F.count(c) for c in nums.columns)).first()
    some = [x for x, n in zip(nums.columns, counts) if n >= LEAST_MAD]
    median = {x: q[0] for x, q in exact_quantiles(nums, {x: [0.5] for x in some}).items()}
    away = nums.select(*(F.abs(F.col(x) - median[x]).alias(x) for x in some))
    mad = {x: q[0] for x, q in exact_quantiles(away, {x: [0.5] for x in some}).items()}
    out = {}
    for i, c in enumerate(columns):
        x = f"x{i}"
        out[c] = Deviation(c, median.get(x), mad.get(x), "MAD = 0" if mad.get(x) == 0 else "")
    return out


def beyond_fence(f: Fence) -> Column:
    return F.lit(False) if f.low is None else F.coalesce((number(f.column) < f.low) | (number(f.column) > f.high), F.lit(False))


def beyond_deviation(d: Deviation, z: float = Z) -> Column:
    return F.lit(False) if not d.mad else F.coalesce(F.abs(0.6745 * (number(d.column) - d.median) / d.mad) > z, F.lit(False))


@dataclass
class OutlierReport:
    fences: dict[str, Fence]
    deviations: dict[str, Deviation]
    iqr_counts: dict[str, int]
    mad_counts: dict[str, int]
    forest: Forest | None = None
    forest_count: int = 0
    forest_note: str = ""
    union_count: int = 0
    flagged: DataFrame | None = field(default=None, repr=False)  # the table with iqr_<column>, mad_<column>, forest, any


def analyze_outliers(df: DataFrame, columns: list[str], *, multiplier: float = MULTIPLIER, z: float = Z, forest: bool = True, contamination: float | None = None) -> OutlierReport:
    """All methods at once; rows are flagged in place, so no list of rows reaches the driver."""
    dealt = spread(df)
    df = dealt if dealt is df else dealt.persist()  # a small table is read once for all passes
    f, d = fences(df, columns, multiplier), deviations(df, columns)
    out = OutlierReport(f, d, {}, {})
    flags = {f"iqr_{c}": beyond_fence(f[c]) for c in columns} | {f"mad_{c}": beyond_deviation(d[c], z) for c in columns}
    table = df
    forest_flag: Column = F.lit(False)
    if forest and columns:
        complete = df.select(*(number(c).alias(c) for c in columns)).dropna()
        n = complete.count()
        if n < LEAST_FOREST:
            out.forest_note = f"not applied: {n} complete rows, {LEAST_FOREST} are needed"
        else:
            out.forest = fit_forest(complete, columns)
            table = score(df, out.forest, "__forest_score").persist()  # scored once for the cut and for the flags
            s = number("__forest_score")
            if contamination is not None:
                share = min(contamination, 0.5)
                # as many rows as the share says: those over the score of that rank
                cut = exact_quantiles(table, {"__forest_score": [1 - share]})["__forest_score"][0]
                forest_flag, out.forest_note = F.coalesce(s > cut, F.lit(False)), f"the {share:.0%} of rows with the highest scores"
            else:
                q1, q3 = exact_quantiles(table, {"__forest_score": [0.25, 0.75]})["__forest_score"]
                if q3 == q1:
                    out.forest_note = "the scores have no spread: no row is flagged"
                else:
                    cut = q3 + multiplier * (q3 - q1)
                    forest_flag, out.forest_note = F.coalesce(s > cut, F.lit(False)), f"score above {cut:.3f} (Q3 + {multiplier:g} IQR of the scores)"
    flags["forest"] = forest_flag
    union = F.lit(False)
    for x in flags.values():
        union = union | x
    out.flagged = table.withColumns(flags | {"any": union}).drop("__forest_score")
    row = out.flagged.agg(*(F.count_if(col(k)).alias(k) for k in [*flags, "any"])).first()
    out.iqr_counts = {c: row[f"iqr_{c}"] for c in columns}
    out.mad_counts = {c: row[f"mad_{c}"] for c in columns}
    out.forest_count, out.union_count = row["forest"], row["any"]
    if df is dealt and dealt.storageLevel.useMemory and dealt is not table:
        dealt.unpersist()
    return out
