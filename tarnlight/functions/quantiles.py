"""Exact linear-interpolation quantiles of many columns.

A small input takes the engine's exact percentile, which keeps a map of values and counts. On a large one that
map would grow with the data, so each wanted rank is bracketed with mergeable sketches and the bracket is
narrowed in whole passes, until the values inside are few enough to be counted exactly. Both give the same.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .columns import number

DIRECT_BYTES = 32 << 20  # what one task may hold as a map or sort alone
INSIDE = 200_000
ACCURACY = 10_000


def small(df: DataFrame, most: int = DIRECT_BYTES) -> bool:
    """Whether the optimizer's size estimate of df is under the limit."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= most


def spread(df: DataFrame, most: int = 64 << 20) -> DataFrame:
    """A small table dealt over all cores, as one small file is one task; a larger one is left as it is."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if small(df, most) else df


def percentile(x: Column, q: float | list[float]) -> Column:
    return F.percentile(x, F.array(*map(F.lit, q)) if isinstance(q, list) else F.lit(q))


def exact_quantiles(df: DataFrame, wanted: dict[str, list[float]], *, direct: bool | None = None, inside: int = INSIDE, accuracy: int = ACCURACY) -> dict[str, list[float | None]]:
    """For each column its quantiles, None where it has no value. Only these numbers reach the driver."""
    names = list(wanted)
    if not names:
        return {}
    if direct is None:
        direct = small(df)
    if direct:
        row = df.agg(*(percentile(number(c), wanted[c]).alias(str(i)) for i, c in enumerate(names))).first()
        return {c: list(row[i]) if row[i] is not None else [None] * len(wanted[c]) for i, c in enumerate(names)}
    row = df.agg(*(f for c in names for f in (F.count(number(c)), F.min(number(c)), F.max(number(c))))).first()
    count = {c: row[3 * i] for i, c in enumerate(names)}
    # the ranks (from 0) that the quantiles interpolate between, each with its bracket [low, high]
    open_: dict[tuple[str, int], tuple[float, float]] = {}
    for i, c in enumerate(names):
        for p in wanted[c] if count[c] else ():
            at = p * (count[c] - 1)
            for r in (math.floor(at), math.ceil(at)):
                open_[c, r] = (row[3 * i + 1], row[3 * i + 2])
    found: dict[tuple[str, int], float] = {}
    while open_:
        keys = list(open_)
        aggs = []
        for c, r in keys:
            x, (lo, hi) = number(c), open_[c, r]
            aggs += [F.count_if(x < lo), F.count_if((x >= lo) & (x <= hi))]
        got = _wide(df, aggs)
        exact, sketch = [], []
        for k, (c, r) in enumerate(keys):
            lo, hi = open_[c, r]
            if lo == hi:
                found[c, r] = lo
                del open_[c, r]
            else:
                (exact if got[2 * k + 1] <= inside else sketch).append((c, r, got[2 * k], got[2 * k + 1]))
        aggs = []
        for c, r, below, n in exact:
            lo, hi = open_[c, r]
            x = number(c)
            aggs.append(F.percentile(F.when((x >= lo) & (x <= hi), x), F.lit((r - below) / max(1, n - 1))))
        for c, r, below, n in sketch:
            lo, hi = open_[c, r]
            x, p = number(c), (r - below) / max(1, n - 1)
            near = [max(0.0, p - 2 / accuracy), min(1.0, p + 2 / accuracy)]
            aggs.append(F.percentile_approx(F.when((x >= lo) & (x <= hi), x), near, accuracy))
        got = _wide(df, aggs)
        for (c, r, _, _), v in zip(exact, got):
            found[c, r] = v
            del open_[c, r]
        tight = []
        for (c, r, below, n), (lo, hi) in zip(sketch, got[len(exact) :]):
            if (lo, hi) == open_[c, r]:  # one value fills the bracket's ends: it can't be narrowed by a sketch
                lo, hi = open_[c, r]
                mid = lo + (hi - lo) / 2
                tight.append((c, r, below, lo, hi, mid))
            open_[c, r] = (lo, hi)
        if tight:
            got = _wide(df, [f for c, _, _, lo, hi, mid in tight for x in (number(c),) for f in (F.count_if(x <= lo), F.count_if(x <= mid), F.max(F.when(x <= mid, x)), F.min(F.when(x > mid, x)))])
            for k, (c, r, _, lo, hi, _) in enumerate(tight):
                at_low, to_mid, top, next_ = got[4 * k : 4 * k + 4]
                open_[c, r] = (lo, lo) if r < at_low else (lo, top) if r < to_mid else (next_, hi)
    out: dict[str, list[float | None]] = {}
    for c in names:
        out[c] = []
        for p in wanted[c]:
            if not count[c]:
                out[c].append(None)
                continue
            at = p * (count[c] - 1)
            low, high = found[c, math.floor(at)], found[c, math.ceil(at)]
            out[c].append(low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high)
    return out


def _wide(df: DataFrame, aggs: list[Column], most: int = 200) -> list:
    """Values of many aggregates, some at a time to keep generated code small."""
    out: list = []
    for i in range(0, len(aggs), most):
        out += list(df.agg(*(a.alias(f"a{k}") for k, a in enumerate(aggs[i : i + most]))).first())
    return out


def running(counts: DataFrame, x: str, n: str, direct: bool | None = None) -> DataFrame:
    """counts (one row for each value of x) with `upto`: the sum of n over rows with x or less.

    A small table takes one ordered window. A large one is cut at sketch quantiles of x: windows run inside the
    cuts, side by side, and each adds the total of the cuts before it.
    """
    if direct is None:
        direct = small(counts)
    if direct:
        return counts.withColumn("upto", F.sum(n).over(Window.orderBy(x)))
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = counts.agg(F.percentile_approx(F.col(x).cast("double"), [i / parts for i in range(1, parts)], ACCURACY)).first()[0] or []
    splits = F.array(*map(F.lit, sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    cut = counts.withColumn("__cut", F.size(F.filter(splits, lambda s: s < F.col(x))))
    before = cut.groupBy("__cut").agg(F.sum(n).alias("__all"))  # one row for each cut
    before = before.select("__cut", (F.sum("__all").over(Window.orderBy("__cut")) - F.col("__all")).alias("__before"))
    inside = F.sum(n).over(Window.partitionBy("__cut").orderBy(x))
    return cut.withColumn("upto", inside).join(F.broadcast(before), "__cut").withColumn("upto", F.col("upto") + F.col("__before")).drop("__cut", "__before")
