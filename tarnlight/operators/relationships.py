"""Associations between pairs of columns; each pair uses the rows where both columns have a value."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, number, ratio, stacked
from ..functions.distributions import chi2_tail, correlation_p
from ..functions.quantiles import _wide, running, small

#: Weakest association shown; rows of a pair; columns of a matrix.
FLOOR, LEAST_ROWS, MOST_COLUMNS = 0.05, 3, 30
PER_PASS = 150  # sums in one aggregate, to keep generated code small


def pearson_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """var1, var2, n, r: r is null under 3 rows or where a column is constant on the pair's rows.

    A first pass gives each column's mean, extremes and number of values; a second one sums what is left of them. A pair of
    columns without nulls adds one sum of products of its own; what else it needs is shared by all pairs of a column.
    """
    spark = df.sparkSession
    names = list(dict.fromkeys(c for pair in pairs for c in pair))
    if not names:
        return spark.createDataFrame([], "var1 string, var2 string, n long, r double")
    got = _wide(df, [F.count(F.lit(1)), *(f(number(c).cast("double")) for c in names for f in (F.count, F.avg, F.min, F.max))])
    rows, known = got[0], {c: got[1 + 4 * i : 5 + 4 * i] for i, c in enumerate(names)}
    off = {c: number(c).cast("double") - F.lit(float(known[c][1] or 0.0)) for c in names}
    full = [c for c in names if known[c][0] == rows]
    sums: dict[tuple[str, ...], list[Column]] = {(c,): [F.sum(off[c]), F.sum(off[c] * off[c])] for c in full}
    for a, b in pairs:
        if a in full and b in full:
            sums[a, b] = [F.sum(off[a] * off[b])]
        else:
            both = off[a].isNotNull() & off[b].isNotNull()
            x, y = F.when(both, off[a]), F.when(both, off[b])
            sums[a, b] = [F.count(x), F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * y), F.sum(x * y), F.min(x), F.max(x), F.min(y), F.max(y)]
    values = iter(_wide(df, [f for fs in sums.values() for f in fs], PER_PASS))
    found = {k: [next(values) for _ in fs] for k, fs in sums.items()}
    out = []
    for a, b in pairs:
        if a in full and b in full:
            (x, xx), (y, yy), (xy,) = found[a,], found[b,], found[a, b]
            n, flat = rows, known[a][2] == known[a][3] or known[b][2] == known[b][3]
        else:
            n, x, y, xx, yy, xy, lo, hi, low, high = found[a, b]
            flat = lo == hi or low == high
        r = None
        if n >= LEAST_ROWS and not flat:
            spread = (xx - x * x / n) * (yy - y * y / n)
            r = max(-1.0, min(1.0, (xy - x * y / n) / math.sqrt(spread))) if spread > 0 else None
        out.append((a, b, n, r))
    return spark.createDataFrame(out, "var1 string, var2 string, n long, r double")


def numeric_correlations(df: DataFrame, columns: list[str], floor: float = FLOOR) -> DataFrame:
    """Pairs with |r| above the floor, the strongest first."""
    return pearson_pairs(df, list(combinations(columns, 2))).where(F.abs("r") > floor).orderBy(F.desc(F.abs("r")), "var1", "var2")


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """var1, var2, r for every ordered pair, and 1 on the diagonal of columns with spread."""
    half = pearson_pairs(df, list(combinations(columns, 2))).select("var1", "var2", "r")
    spread = [{"var1": F.lit(c), "var2": F.lit(c), "r": F.when((F.col(f"n_{i}") >= LEAST_ROWS) & (F.col(f"s_{i}") > 0), F.lit(1.0))} for i, c in enumerate(columns)]
    diagonal = stacked(df.agg(*(f for i, c in enumerate(columns) for f in (F.count(number(c)).alias(f"n_{i}"), F.stddev_pop(number(c)).alias(f"s_{i}")))), spread)
    return half.unionByName(half.select(F.col("var2").alias("var1"), F.col("var1").alias("var2"), "r")).unionByName(diagonal)


def ranked(df: DataFrame, columns: list[str]) -> DataFrame:
    """Average ranks of the columns as r_<i>, from value counts.

    A running count over the distinct values of a column gives their ranks, and is joined back on the value; only
    the distinct values of a column are ordered in one place.
    """
    out = df
    for i, c in enumerate(columns):
        counts = df.groupBy(col(c).alias("__v")).agg(F.count(F.lit(1)).alias("__n")).where("__v IS NOT NULL")
        counts = running(counts, "__v", "__n").select("__v", (F.col("upto") - (F.col("__n") - 1) / 2).alias(f"r_{i}"))
        out = out.join(counts, col(c) == F.col("__v"), "left").drop("__v")
    return out


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """var1, var2, n, rho: Pearson over average ranks."""
    both = df.select(number(a).alias("x"), number(b).alias("y")).dropna()
    got = pearson_pairs(ranked(both, ["x", "y"]), [("r_0", "r_1")])
    return got.select(F.lit(a).alias("var1"), F.lit(b).alias("var2"), "n", F.col("r").alias("rho"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """x, y, n of the pair's combinations that occur."""
    return df.select(col(a).cast("string").alias("x"), col(b).cast("string").alias("y")).dropna().groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


def cramers_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """var1, var2, n, r, k (categories of each), chi2, chi2_yates (corrected on a 2 by 2 table), cramers_v of each pair.

    One count of all pairs' combinations; an empty cell adds its expectation: chi2 = n (sum o*o / (row*column) - 1).
    V is bias-corrected (Bergsma): null under 2 rows or categories, 0 where chance explains all.
    """
    if not pairs:
        return df.sparkSession.createDataFrame([], "var1 string, var2 string, n long, r long, k long, chi2 double, chi2_yates double, cramers_v double")
    cell = F.array(*(F.struct(F.lit(i).alias("p"), col(a).cast("string").alias("x"), col(b).cast("string").alias("y")) for i, (a, b) in enumerate(pairs)))
    cells = df.select(F.inline(cell)).where("x IS NOT NULL AND y IS NOT NULL").groupBy("p", "x", "y").agg(F.count(F.lit(1)).alias("o"))
    rows, cols = cells.groupBy("p", "x").agg(F.sum("o").alias("row")), cells.groupBy("p", "y").agg(F.sum("o").alias("column"))
    per = rows.groupBy("p").agg(F.sum("row").alias("n"), F.count(F.lit(1)).alias("r"), F.sum(1.0 / F.col("row")).alias("ir"))
    per = per.join(cols.groupBy("p").agg(F.count(F.lit(1)).alias("k"), F.sum(1.0 / F.col("column")).alias("ic")), "p")
    both = cells.join(rows, ["p", "x"]).join(cols, ["p", "y"]).join(per, "p")
    e = F.col("row") * F.col("column").cast("double")
    sums = both.groupBy("p").agg(F.sum(F.col("o") * F.col("o").cast("double") / e).alias("s"), F.max(F.abs(F.col("o") - e / F.col("n"))).alias("gap")).join(per, "p")
    n, r, k = F.col("n"), F.col("r"), F.col("k")
    chi2 = F.greatest(F.lit(0.0), n * (F.col("s") - 1))
    # in a 2 by 2 table |observed - expected| is the same in all cells, and 1/expected sums to n (sum 1/row)(sum 1/column)
    yates = F.when((r == 2) & (k == 2), F.pow(F.greatest(F.lit(0.0), F.col("gap") - 0.5), 2) * n * F.col("ir") * F.col("ic")).otherwise(chi2)
    phi2 = F.greatest(F.lit(0.0), chi2 / n - ratio((k - 1.0) * (r - 1.0), n - 1.0))
    less = lambda m: m - ratio((m - 1.0) * (m - 1.0), n - 1.0)
    denom = F.least(less(k) - 1, less(r) - 1)
    v = F.when((n >= 2) & (r >= 2) & (k >= 2), F.when(denom <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.sqrt(ratio(phi2, denom)))))
    name = F.array(*(F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2")) for a, b in pairs))
    return sums.select(F.get(name, F.col("p"))["var1"].alias("var1"), F.get(name, F.col("p"))["var2"].alias("var2"), n, r, k, chi2.alias("chi2"), yates.alias("chi2_yates"), v.alias("cramers_v"))


def eta_pairs(df: DataFrame, categories: list[str], numbers: list[str]) -> DataFrame:
    """category, number, n, g (groups), eta, adjusted_eta: one count of groups for each category covers all numbers.

    eta = sqrt(between / total sum of squares), null where the total is 0 or under 2 rows; the adjusted one takes out
    what g groups explain by chance, and is 0 with as many groups as rows.
    """
    out = None
    for c in categories:
        some = [x for x in numbers if x != c]
        if not some:
            continue
        # sums are centred on the column's own mean, as squares of large values would lose digits
        means = df.agg(*(F.avg(F.when(col(c).isNotNull(), number(x))).alias(f"m_{i}") for i, x in enumerate(some)))
        centred = df.select(col(c).cast("string").alias("__g"), *(number(x).alias(f"x_{i}") for i, x in enumerate(some))).where("__g IS NOT NULL").crossJoin(F.broadcast(means))
        dev = [F.col(f"x_{i}") - F.col(f"m_{i}") for i in range(len(some))]
        groups = centred.groupBy("__g").agg(*(f for i, d in enumerate(dev) for f in (F.count(d).alias(f"n_{i}"), F.sum(d).alias(f"s_{i}"), F.sum(d * d).alias(f"q_{i}"))))
        aggs, rows = [], []
        for i, x in enumerate(some):
            n, s, q = F.col(f"n_{i}"), F.col(f"s_{i}"), F.col(f"q_{i}")
            aggs += [F.sum(n).alias(f"n_{i}"), F.count_if(n > 0).alias(f"g_{i}"), F.sum(ratio(s * s, n)).alias(f"b_{i}"), F.sum(s).alias(f"s_{i}"), F.sum(q).alias(f"q_{i}")]
            shift = ratio(s * s, n)
            total = q - shift
            eta2 = F.when(n >= 2, F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(f"b_{i}") - shift) / total))))
            g = F.col(f"g_{i}")
            adjusted = F.when(eta2.isNotNull(), F.when(n <= g, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), 1 - (1 - eta2) * ratio(n - 1.0, n - g)))))
            rows.append({"category": F.lit(c), "number": F.lit(x), "n": F.coalesce(n, F.lit(0)), "g": g, "eta": F.sqrt(eta2), "adjusted_eta": adjusted})
        got = stacked(groups.agg(*aggs), rows)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else df.sparkSession.createDataFrame([], "category string, number string, n long, g long, eta double, adjusted_eta double")


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """n, groups, h: Kruskal-Wallis, corrected for ties; null with fewer than two groups or one value."""
    both = df.select(col(group).cast("string").alias("g"), number(value).alias("x")).dropna()
    counts = both.groupBy("x").agg(F.count(F.lit(1)).alias("t"))
    rank = running(counts, "x", "t").select("x", (F.col("upto") - (F.col("t") - 1) / 2).alias("rank"))
    ties = counts.agg(F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("ties"))
    sums = both.groupBy("g", "x").agg(F.count(F.lit(1)).alias("n")).join(rank, "x").groupBy("g").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("s"))
    n = F.col("n").cast("double")
    one = sums.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q")).crossJoin(ties)
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / F.nullif(1 - F.try_divide(F.col("ties"), n * n * n - n), F.lit(0.0))
    return one.select(F.lit(group).alias("group"), F.lit(value).alias("value"), F.coalesce("n", F.lit(0)).alias("n"), "groups", F.when((F.col("groups") >= 2) & (F.col("n") >= 2), h).alias("h"))


def kruskal_many(df: DataFrame, group: str, numbers: list[str]) -> DataFrame:
    """kruskal() of many columns by one group. One shuffle counts the values of all; where those counts are many, each column
    is ranked by itself inside cuts."""
    spark = df.sparkSession
    if not numbers:
        return spark.createDataFrame([], "`group` string, value string, n long, groups long, h double")
    cell = F.array(*(F.struct(F.lit(i).alias("i"), number(c).cast("double").alias("x")) for i, c in enumerate(numbers)))
    cells = df.select(col(group).cast("string").alias("g"), F.inline(cell)).where("g IS NOT NULL AND x IS NOT NULL").groupBy("i", "x", "g").agg(F.count(F.lit(1)).alias("n"))
    if not small(df):
        return reduce(DataFrame.unionByName, [kruskal(df, group, c) for c in numbers])
    by_value = Window.partitionBy("i", "x")
    ranked = cells.withColumn("t", F.sum("n").over(by_value)).withColumn("first", F.row_number().over(by_value.orderBy("g")) == 1)
    upto = F.sum(F.when(F.col("first"), F.col("t")).otherwise(0)).over(Window.partitionBy("i").orderBy("x"))  # a window of counts, of a table that is small
    ranked = ranked.withColumn("rank", upto - (F.col("t") - 1) / 2)
    tie = F.when(F.col("first"), F.pow(F.col("t").cast("double"), 3) - F.col("t"))
    sums = ranked.groupBy("i", "g").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("s"), F.sum(tie).alias("ties"))
    one = sums.groupBy("i").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"), F.sum("ties").alias("ties"))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / F.nullif(1 - F.try_divide(F.col("ties"), n * n * n - n), F.lit(0.0))
    return one.select(F.lit(group).alias("group"), F.get(F.array(*map(F.lit, numbers)), F.col("i")).alias("value"), "n", "groups", F.when((F.col("groups") >= 2) & (F.col("n") >= 2), h).alias("h"))


def kruskal_p(h: float | None, groups: int) -> float | None:
    return None if h is None else chi2_tail(h, groups - 1)


def association_matrix(df: DataFrame, numeric: list[str], categorical: list[str], columns: list[str] | None = None, most: int = MOST_COLUMNS) -> dict[tuple[str, str], float]:
    """(a, b) -> Pearson, Cramer's V or adjusted eta, by the columns' kinds; undefined ones are 0, the diagonal 1.

    A column in both lists counts as a number. Without `columns`, the first `most` in the table's order.
    """
    nums, cats = set(numeric), set(categorical)
    columns = [c for c in (columns or df.columns) if c in nums or c in cats]
    if not columns:
        return {}
    columns = columns[:most] if most else columns
    x, y = [c for c in columns if c in nums], [c for c in columns if c not in nums]
    out = {(c, c): 1.0 for c in columns}
    found = [(r["var1"], r["var2"], r["r"]) for r in pearson_pairs(df, list(combinations(x, 2))).collect()]
    found += [(r["var1"], r["var2"], r["cramers_v"]) for r in cramers_pairs(df, list(combinations(y, 2))).collect()]
    found += [(r["category"], r["number"], r["adjusted_eta"]) for r in eta_pairs(df, y, x).collect()]
    for a, b in combinations(columns, 2):
        out[a, b] = out[b, a] = 0.0
    for a, b, v in found:
        out[a, b] = out[b, a] = float(v) if v is not None and v == v else 0.0
    return {(a, b): out[a, b] for a in columns for b in columns}


def with_p(rows: list) -> list[dict]:
    """pearson_pairs' rows with their two-sided p."""
    return [{**r.asDict(), "p": correlation_p(r["r"], r["n"])} for r in rows]
