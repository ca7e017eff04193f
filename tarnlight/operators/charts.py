"""The numbers behind charts, as small tables: bins, boxes, bars, shares, samples and calendars."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, number
from ..functions.quantiles import exact_quantiles
from .relationships import eta_pairs, pearson_pairs

#: Bins, categories, seed and the rows, columns, periods and classes that charts take.
BINS, TOP, SEED = 30, 20, 42
SCATTER_ROWS, MASK_ROWS, PAIR_ROWS, PAIR_COLUMNS, PERIODS = 1000, 500, 2000, 6, 120
PIE_LEAST, PIE_MOST, PIE_LABEL = 2, 6, 0.05
CALENDARS = 5  # date columns drawn
BAR_CLASSES, BAR_TOP = 12, 9


def sample(df: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """n rows, those with the lowest hash of their cells: the same rows on every run, however they are partitioned."""
    cells = [col(c).cast("string") for c in df.columns]
    return df.withColumn("__h", F.xxhash64(*cells, F.lit(seed))).orderBy("__h", *cells).limit(n).drop("__h")


def histogram(df: DataFrame, column: str, bins: int = BINS, x: Column | None = None) -> DataFrame:
    """bin (from 0), low, high, n: equal bins from the least value to the greatest, empty ones too."""
    v = x if x is not None else number(column)
    one = df.select(v.alias("x")).where("x IS NOT NULL")
    low, high = one.agg(F.min("x"), F.max("x")).first()
    spark = df.sparkSession
    if low is None:
        return spark.createDataFrame([], "bin int, low double, high double, n long")
    width = (high - low) / bins or 1.0
    seen = one.select(F.least(F.lit(bins - 1), F.floor((F.col("x") - low) / width)).cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(seen, "bin", "left").select("bin", (low + F.col("bin") * width).alias("low"), (low + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def boxes(df: DataFrame, columns: list[str], multiplier: float = 1.5) -> DataFrame:
    """column, q25, median, q75, low_whisker, high_whisker: whiskers end at the last values within the fences."""
    quarts = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns})
    some = [c for c in columns if quarts[c][0] is not None]
    aggs = []
    for i, c in enumerate(some):
        a, _, b = quarts[c]
        x, reach = number(c), multiplier * (b - a)
        aggs += [F.min(F.when(x >= a - reach, x)).alias(f"l_{i}"), F.max(F.when(x <= b + reach, x)).alias(f"h_{i}")]
    row = df.agg(*aggs).first() if aggs else None
    return df.sparkSession.createDataFrame([(c, *quarts[c], row[f"l_{i}"], row[f"h_{i}"]) for i, c in enumerate(some)], "column string, q25 double, median double, q75 double, low_whisker double, high_whisker double")


def class_boxes(df: DataFrame, column: str, target: str, most: int = BAR_CLASSES) -> DataFrame:
    """boxes() of a numeric column within each class of the target, for up to `most` classes; `column` names the class."""
    classes = [r["category"] for r in counts(df, target).orderBy("category").limit(most + 1).collect()]
    if not classes or len(classes) > most:
        return boxes(df, [])
    each = df.select(*(F.when(col(target).cast("string") == F.lit(c), number(column)).alias(f"c{i}") for i, c in enumerate(classes)))
    name = F.array(*map(F.lit, classes))
    return boxes(each, each.columns).withColumn("column", F.get(name, F.substring("column", 2, 10).cast("int")))


def target_distribution(df: DataFrame, target: str, kind: str) -> DataFrame:
    """counts() of a target of classes, histogram() of another."""
    return counts(df, target) if kind == "classification" else histogram(df, target)


def counts(df: DataFrame, column: str) -> DataFrame:
    return df.select(col(column).cast("string").alias("category")).where("category IS NOT NULL").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def bars(df: DataFrame, column: str, top: int = TOP) -> DataFrame:
    """category, n: the most frequent values (ties by value), and the rest as Other."""
    c = counts(df, column)
    best = c.orderBy(F.desc("n"), "category").limit(top).select(F.col("category").alias("b"))
    folded = c.join(F.broadcast(best), F.col("category") == F.col("b"), "left")
    return folded.groupBy(F.when(F.col("b").isNotNull(), F.col("category")).otherwise("Other").alias("category")).agg(F.sum("n").alias("n"))


def shares(df: DataFrame, column: str) -> DataFrame:
    """category, n, share of the values that aren't null."""
    c = counts(df, column)
    return c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("t")))).select("category", "n", (F.col("n") / F.col("t")).alias("share"))


def share_text(share: float) -> str:
    return "<0.1 %" if 0 < share < 0.001 else f"{share * 100:.1f} %"


def class_bars(df: DataFrame, column: str, target: str, top: int = BAR_TOP) -> DataFrame:
    """class, category, n: the top categories and Other, by class of the target."""
    both = df.select(col(target).cast("string").alias("class"), col(column).cast("string").alias("category")).dropna()
    best = both.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category").limit(top).select(F.col("category").alias("b"))
    folded = both.groupBy("class", "category").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(best), F.col("category") == F.col("b"), "left")
    return folded.groupBy("class", F.when(F.col("b").isNotNull(), F.col("category")).otherwise("Other").alias("category")).agg(F.sum("n").alias("n"))


def class_order(classes: list[str]) -> list[str]:
    """Classes that are all numbers by number, else by text."""
    try:
        return sorted(classes, key=float)
    except ValueError:
        return sorted(classes)


def scatter(df: DataFrame, a: str, b: str, rows: int = SCATTER_ROWS) -> DataFrame:
    return sample(df.select(number(a).alias("x"), number(b).alias("y")).dropna(), rows)


def missing_mask(df: DataFrame, rows: int = MASK_ROWS) -> DataFrame:
    """For a sample of rows, whether each cell is missing; no row where no cell of the table is."""
    mask = sample(df, rows).select(*(col(c).isNull().alias(c) for c in df.columns))
    holes = df.select(F.greatest(*(col(c).isNull().cast("int") for c in df.columns), F.lit(0)).alias("h")).where("h > 0").limit(1)
    return mask.join(F.broadcast(holes.select(F.lit(True).alias("__any"))), F.lit(True)).drop("__any")


def rows_per_period(df: DataFrame, column: str, unit: str | None = None, most: int = PERIODS) -> DataFrame:
    """period (date), n: rows by calendar period, empty periods too.

    Without a unit, the finest of day, week, month and year with at most `most` periods. Weeks begin on Mondays.
    """
    x = F.to_date(col(column))
    spark = df.sparkSession
    low, high = df.agg(F.min(x), F.max(x)).first()
    if low is None:
        return spark.createDataFrame([], "period date, n long")
    if unit is None:
        days = (high - low).days
        spans = {"day": days + 1, "week": days // 7 + 1, "month": (high.year - low.year) * 12 + high.month - low.month + 1}
        unit = next((u for u, n in spans.items() if n <= most), "year")
    start = lambda d: F.to_date(F.date_trunc(unit, d))
    seen = df.select(start(x).alias("period")).where("period IS NOT NULL").groupBy("period").agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(1).select(F.explode(F.sequence(start(F.lit(low)), start(F.lit(high)), F.expr(f"interval 1 {unit}"))).alias("period"))
    return every.join(seen, "period", "left").select("period", F.coalesce("n", F.lit(0)).alias("n"))


def strongest_pairs(df: DataFrame, pairs: list[tuple[str, str]], k: int) -> DataFrame:
    """var1, var2, r of the k pairs with the greatest |r|; undefined ones don't count."""
    return pearson_pairs(df, pairs).where("r IS NOT NULL").orderBy(F.desc(F.abs("r")), "var1", "var2").limit(k).select("var1", "var2", "r")


@dataclass
class PairPlot:
    columns: list[str]
    hue: str | None = None
    log: list[str] = field(default_factory=list)
    rows: int = PAIR_ROWS


def choose_pair_plot(df: DataFrame, types: dict[str, str], categorical: list[str], target: str | None = None, target_kind: str | None = None, log: dict[str, bool] | None = None) -> PairPlot | None:
    """Up to six continuous columns by their strongest correlation, and a column to colour by; None under three."""
    names = [c for c in df.columns if types.get(c) == "numeric_continuous" and c != target]
    if len(names) < 3:
        return None
    best = dict.fromkeys(names, 0.0)
    for r in pearson_pairs(df, [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]).collect():
        for c in (r["var1"], r["var2"]):
            best[c] = max(best[c], abs(r["r"] or 0.0))
    chosen = set(sorted(names, key=lambda c: (-best[c], names.index(c)))[:PAIR_COLUMNS])
    columns = [c for c in names if c in chosen]

    def usable(c: str) -> bool:
        got = counts(df, c).orderBy(F.asc("n")).limit(PIE_MOST + 1).collect()
        return PIE_LEAST <= len(got) <= PIE_MOST and got[0]["n"] >= 10

    hue = target if target and target_kind == "classification" and usable(target) else None
    if hue is None:
        fit = [c for c in categorical if c in df.columns and c != target and usable(c)]
        mean: dict[str, list[float]] = {}
        for r in eta_pairs(df, fit, columns).collect():
            mean.setdefault(r["category"], []).append(r["adjusted_eta"] or 0.0)
        ranked = sorted(((sum(v) / len(v), -fit.index(c), c) for c, v in mean.items()), reverse=True)
        if ranked and ranked[0][0] >= 0.25:
            hue = ranked[0][2]
    return PairPlot(columns, hue, [c for c in columns if (log or {}).get(c)])


def choose_columns(columns: list[str], most: int, target: str | None = None, effects: dict[str, float] | None = None) -> tuple[list[str], str]:
    """(columns of a chart in the table's order, a note if some are left out).

    With a target, it stays and the columns with the strongest effects on it; otherwise the first ones do.
    """
    if len(columns) <= most:
        return list(columns), ""
    if target and effects is not None:
        order = sorted(columns, key=lambda c: (c != target, -effects.get(c, -1.0), columns.index(c)))
        some = set(order[:most])
        return [c for c in columns if c in some], f"the {most} of {len(columns)} columns most related to {target}"
    return list(columns[:most]), f"the first {most} of {len(columns)} columns"


def frame_of_period(df: DataFrame, columns: list[str], most: int = 5) -> dict[str, DataFrame]:
    """rows_per_period of the first date columns with two dates or more."""
    out = {}
    for c in columns[:most]:
        if df.agg(F.count_distinct(F.to_date(col(c)))).first()[0] > 1:
            out[c] = rows_per_period(df, c)
    return out

