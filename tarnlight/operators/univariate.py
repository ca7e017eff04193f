"""Statistics of single columns: one aggregate over all columns of a kind, and one row of result for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import cell_key, col, number, ratio, stacked, values
from ..functions.distributions import normality_k2, shapiro
from ..functions.quantiles import exact_quantiles, percentile, small

#: Rows of a frequency table; days of a gap and gaps shown; the largest sample of Shapiro-Wilk.
TOP = 20
GAP_DAYS, GAPS = 7, 5
SHAPIRO_ROWS = 5000
MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()


def moments(x: Column) -> dict[str, Column]:
    return {"count": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x), "g1": F.skewness(x), "g2": F.kurtosis(x), "min": F.min(x), "max": F.max(x)}


def adjusted_skewness(n: Column, g1: Column, std: Column) -> Column:
    """The sample skewness G1; 0 for a column without spread, null under 3 values."""
    return F.when(n > 2, F.when(std == 0, 0.0).otherwise(g1 * F.sqrt(n * (n - 1.0)) / (n - 2)))


def adjusted_kurtosis(n: Column, g2: Column, std: Column) -> Column:
    """The sample excess kurtosis G2; 0 for a column without spread, null under 4 values."""
    return F.when(n > 3, F.when(std == 0, 0.0).otherwise((n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * g2 + 6)))


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, count, missing, mean, median, std, min, q25, q75, max, iqr, skewness, kurtosis, cv, zeros, negatives.

    Quartiles interpolate linearly; std, skewness and kurtosis are the sample ones; NaN counts as missing. A column
    without values has nulls. One pass; a large input takes the quartiles from exact_quantiles instead.
    """
    quarts = None if small(df) else exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns}, direct=False)
    aggs, rows = [F.count(F.lit(1)).alias("n")], []
    for i, c in enumerate(columns):
        x = number(c)
        aggs += [f.alias(f"{k}_{i}") for k, f in moments(x).items()]
        if quarts is None:
            aggs.append(percentile(x, [0.25, 0.5, 0.75]).alias(f"q_{i}"))
        aggs += [F.count_if(x == 0).alias(f"zeros_{i}"), F.count_if(x < 0).alias(f"negatives_{i}")]
        get = lambda k, i=i: F.col(f"{k}_{i}")
        q25, q50, q75 = (F.get(get("q"), F.lit(k)) for k in range(3)) if quarts is None else (F.lit(v).cast("double") for v in quarts[c])
        n, std, mean = get("count"), get("std"), get("mean")
        rows.append(
            {
                "column": F.lit(c), "count": n, "missing": F.col("n") - n, "mean": mean, "median": q50, "std": std, "min": get("min"), "q25": q25, "q75": q75, "max": get("max"), "iqr": q75 - q25,
                "skewness": adjusted_skewness(n, get("g1"), std), "kurtosis": adjusted_kurtosis(n, get("g2"), std), "cv": F.when(mean == 0, 0.0).otherwise(ratio(std, mean) * 100), "zeros": get("zeros"), "negatives": get("negatives"),
            }
        )
    return stacked(df.agg(*aggs), rows)


def normality(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """p of Shapiro-Wilk up to 5000 values, of D'Agostino-Pearson beyond; None under 3 values or without spread."""
    if not columns:
        return {}
    aggs = [f.alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in moments(number(c)).items()]
    row = df.agg(*aggs).first()
    out: dict[str, float | None] = {}
    for i, c in enumerate(columns):
        n = row[f"count_{i}"]
        if n < 3 or row[f"min_{i}"] == row[f"max_{i}"]:
            out[c] = None
        elif n > SHAPIRO_ROWS:
            out[c] = normality_k2(n, row[f"g1_{i}"], row[f"g2_{i}"])
        else:  # at most SHAPIRO_ROWS numbers, by the count above
            test = shapiro([r[0] for r in df.select(number(c).alias("x")).where("x IS NOT NULL").collect()])
            out[c] = test and test[1]
    return out


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, n: the counts of every column's values (as text, nulls too), in one shuffle."""
    return values(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, nunique: distinct values that aren't null, by 128-bit keys, so that long texts aren't shuffled."""
    keys = F.array(*(F.struct(F.lit(c).alias("column"), cell_key(c).alias("k")) for c in columns))
    some = df.select(F.inline(keys)).where("k IS NOT NULL").distinct().groupBy("column").agg(F.count(F.lit(1)).alias("nunique"))
    every = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, columns))).alias("column"))
    return every.join(some, "column", "left").select("column", F.coalesce("nunique", F.lit(0)).alias("nunique"))


def frequency_table(df: DataFrame, columns: list[str], top: int = TOP) -> DataFrame:
    """column, rank, value, n: each column's most frequent values; ties by value. Nulls don't count."""
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return value_counts(df, columns).where("value IS NOT NULL").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("column", F.col("rank").cast("long").alias("rank"), "value", "n")


def categorical_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, count, missing, nunique, mode (the smallest of the most frequent values), mode_frequency."""
    counts = value_counts(df, columns)
    top = F.max(F.when(F.col("value").isNotNull(), F.col("n")))
    full = counts.groupBy("column").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("count"), F.count("value").alias("nunique"), top.alias("mode_frequency"), F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("k"), "value"))).alias("best"))
    return full.select("column", "count", (F.col("rows") - F.col("count")).alias("missing"), "nunique", F.coalesce("best.value", F.lit("")).alias("mode"), F.coalesce("mode_frequency", F.lit(0)).alias("mode_frequency"))


def text_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, count, missing, nunique, mean_length, median_length, min_length, max_length, empty_strings.

    Lengths are in characters; numbers have the length of their text. A column without values has zeros.
    """
    aggs, rows = [F.count(F.lit(1)).alias("n")], []
    medians = None if small(df) else exact_quantiles(df.select(*(F.length(col(c).cast("string")).alias(c) for c in columns)), {c: [0.5] for c in columns}, direct=False)
    distinct = distinct_counts(df, columns)
    for i, c in enumerate(columns):
        size = F.length(col(c).cast("string"))
        aggs += [F.count(size).alias(f"count_{i}"), F.avg(size).alias(f"mean_{i}"), F.min(size).alias(f"min_{i}"), F.max(size).alias(f"max_{i}"), F.count_if(size == 0).alias(f"empty_{i}")]
        if medians is None:
            aggs.append(F.percentile(size, F.lit(0.5)).alias(f"median_{i}"))
        get = lambda k, i=i: F.col(f"{k}_{i}")
        median = get("median") if medians is None else F.lit(medians[c][0]).cast("double")
        zero = lambda x: F.coalesce(x, F.lit(0))
        rows.append({"column": F.lit(c), "count": get("count"), "missing": F.col("n") - get("count"), "mean_length": zero(get("mean")), "median_length": zero(median), "min_length": zero(get("min")).cast("long"), "max_length": zero(get("max")).cast("long"), "empty_strings": get("empty")})
    out = stacked(df.agg(*aggs), rows).join(distinct, "column", "left")
    return out.select("column", "count", "missing", F.coalesce("nunique", F.lit(0)).alias("nunique"), "mean_length", "median_length", "min_length", "max_length", "empty_strings")


def datetime_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, count, missing, min_date, max_date, n_days (whole days between the first and last moment)."""
    aggs, rows = [F.count(F.lit(1)).alias("n")], []
    for i, c in enumerate(columns):
        x = col(c).cast("timestamp_ntz")
        aggs += [F.count(x).alias(f"count_{i}"), F.min(x).alias(f"min_{i}"), F.max(x).alias(f"max_{i}")]
        lo, hi = F.col(f"min_{i}"), F.col(f"max_{i}")
        day = lambda x: F.coalesce(F.date_format(x, "yyyy-MM-dd"), F.lit(""))
        rows.append({"column": F.lit(c), "count": F.col(f"count_{i}"), "missing": F.col("n") - F.col(f"count_{i}"), "min_date": day(lo), "max_date": day(hi), "n_days": F.coalesce(F.timestamp_diff("DAY", lo, hi), F.lit(0)).cast("long")})
    return stacked(df.agg(*aggs), rows)


def _days(df: DataFrame, column: str) -> DataFrame:
    """Each day with values: its first and last moment."""
    x = col(column).cast("timestamp_ntz")
    return df.select(x.alias("x")).where("x IS NOT NULL").groupBy(F.to_date("x").alias("day")).agg(F.min("x").alias("first"), F.max("x").alias("last"))


def datetime_gaps(df: DataFrame, column: str, days: int = GAP_DAYS, most: int | None = GAPS) -> DataFrame:
    """gap_from, gap_to: days around stretches of more than `days` days without a value, in order; the first `most`.

    Values are first reduced to days, so the ordered step sees one row for a day.
    """
    w = Window.orderBy("day")
    step = _days(df, column).withColumn("before", F.lag("last").over(w))
    gaps = step.where(F.col("first") > F.col("before") + F.make_dt_interval(F.lit(days))).select(F.date_format("before", "yyyy-MM-dd").alias("gap_from"), F.date_format("first", "yyyy-MM-dd").alias("gap_to"))
    gaps = gaps.orderBy("gap_from")
    return gaps if most is None else gaps.limit(most)


def datetime_frequency(df: DataFrame, column: str, most: int = 100_000) -> str | None:
    """D, h, min, s, W-<day>, B, MS, ME, QS-<month>, QE-<month>, YS-<month> or YE-<month> with its multiple if the values are
    regular and distinct, else None. A quarter is named by the month in which the year's quarters begin or end."""
    x = df.select(col(column).cast("timestamp_ntz").alias("x")).where("x IS NOT NULL")
    n, distinct, lo, hi = x.agg(F.count("x"), F.count_distinct("x"), F.min("x"), F.max("x")).first()
    if n < 3 or distinct < n:
        return None
    # a regular grid is known by its least step: all values must lie on it, and none may be left out
    seconds = (hi - lo).total_seconds()
    step = seconds / (n - 1)
    off = x.select(F.timestamp_diff("MICROSECOND", F.lit(lo).cast("timestamp_ntz"), F.col("x")).alias("d")).agg(F.count_if(F.pmod(F.col("d"), F.lit(max(1, round(step * 1e6)))) != 0)).first()[0]
    if not off:
        for name, size in (("D", 86400), ("h", 3600), ("min", 60), ("s", 1)):
            if step % size == 0:
                k = int(step // size)
                if name == "D" and k % 7 == 0:
                    k, name = k // 7, "W-" + lo.strftime("%a").upper()
                return name if k == 1 else f"{k}{name}"
        return None
    if n > most:
        return None
    whole = x.agg(F.count_if((F.col("x") != F.date_trunc("day", "x")) | F.dayofweek("x").isin(1, 7))).first()[0] == 0
    days = (hi - lo).days
    weekdays = days // 7 * 5 + sum((lo.weekday() + k) % 7 < 5 for k in range(days % 7 + 1))
    if whole and n == weekdays:
        return "B"
    every = x.select(F.trunc("x", "MM").alias("m"), (F.dayofmonth("x") == 1).alias("s"), (F.to_date("x") == F.last_day("x")).alias("e"))
    months, starts, ends = every.agg(F.count_distinct("m"), F.bool_and("s"), F.bool_and("e")).first()
    span = (hi.year - lo.year) * 12 + hi.month - lo.month
    if months == n and (starts or ends) and span % (n - 1) == 0:
        k, tail = span // (n - 1), "S" if starts else "E"
        steps = every.select(((F.year("m") - lo.year) * 12 + F.month("m") - lo.month).alias("k")).where(F.pmod(F.col("k"), F.lit(k)) != 0).limit(1).count()
        if not steps:
            if k % 12 == 0:
                k, name = k // 12, f"Y{tail}-{MONTHS[lo.month - 1]}"
            elif k % 3 == 0:
                k, name = k // 3, f"Q{tail}-{MONTHS[9 + (lo.month - 1) % 3]}"
            else:
                name = f"M{tail}"
            return name if k == 1 else f"{k}{name}"
    return None


CLOCK = r"^\s*\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*$"


def clock(x: Column) -> Column:
    """Seconds of the day of a time written as H:MM, H:MM:SS or with a fraction; null where no clock shows it."""
    t = F.trim(x)
    part = lambda k: F.regexp_extract(t, r"^(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?$", k)
    h, m, s = part(1).try_cast("int"), part(2).try_cast("int"), F.coalesce(F.nullif(part(3), F.lit("")), F.lit("0")).try_cast("int")
    return F.when((h < 24) & (m < 60) & (s < 60), h * 3600 + m * 60 + s)


def hour_counts(df: DataFrame, column: str) -> DataFrame:
    """hour (0 to 23), n: rows by hour of a moment, or of a time of day kept as text; hours without rows have 0."""
    x = col(column)
    hour = F.hour(x) if df.schema[column].dataType.typeName() in ("timestamp", "timestamp_ntz") else F.floor(clock(x.cast("string")) / 3600).cast("int")
    seen = df.select(hour.alias("hour")).where("hour IS NOT NULL").groupBy("hour").agg(F.count(F.lit(1)).alias("n"))
    return df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour")).join(seen, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def time_profile(df: DataFrame, column: str) -> dict:
    """count, missing, nunique (of the text), earliest, latest, peak_hour (the first of the fullest), hour_counts."""
    t = clock(col(column).cast("string"))
    n, missing, distinct, lo, hi = df.agg(F.count(t), F.count_if(col(column).isNull()), F.count_distinct(col(column)), F.min(t), F.max(t)).first()
    hours = {r["hour"]: r["n"] for r in hour_counts(df, column).collect()}
    show = lambda s: "" if s is None else f"{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"
    return {"count": n, "missing": missing, "nunique": distinct if n else 0, "earliest": show(lo), "latest": show(hi), "peak_hour": min(hours, key=lambda h: (-hours[h], h)) if n else None, "hour_counts": dict(sorted(hours.items()))}
