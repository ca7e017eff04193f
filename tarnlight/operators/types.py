"""Semantic types of columns: what every later step is chosen by.

One aggregate serves the counts of all columns; one probe reads the first values of text columns. Rules are tried
in order and the first that fits wins.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions.columns import MOMENTS, WHOLE, col, is_number, is_text
from .univariate import CLOCK, clock

#: Distinct values of a discrete number and of a code; rows probed; shares that decide.
DISCRETE, CODES = 20, 100
PROBE, SHARE, FREE_TEXT, CODE_SHARE, SEQUENCE = 200, 0.9, 0.5, 0.9, 0.9
#: Texts that are booleans.
TRUTHS = ("True", "False", "true", "false", "yes", "no", "Yes", "No", "YES", "NO")
#: Date formats in order of priority, as (format, whether the year has two digits).
DATE_FORMATS = (
    ("y-M-d", False),
    ("y-M-d H:m:s", False),
    ("y-M-d H:m:s.[SSSSSS][SSSSS][SSSS][SSS][SS][S]", False),
    ("y-M-d'T'H:m:s", False),
    ("y-M-d'T'H:m:s.[SSSSSS][SSSSS][SSSS][SSS][SS][S]", False),
    ("y/M/d", False),
    ("d/M/y", False),
    ("d/M/y H:m:s", False),
    ("d-M-y", False),
    ("d-M-y H:m:s", False),
    ("M/d/y", False),
    ("M/d/y H:m:s", False),
    ("M-d-y", False),
    ("d/M/yy", True),
    ("d-M-yy", True),
    ("M/d/yy", True),
    ("M-d-yy", True),
    ("MMM d, y", False),
    ("MMMM d, y", False),
    ("d MMM y", False),
    ("d MMMM y", False),
)
#: Looks of dates, codes and key names.
NUMBER_DATE = r"^\s*(\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/](\d{4}|\d{2}))([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?\s*$"
WORD_DATE = r"(?i)^\s*(\d{1,2}\s+)?(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(\d{1,2},?\s+)?\d{4}\s*$"
CODE = r"^[a-zA-Z0-9_-]+$"
MIXED_CODE = r"^(?=.*[A-Za-z])(?=.*\d)[A-Za-z0-9_-]+$"
KEY_NAME = re.compile(r"^(?:id|uuid|guid)$|^id[_\-]|[_\-]id$|[_\-]key$", re.I)
KEY_TAIL = re.compile(r"[a-z0-9]I[dD]$")
LABELS = {
    "numeric_continuous": "number",
    "numeric_discrete": "number with few values",
    "categorical": "category",
    "boolean": "yes or no",
    "datetime": "date",
    "time": "time of day",
    "text": "free text",
    "identifier": "identifier",
    "constant": "single value",
}


STORAGE = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "float": "float", "double": "float", "boolean": "bool", "date": "date", "timestamp": "date", "timestamp_ntz": "date", "string": "text"}


def storage_label(df: DataFrame, name: str) -> str:
    """int, float, bool, date, duration, text or the type's own name."""
    kind = dict(df.dtypes)[name]
    return STORAGE.get(kind, "float" if kind.startswith("decimal") else "duration" if kind.startswith("interval") else kind)


def is_key_name(name: str) -> bool:
    return bool(KEY_NAME.search(name) or KEY_TAIL.search(name))


def parse_date(text: Column, fmt: str, short: bool) -> Column:
    """The moment that the whole text means in that format, else null."""
    year = text.rlike(r"(^|\D)\d{4}(\D|$)")
    t = F.try_to_timestamp(F.trim(text), F.lit(fmt)).cast("timestamp_ntz")
    if not short:
        return F.when(year, t)
    # two digits from 69 on are of the last century
    return F.when(~year, F.when(F.year(t) >= 2069, F.add_months(t, -1200).cast("timestamp_ntz") + (t - F.date_trunc("day", t))).otherwise(t))


def date_format_of(df: DataFrame, name: str) -> tuple[str, bool] | None:
    """The format that parses most of a column, the first of equals; None if none parses anything."""
    row = df.agg(*(F.count(parse_date(col(name), f, s)).alias(str(i)) for i, (f, s) in enumerate(DATE_FORMATS))).first()
    best = max(range(len(DATE_FORMATS)), key=lambda i: (row[i], -i))
    return DATE_FORMATS[best] if row[best] else None


def to_moment(df: DataFrame, name: str) -> DataFrame:
    """df with a text column read as moments in its best format, or by the engine's own rules if none fits."""
    if not is_text(df, name):
        return df
    f = date_format_of(df, name)
    return df.withColumn(name, parse_date(col(name), *f) if f else F.try_to_timestamp(col(name)).cast("timestamp_ntz"))


def _first_values(df: DataFrame, names: list[str], order: str | None) -> dict[str, list[str]]:
    """The first values that aren't null of each column, at most PROBE."""
    out = {}
    for c in names:
        some = df.where(col(c).isNotNull())
        if order:
            some = some.orderBy(order)
        out[c] = [r[0] for r in some.select(col(c)).limit(PROBE).collect()]
    return out


def _dates_and_times(df: DataFrame, names: list[str], order: str | None) -> dict[str, str]:
    """Of text columns those whose first values are dates or times of day."""
    probe = [(c, v) for c, vs in _first_values(df, names, order).items() for v in vs]
    if not probe:
        return {}
    rows = df.sparkSession.createDataFrame(probe, "c string, v string")
    v = F.col("v")
    looks = v.rlike(NUMBER_DATE) | v.rlike(WORD_DATE)
    got = rows.groupBy("c").agg(F.count("v").alias("n"), F.count_if(looks).alias("d"), F.count_if(v.rlike(CLOCK)).alias("t"), F.count(F.when(v.rlike(CLOCK), clock(v))).alias("k"), *(F.count(F.when(looks, parse_date(v, f, s))).alias(f"f{i}") for i, (f, s) in enumerate(DATE_FORMATS)))
    out = {}
    for r in got.collect():
        if r["d"] > SHARE * r["n"] and max(r[f"f{i}"] for i in range(len(DATE_FORMATS))) > SHARE * r["d"]:
            out[r["c"]] = "datetime"
        elif r["t"] > SHARE * r["n"] and r["k"] > SHARE * r["t"]:
            out[r["c"]] = "time"
    return out


def _counters(df: DataFrame, names: list[str], order: str | None) -> set[str]:
    """Whole-number columns that count the rows: nine in ten steps to the next row are 1.

    With a row order, its steps are compared; without one, the steps between sorted values are, by the column's span:
    n distinct values that span n - 1 step by 1 in the order they were made in.
    """
    if not names:
        return set()
    if order is None:
        row = df.agg(*(f.alias(f"{k}_{i}") for i, c in enumerate(names) for k, f in (("n", F.count(col(c))), ("w", F.max(col(c)) - F.min(col(c)))))).first()
        # as many distinct values can't be in a span much wider or narrower than the rows
        dense = [c for i, c in enumerate(names) if row[f"n_{i}"] > 1 and 0 < row[f"w_{i}"] and SEQUENCE <= (row[f"n_{i}"] - 1) / float(row[f"w_{i}"]) <= 1]
        if not dense:
            return set()
        seen = df.agg(*(f for c in dense for f in (F.count(col(c)), F.count_distinct(col(c))))).first()
        return {c for i, c in enumerate(dense) if seen[2 * i] == seen[2 * i + 1]}
    # windows run inside cuts of the order, side by side; the steps from cut to cut come from their first and last rows
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = df.select(col(order).alias("__o"), *(col(c).alias(f"c{i}") for i, c in enumerate(names)))
    cuts = some.agg(F.percentile_approx(F.col("__o").cast("double"), [k / parts for k in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    splits = F.array(*map(F.lit, sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    some = some.withColumn("__cut", F.size(F.filter(splits, lambda s: s < F.col("__o"))))
    w = Window.partitionBy("__cut").orderBy("__o")
    steps = some.select("__cut", "__o", *(f"c{i}" for i in range(len(names))), *((F.col(f"c{i}") - F.lag(f"c{i}").over(w)).alias(f"s{i}") for i in range(len(names))))
    each = steps.groupBy("__cut").agg(*(f.alias(f"{k}{i}") for i in range(len(names)) for k, f in (("n", F.count(f"s{i}")), ("one", F.count_if(F.col(f"s{i}") == 1)), ("from", F.min_by(f"c{i}", "__o")), ("to", F.max_by(f"c{i}", "__o"))))).orderBy("__cut").collect()  # one row for each cut
    found = set()
    for i, c in enumerate(names):
        between = [b[f"from{i}"] - a[f"to{i}"] for a, b in zip(each, each[1:]) if b[f"from{i}"] is not None and a[f"to{i}"] is not None]
        n, one = sum(r[f"n{i}"] for r in each) + len(between), sum(r[f"one{i}"] for r in each) + between.count(1)
        if n and one / n >= SEQUENCE:
            found.add(c)
    return found


def infer_types(df: DataFrame, overrides: dict[str, str] | None = None, *, discrete: int = DISCRETE, codes: int = CODES, order: str | None = None) -> dict[str, str]:
    """column -> type. order: a column of row numbers, for rules on the first rows and on row order; it gets no type."""
    names = [c for c in df.columns if c != order]
    aggs = []
    for i, c in enumerate(names):
        x = col(c)
        text = x.cast("string")
        truth = text.isin(*TRUTHS) if is_text(df, c) else x.cast("double").isin(0.0, 1.0) if is_number(df, c) else F.lit(isinstance(df.schema[c].dataType, BooleanType))
        aggs += [F.count(x).alias(f"n_{i}"), F.approx_count_distinct(x, 0.02).alias(f"d_{i}"), F.count_if(x.isNotNull() & ~truth).alias(f"b_{i}")]
        if is_text(df, c):
            aggs += [F.avg(F.length(x)).alias(f"l_{i}"), F.count_if(x.rlike(CODE)).alias(f"c_{i}"), F.count_if(x.rlike(MIXED_CODE)).alias(f"m_{i}")]
    row = df.agg(*aggs).first().asDict()
    # sketches leave few columns near a rule's limit; those are counted exactly
    close = [i for i, c in enumerate(names) if row[f"n_{i}"] and any(abs(row[f"d_{i}"] - at) <= 2 + 0.15 * at for at in ((1, discrete) if is_number(df, c) else (1, discrete, codes, 0.9 * row[f"n_{i}"], FREE_TEXT * row[f"n_{i}"])))]
    if close:
        row |= df.agg(*(F.count_distinct(col(names[i])).alias(f"d_{i}") for i in close)).first().asDict()
    out: dict[str, str] = {}
    counters_wanted, probe = [], []
    for i, c in enumerate(names):
        n, d, kind = row[f"n_{i}"], row[f"d_{i}"], df.schema[c].dataType
        if n == 0 or d == 1:
            out[c] = "constant"
        elif row[f"b_{i}"] == 0:
            out[c] = "boolean"
        elif isinstance(kind, MOMENTS):
            out[c] = "datetime"
        elif is_number(df, c):
            out[c] = "numeric_discrete" if d <= discrete else "identifier" if isinstance(kind, WHOLE) and is_key_name(c) else "numeric_continuous"
            if out[c] == "numeric_continuous" and isinstance(kind, WHOLE):
                counters_wanted.append(c)
        else:
            probe.append((i, c))
    for c in _counters(df, counters_wanted, order):
        out[c] = "identifier"
    found = _dates_and_times(df, [c for _, c in probe if is_text(df, c)], order)
    for i, c in probe:
        n, d = row[f"n_{i}"], row[f"d_{i}"]
        if c in found:
            out[c] = found[c]
        elif is_text(df, c) and d / n > 0.9 and row[f"l_{i}"] < 50 and row[f"c_{i}"] > 0.8 * n:
            out[c] = "identifier"
        elif is_text(df, c) and d > codes and row[f"m_{i}"] >= CODE_SHARE * n:
            out[c] = "identifier"
        elif d <= discrete:
            out[c] = "categorical"
        else:
            out[c] = "text" if d / n > FREE_TEXT else "categorical"
    return {c: (overrides or {}).get(c, out[c]) for c in names}


def apply_overrides(df: DataFrame, types: dict[str, str], wanted: dict[str, str]) -> tuple[DataFrame, dict[str, str], dict[str, int], list[str]]:
    """(table, types, values lost by column, unknown names): numeric and datetime convert, ignore drops, the rest relabel."""
    lost, unknown, types = {}, [], dict(types)
    for c, kind in wanted.items():
        if c not in df.columns:
            unknown.append(c)
            continue
        if kind == "ignore":
            df = df.drop(c)
            types.pop(c, None)
            continue
        if kind in ("numeric", "datetime"):
            before = df.agg(F.count(col(c))).first()[0]
            df = to_moment(df, c) if kind == "datetime" else df.withColumn(c, col(c).try_cast("double"))
            if missing := before - df.agg(F.count(col(c))).first()[0]:
                lost[c] = missing
            kind = "datetime" if kind == "datetime" else infer_types(df.select(col(c)))[c]
            kind = kind if kind in ("datetime", "numeric_discrete", "numeric_continuous") else "numeric_discrete"
        types[c] = kind
    return df, types, lost, unknown
