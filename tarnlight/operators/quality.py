"""Data quality of a table: missing values, duplicates, constants, cardinality and numbers kept as text."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import MOMENTS, col, is_number, is_text, ratio, row_key, stacked
from .univariate import distinct_counts

#: Order of severities; types that have many values by nature; a written number; its share of a text column.
SEVERITY = {"critical": 0, "high": 1, "medium": 2, "low": 3}
EXEMPT = frozenset({"numeric_continuous", "numeric_discrete", "datetime", "time", "boolean", "constant", "identifier"})
NUMBER_TEXT = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
NUMERIC_TEXT_SHARE = 0.8


@dataclass
class Alert:
    severity: str
    column: str | None
    message: str
    recommendation: str


@dataclass
class QualityReport:
    rows: int = 0
    missing_per_column: dict[str, float] = field(default_factory=dict)
    missing_per_row: dict[int, int] = field(default_factory=dict)  # missing cells in a row -> rows
    duplicates: int = 0
    duplicate_members: int = 0  # all rows of groups of equal rows
    duplicate_rows: DataFrame | None = None
    constant_columns: list[str] = field(default_factory=list)
    quasi_constant_columns: dict[str, float] = field(default_factory=dict)
    high_cardinality_columns: dict[str, int] = field(default_factory=dict)
    mixed_type_columns: list[str] = field(default_factory=list)  # a Spark column has one type: always empty
    numeric_as_text: dict[str, int] = field(default_factory=dict)
    alerts: list[Alert] = field(default_factory=list)


def missing_per_column(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, missing, missing_pct (null for a table without rows)."""
    columns = columns or df.columns
    aggs = [F.count(F.lit(1)).alias("n")] + [F.count_if(col(c).isNull()).alias(f"m_{i}") for i, c in enumerate(columns)]
    return stacked(df.agg(*aggs), [{"column": F.lit(c), "missing": F.col(f"m_{i}"), "missing_pct": ratio(F.col(f"m_{i}") * 100.0, F.col("n"))} for i, c in enumerate(columns)])


def missing_per_row(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """n_missing, n_rows: how many rows miss how many cells."""
    total = F.lit(0)
    for c in columns or df.columns:
        total = total + col(c).isNull().cast("int")
    return df.select(total.alias("n_missing")).groupBy("n_missing").agg(F.count(F.lit(1)).alias("n_rows"))


def duplicate_groups(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The columns and n of every combination that occurs more than once; nulls are equal to each other."""
    columns = columns or df.columns
    return df.groupBy(*(col(c) for c in columns)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def duplicate_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """n_duplicates (rows beyond the first of each group), n_member_rows (all rows of such groups), n_groups.

    Rows are counted by 128-bit keys, so their cells aren't shuffled.
    """
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    groups = df.groupBy(*row_key(df, columns or df.columns)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return groups.agg(zero(F.sum(F.col("n") - 1)).alias("n_duplicates"), zero(F.sum("n")).alias("n_member_rows"), F.count(F.lit(1)).alias("n_groups"))


MAJORITY = 0.6  # a value with this share of a column's values is its median in any order


def constants(df: DataFrame, columns: list[str] | None = None, threshold: float = 0.99) -> DataFrame:
    """column, constant, quasi_constant, top_share: the share over all rows of the most frequent value, null without
    values. A null counts as a value of its own for `constant`, and never as the top value.

    A value that fills more than half of a column is its median in any order, also in that of its hashes. So one pass
    of sketches finds the only candidate of each column, and a second one counts it. Only the other columns' values
    are counted by a shuffle, as 128-bit keys, with partial counts before it.
    """
    columns = columns or df.columns
    text = [col(c).cast("string") for c in columns]
    # 52 bits of a hash, as the sketch holds doubles
    keys = df.select(*(F.when(x.isNotNull(), F.shiftrightunsigned(F.xxhash64(x), 12)).alias(f"k{i}") for i, x in enumerate(text)))
    first = keys.agg(*(f.alias(f"{n}{i}") for i in range(len(columns)) for n, f in (("m", F.percentile_approx(f"k{i}", F.lit(0.5), 10_000)), ("lo", F.min(f"k{i}")), ("hi", F.max(f"k{i}"))))).first()
    got = keys.agg(F.count(F.lit(1)).alias("rows"), *(f.alias(f"{n}{i}") for i in range(len(columns)) for n, f in (("n", F.count(f"k{i}")), ("t", F.count_if(F.col(f"k{i}") == F.lit(first[f"m{i}"]).cast("long")))))).first()
    top = {i: got[f"t{i}"] for i in range(len(columns)) if got[f"n{i}"] and got[f"t{i}"] >= MAJORITY * got[f"n{i}"]}
    if rest := [i for i in range(len(columns)) if got[f"n{i}"] and i not in top]:
        cells = df.select(F.inline(F.array(*(F.struct(F.lit(i).alias("i"), F.xxhash64(text[i]).alias("a"), F.xxhash64(text[i], F.lit(1)).alias("b"), text[i].isNotNull().alias("there")) for i in rest)))).where("there")
        counts = cells.groupBy("i", "a", "b").agg(F.count(F.lit(1)).alias("n"))
        top |= {r["i"]: r["n"] for r in counts.groupBy("i").agg(F.max("n").alias("n")).collect()}
    out = []
    for i, c in enumerate(columns):
        n, share = got[f"n{i}"], top[i] / got["rows"] if i in top else None
        constant = n == 0 or first[f"lo{i}"] == first[f"hi{i}"] and n == got["rows"]
        out.append((c, constant, not constant and share is not None and share > threshold, share))
    return df.sparkSession.createDataFrame(out, "column string, constant boolean, quasi_constant boolean, top_share double")


def cardinality(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, nunique (nulls don't count); the distinct values of all columns are counted in one shuffle."""
    return distinct_counts(df, columns)


def high_cardinality(df: DataFrame, types: dict[str, str] | None = None, threshold: int = 100) -> DataFrame:
    """column, nunique of the columns over the threshold, but for types that have many values by nature."""
    some = [c for c in df.columns if (types[c] not in EXEMPT if types and c in types else not is_number(df, c) and not isinstance(df.schema[c].dataType, MOMENTS))]
    return cardinality(df, some).where(F.col("nunique") > threshold) if some else df.sparkSession.createDataFrame([], "column string, nunique long")


def numeric_as_text(df: DataFrame, columns: list[str] | None = None, share: float = NUMERIC_TEXT_SHARE) -> DataFrame:
    """column, count, numeric_count, numeric_as_text of text columns. Only a written number counts, not NaN or 1d."""
    some = [c for c in columns or df.columns if is_text(df, c)]
    if not some:
        return df.sparkSession.createDataFrame([], "column string, count long, numeric_count long, numeric_as_text boolean")
    aggs = [f for i, c in enumerate(some) for f in (F.count(col(c)).alias(f"n_{i}"), F.count_if(F.trim(col(c)).rlike(NUMBER_TEXT)).alias(f"k_{i}"))]
    return stacked(df.agg(*aggs), [{"column": F.lit(c), "count": F.col(f"n_{i}"), "numeric_count": F.col(f"k_{i}"), "numeric_as_text": (F.col(f"n_{i}") > 0) & (F.col(f"k_{i}") > share * F.col(f"n_{i}"))} for i, c in enumerate(some)])


def sort_alerts(alerts: list[Alert]) -> list[Alert]:
    return sorted(alerts, key=lambda a: (SEVERITY.get(a.severity, 999), a.column or ""))


def analyze_quality(df: DataFrame, types: dict[str, str] | None = None, *, missing_threshold: float = 0.95, cardinality_threshold: int = 100, constant_threshold: float = 0.99, duplicate_threshold: float = 0.1) -> QualityReport:
    """All checks and their alerts. Every column gives one row to the driver; duplicate rows stay a DataFrame."""
    out = QualityReport(rows=df.count())
    out.missing_per_column = {r["column"]: r["missing_pct"] for r in missing_per_column(df).collect()}
    for c, pct in out.missing_per_column.items():
        if pct is not None and pct > missing_threshold * 100:
            out.alerts.append(Alert("high", c, f"{pct:.1f}% of the values of '{c}' are missing", "Drop the column, or derive it from others"))
        elif pct is not None and pct > 50:
            out.alerts.append(Alert("medium", c, f"{pct:.1f}% of the values of '{c}' are missing", "Find out whether the gaps mean something"))
    out.missing_per_row = {r["n_missing"]: r["n_rows"] for r in missing_per_row(df).collect()}
    if empty := out.missing_per_row.get(len(df.columns), 0):
        out.alerts.append(Alert("high", None, f"{empty} rows have no value at all", "Remove them"))
    out.duplicates, out.duplicate_members, _ = duplicate_counts(df).select("n_duplicates", "n_member_rows", "n_groups").first()
    groups = duplicate_groups(df)
    out.duplicate_rows = groups.select(*(col(c) for c in df.columns), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy")).drop("copy")
    if out.duplicates:
        share = out.duplicates / out.rows
        level = "high" if share > duplicate_threshold else "medium" if share > duplicate_threshold / 2 else "low"
        out.alerts.append(Alert(level, None, f"{out.duplicates} rows repeat an earlier row ({share * 100:.2f}%)", "Find out whether the repeats are meant"))
    seen = {r["column"]: r for r in constants(df, threshold=constant_threshold).collect()}
    out.constant_columns = [c for c in df.columns if c not in seen or seen[c]["constant"]]
    out.quasi_constant_columns = {c: seen[c]["top_share"] * 100 for c in df.columns if c in seen and seen[c]["quasi_constant"]}
    if out.constant_columns:
        out.alerts.append(Alert("high", None, f"{len(out.constant_columns)} columns have a single value: {', '.join(out.constant_columns)}", "Drop them"))
    out.alerts += [Alert("medium", c, f"One value of '{c}' fills {pct:.1f}% of the rows", "Little is left to learn from it") for c, pct in out.quasi_constant_columns.items()]
    out.high_cardinality_columns = {r["column"]: r["nunique"] for r in high_cardinality(df, types, cardinality_threshold).collect()}
    for c, n in sorted(out.high_cardinality_columns.items(), key=lambda x: (-x[1], x[0]))[:10]:
        out.alerts.append(Alert("low", c, f"'{c}' has {n} distinct values", "Group or hash them if it is a category"))
    for r in numeric_as_text(df).where("numeric_as_text").collect():
        out.numeric_as_text[r["column"]] = r["numeric_count"]
        out.alerts.append(Alert("medium", r["column"], f"{r['numeric_count']} of {r['count']} values of '{r['column']}' are numbers kept as text", "Convert the column to a number"))
    out.alerts = sort_alerts(out.alerts)
    return out

