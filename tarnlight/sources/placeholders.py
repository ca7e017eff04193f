"""Cells that stand for a missing value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, is_text
from ..operators.quality import NUMBER_TEXT

#: Fixed value: signs that alone in a cell mean a gap.
PLACEHOLDER = r"^\s*[.\-?_*/]+\s*$"


def placeholder_counts(df: DataFrame) -> DataFrame:
    """column, placeholder (trimmed), n of all text columns."""
    some = [c for c in df.columns if is_text(df, c)]
    if not some:
        return df.sparkSession.createDataFrame([], "column string, placeholder string, n long")
    cells = F.array(*(F.struct(F.lit(c).alias("column"), col(c).alias("v")) for c in some))
    return df.select(F.inline(cells)).where(F.col("v").rlike(PLACEHOLDER)).groupBy("column", F.trim("v").alias("placeholder")).agg(F.count(F.lit(1)).alias("n"))


def replace_placeholders(df: DataFrame) -> tuple[DataFrame, dict[str, dict[str, int]]]:
    """(table with placeholders as nulls, counts by column). A column that then has only numbers becomes a number."""
    found: dict[str, dict[str, int]] = {}
    for r in placeholder_counts(df).collect():
        found.setdefault(r["column"], {})[r["placeholder"]] = r["n"]
    if not found:
        return df, {}
    df = df.withColumns({c: F.when(~col(c).rlike(PLACEHOLDER), col(c)) for c in found})
    names = list(found)
    row = df.agg(*(f.alias(f"{k}_{i}") for i, c in enumerate(names) for k, f in (("n", F.count(col(c))), ("x", F.count_if(F.trim(col(c)).rlike(NUMBER_TEXT)))))).first()
    numbers = [c for i, c in enumerate(names) if row[f"n_{i}"] and row[f"n_{i}"] == row[f"x_{i}"]]
    return df.withColumns({c: F.trim(col(c)).cast("double") for c in numbers}), found
