"""Column helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
MOMENTS = (T.TimestampType, T.TimestampNTZType, T.DateType)


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def number(name: str) -> Column:
    """The column as a double, where NaN is missing."""
    x = col(name).cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


def is_number(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NUMBERS)


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def stacked(df: DataFrame, rows: Iterable[dict[str, Column]]) -> DataFrame:
    """One output row for each dict of expressions over the single row of df."""
    structs = [F.struct(*(c.alias(n) for n, c in row.items())) for row in rows]
    return df.select(F.inline(F.array(*structs)))


def values(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value (text) of every cell: the rows of many one-column counts in one pass."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.inline(cells))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, F.nullif(b, F.lit(0)))


def cell_key(name: str) -> Column:
    """A 128-bit key of a value, null for a null: what is shuffled to count distinct long values."""
    x = col(name).cast("string")
    return F.when(x.isNotNull(), F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))


def row_key(df: DataFrame, columns: list[str]) -> list[Column]:
    """Two 64-bit keys of a row: equal rows have equal keys, and a null equals only a null."""
    cells: list[Column] = []
    for c in columns:
        x = col(c)
        if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
            x = x + F.lit(0.0)  # a negative zero equals zero
        cells += [x.isNull(), x]  # hashes pass over nulls, so their places are hashed as well
    return [F.xxhash64(*cells).alias("__a"), F.xxhash64(F.lit(1), *cells).alias("__b")]
