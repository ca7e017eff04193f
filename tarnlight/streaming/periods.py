"""Rows by calendar period over a stream: the batch operator's buckets, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col

UNITS = ("day", "week", "month", "year")


def rows_per_period(stream: DataFrame, column: str, unit: str) -> DataFrame:
    """period, n of a streaming table, for update or complete output.

    Every row counts, however late, as the state is one row for each period that there is. Periods without rows have
    no row here: a stream has no last period, so the reader fills them in as the batch operator does.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    return stream.groupBy(F.date_trunc(unit, col(column).cast("timestamp")).alias("period")).agg(F.count(F.lit(1)).alias("n")).where("period IS NOT NULL")
