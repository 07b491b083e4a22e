"""Row filters. Each is one Column predicate, so Parquet scans receive it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.checks import named, need_columns


def keep_equal(df: DataFrame, column: str, value) -> DataFrame:
    """Rows whose column equals the value."""
    need_columns(df, column)
    return df.where(named(column) == F.lit(value))


def single_vs_rest(df: DataFrame, column: str, value) -> tuple[DataFrame, DataFrame]:
    """Rows equal to the value, and all others, among them those without a value."""
    need_columns(df, column)
    same = named(column).eqNullSafe(F.lit(value))
    return df.where(same), df.where(~same)


def drop_values(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose column holds none of the values; missing ones stay."""
    need_columns(df, column)
    return df.where(named(column).isNull() | ~named(column).isin(list(values)))


def keep_values(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose column holds one of the values."""
    need_columns(df, column)
    return df.where(named(column).isin(list(values)))
