"""Checks made on the driver before a job starts, and guards evaluated inside one."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_POLICIES = ("error", "propagate")


def named(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until the table has no such column."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def need_columns(df: DataFrame, *names: str) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")


def need_choice(value: str, allowed: tuple[str, ...], what: str) -> None:
    if value not in allowed:
        raise ValueError(f"{what} must be one of {allowed}, not {value!r}")


def reject_nulls(result: Column, inputs: list[Column], on_null: str, what: str) -> Column:
    """``result``, or a failed job where an input is null (``on_null="error"``).

    Spark would let the null through in silence, where a row-by-row program would have failed.
    """
    need_choice(on_null, NULL_POLICIES, "on_null")
    if on_null == "propagate":
        return result
    any_null = reduce(or_, (column.isNull() for column in inputs))
    return F.when(any_null, F.raise_error(F.lit(f"null input: {what}"))).otherwise(result)
