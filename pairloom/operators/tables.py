"""Whole tables put together, and splits carried as a column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.checks import need_columns


def _shape(df: DataFrame) -> dict[str, str]:
    return {field.name: field.dataType.simpleString() for field in df.schema.fields}


def concat_tables(*dfs: DataFrame, allow_missing: bool = False) -> DataFrame:
    """All rows of all tables, duplicates kept, columns matched by name.

    With ``allow_missing`` a column absent from one table is null there; without it the tables
    must have the same columns and types.
    """
    if not dfs:
        raise ValueError("no tables given")
    if not allow_missing:
        shapes = [_shape(df) for df in dfs]
        if any(shape != shapes[0] for shape in shapes):
            raise ValueError(f"tables differ: {shapes}")
    return reduce(
        lambda left, right: left.unionByName(right, allowMissingColumns=allow_missing), dfs
    )


def bundle_splits(parts: dict[str, DataFrame], column: str = "split") -> DataFrame:
    """Several tables as one, each row marked with the name of its split."""
    return concat_tables(*(df.withColumn(column, F.lit(name)) for name, df in parts.items()))


def fold_splits(df: DataFrame, mapping: dict[str, str], column: str = "split") -> DataFrame:
    """Rename splits, which also merges one into another."""
    need_columns(df, column)
    renamed = F.col(column)
    for old, new in mapping.items():
        renamed = F.when(F.col(column) == old, F.lit(new)).otherwise(renamed)
    return df.withColumn(column, renamed)
