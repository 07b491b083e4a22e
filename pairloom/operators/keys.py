"""One subset per key, with the key carried as a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.checks import named, need_columns
from pairloom.functions.text import TOPIC_PATTERN, extract_key
from pairloom.storage import materialize


def with_key(
    df: DataFrame,
    text: str,
    name: str = "key",
    pattern: str = TOPIC_PATTERN,
    group: int = 1,
    on_missing: str = "error",
) -> DataFrame:
    """Add the key found in a text column."""
    need_columns(df, text)
    keyed = df.withColumn(name, extract_key(text, pattern, group, on_missing))
    return keyed.where(F.col(name).isNotNull()) if on_missing == "drop" else keyed


def keep_key(df: DataFrame, column: str, value: str, **options) -> DataFrame:
    """Rows whose key, extracted from a text column, is ``value``; no column is added."""
    need_columns(df, column)
    return df.where(extract_key(named(column), **options) == F.lit(value))


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    """The set of keys in a table."""
    need_columns(df, key)
    return df.select(key).distinct()


def fan_out(
    df: DataFrame,
    key: str,
    split: str = "split",
    key_from: str = "train",
    config: str = "config",
) -> DataFrame:
    """Mark each row with its subset (``config``); subsets are the keys of the train split.

    Rows of other splits whose key the train split lacks are left out, as are rows without a key.
    However many keys there are, the table is read twice: for the keys, and for the rows.
    """
    need_columns(df, key, split)
    keys = materialize(distinct_keys(df.where(F.col(split) == key_from), key), "keys")
    kept = df.join(keys, key, "left_semi")
    return kept.withColumn(config, F.col(key))
