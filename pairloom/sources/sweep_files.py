"""Sweep results exported as CSV."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.checks import named
from pairloom.storage import materialize

#: Types that a column of texts may turn out to have, narrowest first.
KINDS = ("int", "bigint", "double", "timestamp", "boolean")


def clean_name(name: str) -> str:
    """A column name that needs no backticks."""
    return name.replace(".", "_").replace("-", "_")


def _clean(columns: list[str]) -> list[str]:
    names = [clean_name(name) for name in columns]
    twice = sorted({name for name in names if names.count(name) > 1})
    if twice:
        raise ValueError(f"several columns would be called {twice}")
    return names


def _reader(spark: SparkSession, multi_line: bool):
    reader = spark.read.option("header", True).option("escape", '"').option("mode", "FAILFAST")
    return reader.option("multiLine", multi_line)


def read_sweep(
    spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = False
) -> DataFrame:
    """A CSV export with a header, quoted values, dots and dashes in its column names.

    Without a ``schema`` (for the file's own names) numbers are inferred, which reads the file
    twice. With ``multi_line`` a quoted value may hold line breaks; a file is then read by one task. A row
    that does not fit the header or the schema is an error, and so are names that become the same.
    For a folder of files with unlike columns see `read_sweeps`.
    """
    reader = _reader(spark, multi_line)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    return df.toDF(*_clean(df.columns))


def _fits(name: str, kind: str) -> Column:
    """Counts the values that are no ``kind``."""
    lost = named(name).isNotNull() & named(name).try_cast(kind).isNull()
    return F.count(F.when(lost, 1))


def typed(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the named columns of texts as the narrowest type that all of their values have.

    The values are looked at while the table is written, so its source is read once. A column without a value
    stays text.
    """
    if not columns:
        return df
    seen = Observation("kinds")
    counts = [
        _fits(name, kind).alias(f"{at}_{kind}") for at, name in enumerate(columns) for kind in KINDS
    ]
    there = [F.count(named(name)).alias(f"{at}_values") for at, name in enumerate(columns)]
    table = materialize(df.observe(seen, *counts, *there), "texts")
    found = seen.get
    kinds = {}
    for at, name in enumerate(columns):
        fitting = [kind for kind in KINDS if not found[f"{at}_{kind}"]]
        if fitting and found[f"{at}_values"]:
            kinds[name] = named(name).cast(fitting[0])
    return table.withColumns(kinds) if kinds else table


def read_sweeps(
    spark: SparkSession, path: str, label: str | None = "export", multi_line: bool = False
) -> DataFrame:
    """All CSV exports of a folder as one table, whatever columns each of them has.

    Of each file only the header is looked at first. Files with the same header are then read together, once, and
    put below one another by column name; a column that a file lacks is null there. Types are found over all files:
    a column is a number if it is one in each of them. ``label`` names a column with the file's name without its
    ending (None: no such column). An empty file is left out.
    """
    listed = _reader(spark, multi_line).schema("_none string").csv(path).inputFiles()
    alike: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for file in sorted(listed):
        alike[tuple(_reader(spark, multi_line).csv(file).columns)].append(file)
    alike.pop((), None)
    tables = []
    for header, files in alike.items():
        names = _clean(list(header))
        if label in names:
            raise ValueError(f"the files have a column {label!r} of their own; choose another label")
        schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
        rows = _reader(spark, multi_line).schema(schema).csv(files)
        columns = [named(old).alias(new) for old, new in zip(header, names)]
        if label is not None:
            file_name = rows.metadataColumn("_metadata")["file_name"]
            columns.append(F.regexp_replace(file_name, r"\.[^.]*$", "").alias(label))
        tables.append(rows.select(*columns))
    if not tables:
        raise ValueError(f"no exports in {path}")
    whole = reduce(lambda one, two: one.unionByName(two, allowMissingColumns=True), tables)
    return typed(whole, [name for name in whole.columns if name != label])
