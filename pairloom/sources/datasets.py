"""Datasets on disk: Parquet files by config and split, published in two phases.

A publication writes its rows to a folder of their own, ``_data/_publication=…/config=…/split=…``, and nothing that
is there is touched. Then one small file is added to the dataset's manifest: it lists every part of the dataset as it now is, with
the publication that holds it. A reader takes the newest list, once, and reads the files of those parts; so
whatever fails, and whenever, a reader sees the dataset as it was before or as it is after. Files of
earlier publications stay for readers that are still at them, until `prune` deletes what no list to be kept names.

A folder without a manifest, written by other means as ``config=…/split=…``, can be read as well. All
reading and listing goes through Spark's own readers, so any store that Spark is set up for will do.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.checks import named, need_choice, need_columns

#: Characters that Spark leaves as they are in a folder's name.
_PLAIN = " !$&(),-.;<>@_`|~+"

SCOPES = ("dataset", "configs", "parts")

_MANIFEST = "version bigint, publication string, part string, holder string"
_HOLDER = "_publication"


def _data(root: str) -> str:
    """The folder that holds the publications; Spark takes no notice of it when it lists the dataset's own."""
    return f"{root}/_data"


def _part(keys: Sequence[str], values: Sequence[str]) -> str:
    """A part's place below its publication."""
    return "/".join(f"{key}={quote(value, safe=_PLAIN)}" for key, value in zip(keys, values))


def _values(part: str) -> dict[str, str]:
    """The key values that a part's place names."""
    pairs = (folder.partition("=") for folder in part.split("/") if "=" in folder)
    return {key: unquote(value) for key, _, value in pairs}


def _parts_below(spark: SparkSession, folder: str) -> list[str]:
    """The places of the files below a folder, as Spark lists them; empty where there is none."""
    try:
        files = spark.read.schema("_none int").parquet(folder).inputFiles()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    # Listed as URIs: what is left of them after one decoding is the path.
    paths = [unquote(file).rpartition("/")[0] for file in files]
    parts = set()
    for path in paths:
        folders = path.split("/")
        at = len(folders)
        while at and "=" in folders[at - 1] and not folders[at - 1].startswith(f"{_HOLDER}="):
            at -= 1
        parts.add("/".join(folders[at:]))
    return sorted(parts)


@dataclass(frozen=True)
class Contents:
    """A dataset as one list of its manifest says: each part with the publication that holds it."""

    root: str
    version: int
    publication: str
    holders: dict[str, str]

    def paths(self, parts: Sequence[str]) -> list[str]:
        return [f"{_data(self.root)}/{_HOLDER}={self.holders[part]}/{part}".rstrip("/") for part in parts]


def contents(spark: SparkSession, root: str, version: int | None = None) -> Contents | None:
    """The newest list of a dataset, or the one of a version; None where there is no manifest."""
    root = root.rstrip("/")
    try:
        lists = spark.read.schema(_MANIFEST).parquet(f"{root}/_manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if version is not None:
        lists = lists.where(F.col("version") == version)
    # Of two that were written at once, the same one is the newest to every reader.
    newest = lists.orderBy(F.desc("version"), F.desc("publication")).limit(1).select("version", "publication").collect()
    if not newest:
        if version is not None:
            raise ValueError(f"no version {version} in {root}")
        return None
    number, publication = newest[0]
    rows = lists.where((F.col("version") == number) & (F.col("publication") == publication)).collect()
    holders = {row["part"]: row["holder"] for row in rows if row["part"] is not None}
    return Contents(root, number, publication, holders)


def _listed(spark: SparkSession, root: str) -> list[dict[str, str]]:
    """The key values of a dataset's parts, from its manifest or from the folders."""
    found = contents(spark, root)
    return [_values(part) for part in (_parts_below(spark, root) if found is None else found.holders)]


def published_configs(spark: SparkSession, root: str) -> DataFrame:
    """The configs of a published dataset, from its list alone."""
    names = sorted({values["config"] for values in _listed(spark, root)})
    return spark.createDataFrame([(name,) for name in names], "config string")


def published_splits(spark: SparkSession, root: str, config: str) -> DataFrame:
    """The splits of one config of a published dataset, empty ones included."""
    found = _listed(spark, root)
    _known(config, {values["config"] for values in found}, "config", root)
    names = sorted({values["split"] for values in found if values["config"] == config})
    return spark.createDataFrame([(name,) for name in names], "split string")


def _known(value: str, names: set[str], what: str, root: str) -> None:
    if value not in names:
        raise ValueError(f"no {what} {value!r} in {root}; there are {sorted(names)}")


def read_dataset(
    spark: SparkSession,
    root: str,
    config: str | None = None,
    split: str | None = None,
    schema: T.StructType | None = None,
    keys: Sequence[str] = ("config", "split"),
    version: int | None = None,
) -> DataFrame:
    """A published dataset, or one config or split of it, as it is now or was in a version.

    ``config`` and ``split`` only choose parts: nothing else is read. One that is not there is an
    error. The key columns are text always, also where every value looks like a number.
    """
    root = root.rstrip("/")
    found = contents(spark, root, version)
    parts = _parts_below(spark, root) if found is None else sorted(found.holders)
    for at, value in enumerate((config, split)):
        if value is not None and at < len(keys):
            _known(value, {_values(part).get(keys[at], "") for part in parts}, keys[at], root)
            parts = [part for part in parts if _values(part).get(keys[at]) == value]
    if found is None:
        paths = [f"{root}/{part}".rstrip("/") for part in parts] if config or split else [root]
    else:
        paths = found.paths(parts)
        if not paths:
            if schema is None:
                raise ValueError(f"{root} has no parts, so its columns are not known; give a schema")
            return spark.createDataFrame([], schema)
    reader = spark.read.option("basePath", root if found is None else _data(root))
    if schema is None:
        held = len({found.holders[part] for part in parts}) if found else 1
        seen = reader.option("mergeSchema", held > 1).parquet(*paths).schema
        schema = T.StructType([
            T.StructField(field.name, T.StringType()) if field.name in keys else field
            for field in seen.fields if field.name != _HOLDER
        ])
    if found is not None:
        schema = T.StructType([*schema.fields, T.StructField(_HOLDER, T.StringType())])
    df = reader.schema(schema).parquet(*paths).drop(_HOLDER)
    for name, value in (("config", config), ("split", split)):
        if value is not None:
            need_columns(df, name)
            df = df.where(F.col(name) == value)
    return df


def list_configs(df: DataFrame, config: str = "config") -> DataFrame:
    """The configs of a dataset."""
    need_columns(df, config)
    return df.select(config).distinct()


def list_splits(
    df: DataFrame, config: str | None = None, split: str = "split", config_column: str = "config"
) -> DataFrame:
    """The splits of a dataset, or of one config."""
    need_columns(df, split)
    if config is not None:
        df = df.where(F.col(config_column) == config)
    return df.select(split).distinct()


def _write_parts(
    df: DataFrame, folder: str, keys: Sequence[str], parts: Sequence[Sequence[str]]
) -> list[str]:
    """The first phase: write the rows below a new folder, and empty parts that are asked for."""
    spark = df.sparkSession
    rows = df
    if keys:
        # Spark would file a null and an empty key together under a made-up name.
        rows = df.withColumns({
            key: F.coalesce(
                F.nullif(F.col(key).cast("string"), F.lit("")),
                F.raise_error(F.lit(f"rows without a {key} cannot be published")).cast("string"),
            )
            for key in keys
        }).hint("rebalance", *keys)
    (rows.write.partitionBy(*keys) if keys else rows.write).parquet(folder)
    written = _parts_below(spark, folder) if keys else [""]
    empty = spark.createDataFrame([], df.drop(*keys).schema)
    for part in (_part(keys, values) for values in parts):
        if part not in written:
            empty.coalesce(1).write.parquet(f"{folder}/{part}")
            written.append(part)
    return written


def _add_list(spark: SparkSession, root: str, version: int, publication: str, holders: dict[str, str]) -> None:
    """The second phase: one task writes one file, which is there or is not."""
    rows = [(version, publication, part, holder) for part, holder in sorted(holders.items())]
    table = spark.createDataFrame(rows or [(version, publication, None, None)], _MANIFEST)
    table.coalesce(1).write.mode("append").parquet(f"{root}/_manifest")


def publish(
    df: DataFrame,
    root: str,
    keys: Sequence[str] = ("config", "split"),
    scope: str = "dataset",
    parts: Sequence[tuple[str, ...]] = (),
) -> int:
    """Publish a table as a dataset, one folder per value of the key columns, and return its version.

    ``scope="dataset"`` replaces whatever the dataset was. ``scope="configs"`` replaces each config
    (first key) of ``df`` as a whole, splits that it no longer has included, and keeps the other
    configs. ``scope="parts"`` replaces only the configs and splits that ``df`` has rows for; one
    that lost all its rows stays as it was. ``parts`` names configs and splits that are to be there even
    without rows. ``df`` may read from the dataset itself. Parts that are kept are not copied.

    Rows are rebalanced by key first: small parts get one file, a huge one is cut into many. Of two publications at
    once, one counts as the later and hides the other's; both are whole.
    """
    need_choice(scope, SCOPES, "scope")
    need_columns(df, *keys)
    spark, root = df.sparkSession, root.rstrip("/")
    if scope != "dataset" and not keys:
        raise ValueError(f"scope {scope!r} needs keys")
    if scope != "dataset" and contents(spark, root) is None and _parts_below(spark, root):
        raise ValueError(f"{root} was not written by publish: publish it as a whole first")
    publication = uuid.uuid4().hex
    written = _write_parts(df, f"{_data(root)}/{_HOLDER}={publication}", keys, parts)
    holders = {part: publication for part in written}
    before = contents(spark, root)
    if before is not None and scope != "dataset":
        replaced = {_values(part)[keys[0]] for part in written}
        for part, holder in before.holders.items():
            if part not in holders and (scope == "parts" or _values(part)[keys[0]] not in replaced):
                holders[part] = holder
    version = 1 if before is None else before.version + 1
    _add_list(spark, root, version, publication, holders)
    return version


def prune(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Delete the files of publications that none of the newest ``keep`` versions names; return their ids.

    Readers of older versions lose their files, and so does a publication that is being written just now:
    prune when none is. Spark has no call of its own for deleting, so this goes to the file system that it uses.
    """
    root, latest = root.rstrip("/"), contents(spark, root)
    if keep < 1 or latest is None:
        raise ValueError("keep must be positive" if keep < 1 else f"{root} has no manifest")
    lists = spark.read.schema(_MANIFEST).parquet(f"{root}/_manifest")
    live = {
        row["holder"] for row in lists.where(F.col("version") > latest.version - keep).select("holder").distinct().collect()
    }
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    top = hadoop.Path(_data(root))
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for status in files.listStatus(top):
        name = status.getPath().getName()
        if name.startswith(f"{_HOLDER}=") and name.partition("=")[2] not in live:
            files.delete(status.getPath(), True)
            gone.append(name.partition("=")[2])
    return sorted(gone)
