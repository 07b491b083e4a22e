"""Intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without one gets a folder of its own; a cluster must name a shared one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pairloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_written: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{work_dir(spark)}/pairloom/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this program. Results that read them are lost."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    while _written:
        path = hadoop.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def work(spark: SparkSession) -> Iterator[None]:
    """Delete, at its end, the intermediate tables written within: publish or collect results before."""
    kept = _written[:]
    try:
        yield
    finally:
        mine = [path for path in _written if path not in kept]
        _written[:] = mine
        release(spark)
        _written[:] = kept


def materialize(df: DataFrame, label: str = "table", by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once and read it back: lineage is cut, columns stay prunable.

    ``by`` names columns to file the rows by: a filter on them then opens no other files.

    Use it before a result that must not be computed twice (a model's answers) feeds two plans,
    and for a join side that may be small: Spark knows the size of what was written and broadcasts
    it below ``spark.sql.autoBroadcastJoinThreshold`` only.
    """
    path = new_path(df.sparkSession, label)
    (df.hint("rebalance", *by).write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
