"""Batches worked off at a set pace, as a service with a limit per minute wants it.

The rows are numbered and written once, a file per batch. A stream then takes one file per trigger, or a set number
of them: at most so many batches per interval, and a checkpoint says which are done. A run that is stopped, or dies, goes on at the
next batch when it is started again with the same folders. A batch that was under way is worked off again, and its
rows are in the result once: the stream's sink lists the files of finished batches only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pairloom.operators.rows import assign_batches


def write_batches(
    df: DataFrame, folder: str, order_by: Sequence[str] | None, batch_size: int = 100, name: str = "batch_id"
) -> StructType:
    """Number consecutive batches along ``order_by`` (None: as stored) and write one file for each.

    Returns the schema to read them with. ``folder`` must not exist yet: a batch is written once.
    """
    batches = assign_batches(df, order_by, batch_size, name)
    batches.repartition(name).write.partitionBy(name).option("maxRecordsPerFile", 0).parquet(folder)
    return batches.schema


def run_in_batches(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    work: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    every: str | None = None,
    per_trigger: int = 1,
) -> StreamingQuery:
    """Start working off the batches in ``folder``, ``per_trigger`` at a time, and return the running query.

    ``work`` takes a batch's rows and returns the rows to write, as Parquet under ``out``; it may call a model.
    ``every`` is the time between batches, such as ``"60 seconds"``; None works off what is there without
    waiting and stops. With an interval the query runs until it is stopped, and takes up batches that are
    written to ``folder`` later. A trigger has a cost of its own, whatever its rows; where no limit asks for one
    batch at a time, more of them share it, and as many are worked off again after a failure.
    """
    if per_trigger < 1:
        raise ValueError("per_trigger must be positive")
    batches = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    writer = work(batches).writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", checkpoint
    ).outputMode("append")
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return writer.start()
