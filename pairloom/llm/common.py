"""What the operators of this subpackage share.

All of them read only the columns they name, so further columns of any name do no harm, and all treat
a null text as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.checks import named, need_columns
from pairloom.storage import materialize

#: Rows of a batch that goes to Python: long texts then stay within a worker's memory.
ARROW_ROWS = 1000

#: Entries that a worker's word cache holds before it starts anew; a bound on memory, not on words.
CACHE_WORDS = 400_000


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_and_text(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The two columns as ``key`` (long) and ``text``, a null text as an empty one."""
    need_columns(docs, key, text)
    return docs.select(
        named(key).cast("long").alias("key"), F.coalesce(named(text), F.lit("")).alias("text")
    )


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class WordHashes(dict):
    """64-bit hash of each word, computed once per worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    values = values ^ (values >> np.uint64(31))
    values = values * _MIX
    values = values ^ (values >> np.uint64(29))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words; a shorter sequence is one run, none has none."""
    size = min(size, len(hashes))
    if not size:
        return hashes
    count = len(hashes) - size + 1
    value = np.full(count, size, np.uint64)
    for k in range(size):
        value = mix(value ^ hashes[k : k + count]) + _MIX
    return value


def arrow_batches(columns: dict[str, pa.DataType]):
    """A function from lists of values to a record batch of these columns."""
    schema = pa.schema(list(columns.items()))

    def build(*values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(values, schema.types)],
            schema=schema,
        )

    return build


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Values row by row."""
    for batch in batches:
        yield from zip(*(batch.column(name).to_pylist() for name in names))


def whole_groups(batches: Iterator[pa.RecordBatch], names: Sequence[str], least: int) -> Iterator[pa.Table]:
    """Batches sorted by ``names`` as tables of about ``least`` rows; all rows of a group are in one table."""
    held, count = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < least:
            continue
        table = pa.Table.from_batches(held)
        places = [table.column(name).to_numpy() for name in names]
        last = np.logical_and.reduce([values == values[-1] for values in places])
        whole = int(last.argmax())  # the rows of all groups but the one under way
        if whole:
            yield table.slice(0, whole)
        held, count = table.slice(whole).to_batches(), table.num_rows - whole
    if held:
        yield pa.Table.from_batches(held)


def in_blocks(buckets: DataFrame, limit: int) -> DataFrame:
    """Each row of a bucket with its ``block``, once for each pair ``x, y`` of blocks that it takes part in.

    ``size`` rows of a bucket, of which ``most`` are in its largest component, ``major``. A bucket of up to
    ``limit`` rows is one block. The blocks of a larger one have a third of that on average, so that two of
    them stay below it; those of the largest component come first and meet the later ones alone, which
    meet each other too.
    """
    def blocks(rows: Column) -> Column:
        return F.when(F.col("size") <= limit, 0).otherwise(F.ceil(3 * rows / limit)).cast("int")

    placed = buckets.select(
        "*", blocks(F.col("most")).alias("of_major"), blocks(F.col("size") - F.col("most")).alias("of_rest"),
        (F.col("component") == F.col("major")).alias("is_major"), F.xxhash64("band", "key").alias("chance"),
    ).withColumn(
        "block", F.when(F.col("of_rest") == 0, 0).when(
            F.col("is_major"), F.pmod("chance", "of_major")
        ).otherwise(F.col("of_major") + F.pmod("chance", "of_rest")).cast("int")
    )
    meets = F.when(F.col("of_rest") == 0, F.array(F.lit(0))).otherwise(F.sequence(
        F.when(F.col("is_major"), F.col("of_major")).otherwise(0), F.col("of_major") + F.col("of_rest") - 1
    ))
    return placed.withColumn("other", F.explode(meets)).select(
        "band", "number", "key", "component", "block",
        F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
    )


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component``: the smallest node that each node of ``edges (a, b)`` reaches.

    Alternates two rewritings (Kiveris et al., "Connected Components in MapReduce and Beyond"): each
    node's larger neighbours, then its smaller ones, are linked to its least neighbour, until every
    edge leads to the least node of its component. Each round is written to the shared folder. Nodes
    are longs; nulls and loops are left out; an empty table gives an empty one.
    """
    edges = edges.where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).distinct()
    edges = materialize(edges, "edges")

    def state(table: DataFrame) -> tuple:
        return tuple(table.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first())

    before = state(edges)
    for _ in range(rounds if before[0] else 0):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        larger = both.where("b > a").join(least, "a").select(
            F.col("least").alias("a"), "b"
        ).where("a <> b").distinct()
        # here a < b on each edge: the least neighbour of b is the least a
        down = larger.groupBy("b").agg(F.min("a").alias("least"))
        joined = larger.join(down, "b")
        smaller = joined.select(
            F.explode(F.array(
                F.struct(F.col("least").alias("a"), F.col("b").alias("b")),
                F.struct(F.col("least").alias("a"), F.col("a").alias("b")),
            )).alias("e")
        ).select("e.a", "e.b").where("a <> b").distinct()
        edges = materialize(smaller, "edges")
        # Stable when no edge changes: count and an order-free sum tell.
        now = state(edges)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    members = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return members.unionByName(roots)
