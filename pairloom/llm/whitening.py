"""Whitened embeddings from a covariance weighted by how often each vector occurs.

Vectors are put on an integer grid; equal ones are grouped before any arithmetic, so that sums,
covariance and projection are done once per distinct vector, the fit with its number of copies as
weight. What meets on the driver is one row of d numbers per dimension: it grows with the width of the
vectors, not with the table.

Defined results: a vector that is null, empty, holds a null or non-finite entry, or has an entry whose
grid value leaves the range of a 64-bit integer takes no part. Vectors of several widths have no
common covariance; those of the most frequent width (of the larger, in a tie) are whitened and the others take
no part. Directions in which the data do not vary (variance up to `FLAT` of the largest) have no whitened
value: fewer components come back, none at all for an empty table or one distinct vector. Rows that repeat an id
are rows of their own, and rows with a null id come back with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.checks import named, need_columns
from pairloom.llm.common import arrow_batches
from pairloom.storage import materialize

#: Grid of the vectors: x = floor(GRID * entry) + OFFSET.
GRID, OFFSET = 1024, 100_000

#: Share of the largest variance below which a direction counts as without variance.
FLAT = 1e-10

#: Grid values stay below this, so that differences and offsets fit a long.
_MOST = float(1 << 62)


def grid_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, x``: the usable vectors on the integer grid."""
    need_columns(table, key, vector)

    def usable(entry: Column) -> Column:
        at = entry.cast("double") * GRID
        return F.coalesce(~F.isnan(at) & (F.abs(at) < _MOST), F.lit(False))

    def on_grid(entry: Column) -> Column:
        # Spark may put an entry on the grid before it drops the row.
        return F.when(usable(entry), F.floor(entry.cast("double") * GRID) + OFFSET)

    kept = table.where((F.size(named(vector)) > 0) & F.forall(named(vector), usable))
    rows = kept.select(
        named(key).cast("long").alias("key"), F.transform(named(vector), on_grid).alias("x")
    )
    widths = rows.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), F.desc("width")
    ).limit(2).collect()
    return rows.where(F.size("x") == widths[0]["width"]) if len(widths) > 1 else rows


def _matrix(batch: pa.RecordBatch, name: str, kind=np.float64) -> np.ndarray:
    values = batch.column(name).flatten().to_numpy(zero_copy_only=False)
    return values.astype(kind, copy=False).reshape(batch.num_rows, -1)


def _exact_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per dimension the sum of weight * x over a task's rows, exact, as text: it may leave the longs."""
    totals: list[int] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        x, weight = _matrix(batch, "x", np.int64), batch.column("weight").to_numpy()
        least = x.min(axis=0)
        # What is left above the least value is summed in longs where it provably fits.
        above, n = x - least, int(weight.sum())
        fits = float(above.max()) * n < _MOST
        sums = weight @ above if fits else weight.astype(object) @ above.astype(object)
        found = [int(s) + n * int(low) for s, low in zip(sums, least)]
        totals = [a + b for a, b in zip(totals, found)] if totals else found
    yield pa.RecordBatch.from_pydict({
        "at": pa.array(range(len(totals)), pa.int32()), "total": pa.array(map(str, totals), pa.string()),
    })


def exact_sums(distinct: DataFrame) -> list[int]:
    """Σ weight * x per dimension of ``distinct (x, weight)``."""
    parts = distinct.select("x", "weight").mapInArrow(_exact_sums, "at int, total string")
    sums = parts.groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    return [int(row["total"]) for row in sums.orderBy("at").collect()]


def weighted_covariance(table: DataFrame, vector: str, centre: list[float], n: int) -> np.ndarray:
    """Σ weight (v - centre)(v - centre)ᵀ / n over ``table (vector, weight)``, centred before multiplying.

    One matrix product per batch, one block of d rows per task; the blocks are added up on Spark.
    """
    middle, width = np.array(centre), len(centre)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                off = _matrix(batch, vector) - middle
                block += (off * batch.column("weight").to_numpy()[:, None]).T @ off
        yield pa.RecordBatch.from_pydict({
            "row": pa.array(range(width), pa.int32()),
            "line": pa.array(block.tolist(), pa.list_(pa.float64())),
        })

    parts = table.select(vector, "weight").mapInArrow(products, "row int, line array<double>")
    added = parts.select("row", F.posexplode("line").alias("at", "value")).groupBy("row", "at").agg(
        F.sum("value").alias("value")
    ).toPandas()
    out = np.zeros((width, width))
    out[added["row"], added["at"]] = added["value"] / n
    return (out + out.T) / 2


@dataclass(frozen=True)
class Whitening:
    """Exact sums, and the leading directions of the covariance with their variances."""

    n: int
    sums: list[int]
    directions: np.ndarray
    variances: np.ndarray
    explained: np.ndarray

    @property
    def mean(self) -> list[float]:
        return [total / self.n for total in self.sums]


def fit_whitening(distinct: DataFrame, components: int = 8) -> Whitening | None:
    """Fit on ``distinct (x, weight)``; None where there is nothing to fit."""
    n = distinct.agg(F.sum("weight")).first()[0]
    if not n:
        return None
    sums = exact_sums(distinct)
    covariance = weighted_covariance(distinct, "x", [total / n for total in sums], n)
    variances, directions = np.linalg.eigh(covariance)
    variances, directions = variances[::-1], directions[:, ::-1]
    kept = min(components, int((variances > FLAT * max(variances[0], 0)).sum()))
    trace = float(np.trace(covariance))
    return Whitening(
        n, sums, directions[:, :kept], variances[:kept], variances[:kept] / trace if trace else variances[:0]
    )


def _squares(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Σ (n x - S)² per row, exact: in longs where they provably suffice, else in Python's integers."""
    most = max(abs(n * value - total) for line in (x.max(axis=0), x.min(axis=0))
               for value, total in zip(map(int, line), sums))
    if most * most * len(sums) < 1 << 62 and n * int(np.abs(x).max()) < 1 << 62:
        off = n * x - np.array(sums)
        return (off * off).sum(axis=1).tolist()
    total = np.array(sums, object)
    return [int((d * d).sum()) for d in (n * row.astype(object) - total for row in x)]


def whiten_distinct(distinct: DataFrame, model: Whitening) -> DataFrame:
    """``x, weight, deviation (decimal), whitened (array)`` for each distinct vector."""
    scaled = model.directions / np.sqrt(model.variances)
    n, sums, mean = model.n, model.sums, np.array(model.mean)
    build = arrow_batches({
        "x": pa.list_(pa.int64()), "weight": pa.int64(), "deviation": pa.string(),
        "whitened": pa.list_(pa.float64()),
    })

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, "x", np.int64)
            yield build(
                batch.column("x"), batch.column("weight"), list(map(str, _squares(x, n, sums))),
                ((x - mean) @ scaled).tolist(),
            )

    found = distinct.select("x", "weight").mapInArrow(
        project, "x array<bigint>, weight bigint, deviation string, whitened array<double>"
    )
    return found.withColumn("deviation", F.expr("try_cast(deviation AS decimal(38,0))"))


def identity_error(whitened: DataFrame, n: int, width: int) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    means = whitened.select("weight", F.posexplode("whitened").alias("at", "value")).groupBy("at").agg(
        (F.sum(F.col("value") * F.col("weight")) / n).alias("mean")
    ).orderBy("at").collect()
    covariance = weighted_covariance(whitened, "whitened", [row["mean"] for row in means], n)
    return float(np.abs(covariance - np.eye(width)).max())


SCHEMA = (
    "key bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, "
    "identity_error double"
)


def whiten(
    table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8
) -> DataFrame:
    """One row per vector and component: the key under its name, ``component`` from 1, ``n``, ``deviation``
    (null where it has more than 38 digits), ``whitened``, ``explained`` and ``identity_error``.

    A frequent vector meets its one whitened row in a join that Spark may split at run time.
    """
    spark = table.sparkSession
    rows = grid_vectors(table, key, vector)
    distinct = materialize(rows.groupBy("x").agg(F.count("*").alias("weight")), "distinct")
    model = fit_whitening(distinct, components)
    if model is None or not len(model.variances):
        return spark.createDataFrame([], SCHEMA).withColumnRenamed("key", key)
    whitened = materialize(whiten_distinct(distinct, model), "whitened")
    error = identity_error(whitened, model.n, len(model.variances))
    shares = F.array(*(F.lit(float(share)) for share in model.explained))
    joined = rows.join(whitened, "x").select(
        "key", "deviation", shares.alias("shares"), F.posexplode("whitened").alias("at", "whitened")
    )
    return joined.select(
        F.col("key").alias(key), (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at("shares", F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
