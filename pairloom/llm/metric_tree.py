"""Exact top-k by inner product on an M-tree, searched best-first.

Vectors are integers. With one more component, ``sqrt(largest squared norm - own squared norm)``, and 0
for a query, the Euclidean distance falls as the inner product grows, so a metric tree answers the
search. The tree has three levels: routing objects chosen from a bounded sample, each with the cell of rows
nearest to it; pages of a cell, each with a routing object of its own, its covering radius and the
distance to its parent; and entries, each with the distance to its page's routing object.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.checks import named, need_columns
from pairloom.llm.common import arrow_batches, partitions
from pairloom.storage import materialize

#: Rows in the sample that routing objects come from and that gives each query its first bound.
SAMPLE, ROUTING = 2048, 128
#: Rows of a page, and of the part of a cell that one group holds.
PAGE, PART = 256, 16_384
#: Slack of a bound for rounding, in units of the integer vectors' distance.
SLACK = 1e-3


def integer_vectors(
    table: DataFrame, key: str, vector: str, scale: int = 1024
) -> DataFrame:
    """``vec_id, v (array of long)``: floor(scale * x) of rows whose components are all finite."""
    need_columns(table, key, vector)
    x = F.transform(named(vector), lambda e: e.cast("double"))
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return table.select(
        named(key).cast("long").alias("vec_id"),
        F.when(finite, F.transform(x, lambda e: F.floor(e * scale))).alias("v"),
    ).where("v IS NOT NULL")


def _squares(v: Column) -> Column:
    return F.aggregate(v, F.lit(0).cast("long"), lambda total, e: total + e * e)


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """Integer rows of one width, shorter ones filled up with 0."""
    out = np.zeros((len(column), width), np.int64)
    for i, row in enumerate(column.to_pylist()):
        out[i, : len(row)] = row
    return out


class _Space:
    """Distances between rows and from queries to rows."""

    def __init__(self, width: int, largest: int):
        self.width, self.largest = width, largest

    def lift(self, rows: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.largest - (rows * rows).sum(axis=1), 0))
        return np.concatenate([rows.astype(np.float64), rest[:, None]], axis=1)

    def lift_queries(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([rows.astype(np.float64), np.zeros((len(rows), 1))], axis=1)

    def reach(self, query: np.ndarray, score: float) -> float:
        """The distance of a row with this score; rows further away score less."""
        squared = float(query @ query) + self.largest - 2 * score
        return np.sqrt(max(squared, 0.0)) + SLACK


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    squared = (left**2).sum(1)[:, None] + (right**2).sum(1)[None] - 2 * left @ right.T
    return np.sqrt(np.maximum(squared, 0))


def build_pages(vectors: DataFrame, space: _Space, routing: np.ndarray) -> DataFrame:
    """Leaf pages: ``cell, part, radius, parent, ids, rows, near`` with the routing object as first row."""
    objects = space.lift(routing)
    build = arrow_batches({
        "cell": pa.int32(), "second": pa.int32(), "distance": pa.float64(), "vec_id": pa.int64(),
        "row": pa.binary(),
    })

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _rows(batch.column("v"), space.width)
            found = distances(space.lift(rows), objects)
            cell = found.argmin(axis=1)
            near = found[np.arange(len(rows)), cell]
            found[np.arange(len(rows)), cell] = np.inf
            yield build(
                cell.astype(np.int32), found.argmin(axis=1).astype(np.int32), near,
                batch.column("vec_id"), [row.tobytes() for row in rows],
            )

    placed = materialize(vectors.mapInArrow(
        assign, "cell int, second int, distance double, vec_id long, row binary"
    ), "cells")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("size"))
    parts = F.ceil(F.col("size") / PART).cast("long")
    spread = placed.join(sizes, "cell").withColumn(
        "part", F.pmod(F.xxhash64("vec_id", "row"), parts).cast("int")
    )
    spread = spread.repartition(partitions(vectors.sparkSession), "cell", "part").sortWithinPartitions(
        "cell", "part", "second", "distance", "vec_id"
    )
    page = arrow_batches({
        "cell": pa.int32(), "part": pa.int32(), "radius": pa.float64(), "parent": pa.float64(),
        "ids": pa.binary(), "rows": pa.binary(), "near": pa.binary(),
    })

    def fill(batches):
        group, ids, rows = None, [], []

        def close():
            matrix = np.frombuffer(b"".join(rows), np.int64).reshape(-1, space.width)
            lifted = space.lift(matrix)
            near = distances(lifted, lifted[:1])[:, 0]
            near[0] = 0.0
            parent = float(distances(lifted[:1], objects[group[0] : group[0] + 1])[0, 0])
            return page(
                [group[0]], [group[1]], [float(near.max())], [parent],
                [np.array(ids, np.int64).tobytes()], [matrix.tobytes()], [near.tobytes()],
            )

        for batch in batches:
            names = ("cell", "part", "vec_id", "row")
            for cell, part, key, row in zip(*(batch.column(n).to_pylist() for n in names)):
                if ids and (group != (cell, part) or len(ids) == PAGE):
                    yield close()
                    ids, rows = [], []
                group = (cell, part)
                ids.append(key)
                rows.append(row)
        if ids:
            yield close()

    return spread.select("cell", "part", "vec_id", "row").mapInArrow(
        fill, "cell int, part int, radius double, parent double, ids binary, rows binary, near binary"
    )


class _Page:
    def __init__(self, row: dict, space: _Space):
        self.radius, self.parent = row["radius"], row["parent"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.rows = np.frombuffer(row["rows"], np.int64).reshape(-1, space.width)
        self.near = np.frombuffer(row["near"], np.float64)
        self.center = space.lift(self.rows[:1])[0]


def search_part(
    pages: list[_Page], parents: np.ndarray, radii: np.ndarray, query: np.ndarray, own: int,
    from_parent: float, k: int, floor: float, space: _Space,
) -> list[tuple[int, int]]:
    """The best ``(score, id)`` of these pages with a score of at least ``floor``, at most ``k``.

    Pages wait in a heap by the least distance that any of their entries can have: first by the bound
    that needs no distance, from the distances to the common parent, then by the one from the page's own
    routing object. Entries are passed over by their stored distance to it, the others are scored.
    """
    lifted = space.lift_queries(query[None])[0]
    best: list[tuple[int, int]] = []
    reach = space.reach(query, floor) if np.isfinite(floor) else np.inf
    bounds = np.maximum(np.abs(from_parent - parents) - radii, 0.0)
    heap = [(b, 0, i, 0.0) for i, b in enumerate(bounds.tolist()) if b <= reach]
    heapq.heapify(heap)
    while heap:
        bound, seen, at, found = heapq.heappop(heap)
        if bound > reach:
            break
        page = pages[at]
        if not seen:
            found = float(np.sqrt(((lifted - page.center) ** 2).sum()))
            bound = max(bound, found - page.radius)
            if bound <= reach:
                heapq.heappush(heap, (bound, 1, at, found))
            continue
        open_rows = np.flatnonzero((np.abs(found - page.near) <= reach) & (page.ids != own))
        scores = page.rows[open_rows] @ query
        for score, key in zip(scores.tolist(), page.ids[open_rows].tolist()):
            if score < floor:
                continue
            entry = (score, -key)
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
        if len(best) == k and best[0][0] >= floor:
            floor = best[0][0]
            reach = space.reach(query, floor)
    return [(score, -key) for score, key in best]


def top_k(
    table: DataFrame, queries: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding",
    scale: int = 1024,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows with the largest integer inner product.

    ``queries`` says which rows ask. All rows but the query's own id are candidates, ties go to the smaller
    id. Exact: a row is passed over only where the triangle inequality, with slack for rounding, shows
    that it scores less than ``k`` others.

    Only a sample of ``SAMPLE`` rows (the first by hash) and one number per cell come to the driver. A query
    goes to the cells its first bound leaves open; a cell's rows are split into parts of about ``PART``, so
    rows that are all alike do not meet in one task.

    Vectors that are null or hold nulls, NaN or infinities take no part; shorter vectors count as filled up
    with 0; a row without id is no candidate; an id that repeats asks once, with its least vector, and its
    rows are candidates of others each on its own. An empty table gives no rows.
    """
    vectors = materialize(
        integer_vectors(table, key, vector, scale).where("vec_id IS NOT NULL"), "vectors"
    )
    shape = vectors.agg(
        F.max(F.size("v")).alias("width"), F.max(_squares(F.col("v"))).alias("largest")
    ).first()
    space = _Space(max(1, shape["width"] or 0), shape["largest"] or 0)
    sample = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).toArrow()
    sample_ids = np.array(sample.column("vec_id").to_pylist(), np.int64)
    sample_rows = _rows(sample.column("v"), space.width)
    routing = np.unique(sample_rows, axis=0)
    routing = routing[:: max(1, -(-len(routing) // ROUTING))]
    if not len(routing):
        routing = np.zeros((1, space.width), np.int64)
    pages = materialize(build_pages(vectors, space, routing), "pages")
    cells = {
        row["cell"]: (row["radius"], row["parts"])
        for row in pages.groupBy("cell").agg(
            F.max(F.col("radius") + F.col("parent")).alias("radius"), (F.max("part") + 1).alias("parts")
        ).collect()
    }
    asking = table.select(named(key).cast("long").alias("vec_id"), queries.alias("asks")).where(
        "asks AND vec_id IS NOT NULL"
    ).select("vec_id").distinct()
    asked = vectors.join(asking, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))
    build = arrow_batches({
        "cell": pa.int32(), "part": pa.int32(), "query": pa.int64(), "floor": pa.float64(),
        "distance": pa.float64(), "row": pa.binary(),
    })

    def route(batches):
        objects = space.lift(routing)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _rows(batch.column("v"), space.width)
            found = distances(space.lift_queries(rows), objects)
            out = []
            for i, own in enumerate(batch.column("vec_id").to_pylist()):
                scores = (sample_rows @ rows[i])[sample_ids != own]
                floor = float(np.sort(scores)[-k]) if len(scores) >= k else float("-inf")
                reach = space.reach(rows[i], floor) if np.isfinite(floor) else np.inf
                for cell, (radius, parts) in cells.items():
                    if found[i, cell] - radius <= reach + SLACK:
                        for part in range(parts):
                            out.append((cell, part, own, floor, float(found[i, cell]), rows[i].tobytes()))
            yield build(*(list(zip(*out)) or [[]] * 6))

    routed = asked.mapInArrow(
        route, "cell int, part int, query long, floor double, distance double, row binary"
    )
    pages = pages.selectExpr(
        "cell", "part", "radius", "parent", "ids", "rows", "near", "CAST(NULL AS long) AS query",
        "CAST(NULL AS double) AS floor", "CAST(NULL AS double) AS distance", "CAST(NULL AS binary) AS row",
    )
    empty = ("radius double", "parent double", "ids binary", "rows binary", "near binary")
    both = pages.unionByName(reduce(
        lambda df, part: df.withColumn(part.split()[0], F.lit(None).cast(part.split()[1])), empty, routed
    ))
    both = both.repartition(partitions(table.sparkSession), "cell", "part").sortWithinPartitions(
        "cell", "part", F.col("query").asc_nulls_first()
    )
    answer = arrow_batches({"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()})

    def search(batches):
        group, held, parents, radii = None, [], None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if group != (row["cell"], row["part"]):
                    group, held, parents = (row["cell"], row["part"]), [], None
                if row["query"] is None:
                    held.append(_Page(row, space))
                    continue
                if parents is None:
                    parents = np.array([page.parent for page in held])
                    radii = np.array([page.radius for page in held])
                query = np.frombuffer(row["row"], np.int64)
                out += [
                    (row["query"], key, score) for score, key in search_part(
                        held, parents, radii, query, row["query"], row["distance"], k, row["floor"], space
                    )
                ]
            if out:
                yield answer(*zip(*out))

    found = both.mapInArrow(search, "query_id long, vec_id long, score long")
    # Spark keeps the first k of each query per task before it shuffles.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
