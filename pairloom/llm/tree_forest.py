"""Near-duplicate embeddings by a forest of random-projection trees.

Equal vectors are grouped first. Trees are grown on a bounded sample: a node is split at the projection on a
random direction, where the fewest sampled vectors lie near the cut; vectors within a margin of the cut go to both
sides (spill). Trees are added until the chance that a pair right at the threshold shares no leaf in any
tree is below a stated one; the chance per tree is measured on made-up partners of the sampled
vectors. All vectors are passed down all trees. Leaves that turn out too large are split on by trees grown on
a sample of their own, round by round. Vectors are compared within leaves in double precision, each pair in the
first leaf that both are in, so links are counted, never listed, and each leaf sends only a spanning forest of
its links to the union.

A family of near copies may hold any share of the rows, all in one leaf of each tree. `balls` finds such
families on the sample: vectors within half the threshold's angle of a centre are linked with each other by
the triangle inequality and need no comparison. What a leaf holds beyond `LEAF_ROWS` is compared in blocks, of
which those within one ball are left out.

Defined results: a vector that is null, empty, all zero or holds a null or non-finite entry links with
nothing, and neither do vectors of different widths or rows without an id (whose component is null). Rows that
repeat an id are vectors of their own, but one node when components are formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import acos, cos, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.checks import named, need_columns
from pairloom.llm.common import arrow_batches, connected_components, mix
from pairloom.storage import materialize

#: Vectors that the trees are grown on, and those of them that families of near copies are looked for in.
SAMPLE, BALL_SAMPLE = 16_384, 4096

#: Vectors of the sample that a family must hold, and most families.
FAMILY, FAMILIES = 32, 128

#: Rows that a leaf should have, that it may have before it is split on, and those sampled for that.
LEAF, LEAF_ROWS, LEAF_SAMPLE = 256, 2048, 512

#: Directions of a tree, directions that a node tries, and the least sampled vectors of a leaf.
DIRECTIONS, TRIES, FEWEST = 48, 4, 8

#: Margin of a split, as a share of what a pair at the threshold is apart on average along a direction.
SPILL = 0.4

#: Chance that a pair right at the threshold is in no common leaf, and most trees.
MISS, TREES = 1e-4, 64


def _usable() -> Column:
    """Whether ``key, v`` is a row with an id and a finite vector that is not all zero."""

    def finite(x: Column) -> Column:
        return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))

    sound = (F.size("v") > 0) & F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    return F.col("key").isNotNull() & F.coalesce(sound, F.lit(False))


def keyed_vectors(table: DataFrame, key: str, vector: str) -> DataFrame:
    """``key, v``: the id as a long, the vector as floats if it holds such, else as doubles."""
    need_columns(table, key, vector)
    v = named(vector)
    if table.schema[vector].dataType.elementType.typeName() != "float":
        v = v.cast("array<double>")
    return table.select(named(key).cast("long").alias("key"), v.alias("v"))


def _units(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1, shorter ones filled up with 0, and their own widths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    widths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = np.zeros((len(widths), width))
    rows[np.arange(width) < widths[:, None]] = flat
    rows /= np.abs(rows).max(axis=1, keepdims=True)  # squares of any finite entries then stay finite
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True)), widths


@dataclass
class Tree:
    """A node's cut and children; a leaf has no children (-1)."""

    directions: np.ndarray
    margin: float
    turn: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    depth: int = 0

    def _leaf(self) -> int:
        self.turn.append(0)
        self.cut.append(0.0)
        self.left.append(-1)
        self.right.append(-1)
        return len(self.cut) - 1

    def grow(self, projected: np.ndarray, leaf: float) -> Tree:
        """Split until at most ``leaf`` sampled vectors are in a node, or no direction parts them."""
        pending = [(self._leaf(), np.arange(len(projected)), 0, 0)]
        while pending:
            node, rows, level, turn = pending.pop()
            self.depth = max(self.depth, level)
            if len(rows) <= leaf:
                continue
            split = None
            for attempt in range(TRIES):
                at = (turn + attempt) % projected.shape[1]
                values = projected[rows, at]
                cuts = np.quantile(values, np.linspace(0.3, 0.7, 9))
                near = (np.abs(values[:, None] - cuts) <= self.margin).sum(axis=0)
                cut = float(cuts[near.argmin()])
                below, above = rows[values < cut + self.margin], rows[values >= cut - self.margin]
                if max(len(below), len(above)) <= 0.85 * len(rows):
                    split = at, cut, below, above
                    break
            if split is None:
                continue
            at, cut, below, above = split
            self.turn[node], self.cut[node] = at, cut
            self.left[node], self.right[node] = self._leaf(), self._leaf()
            pending += [(self.left[node], below, level + 1, at + 1), (self.right[node], above, level + 1, at + 1)]
        return self

    def leaves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row number and leaf of each place that the rows fall to."""
        projected = rows @ self.directions
        turn, cut = np.array(self.turn), np.array(self.cut)
        left, right = np.array(self.left), np.array(self.right)
        row, node, done = np.arange(len(rows)), np.zeros(len(rows), np.int64), []
        while len(row):
            ended = left[node] < 0
            done.append((row[ended], node[ended]))
            row, node = row[~ended], node[~ended]
            off = projected[row, turn[node]] - cut[node]
            below, above = off < self.margin, off >= -self.margin
            row, node = (
                np.concatenate([row[below], row[above]]), np.concatenate([left[node[below]], right[node[above]]])
            )
        return np.concatenate([r for r, _ in done]), np.concatenate([n for _, n in done])


def _new_tree(width: int, seed: tuple[int, ...], threshold: float) -> Tree:
    directions = np.random.default_rng(seed).standard_normal((width, DIRECTIONS))
    directions /= np.sqrt((directions * directions).sum(axis=0))
    return Tree(directions, SPILL * sqrt((2 - 2 * threshold) / width))


def _shares_no_leaf(tree: Tree, rows: np.ndarray, partners: np.ndarray) -> float:
    """The share of pairs that a tree parts."""
    mine, theirs = tree.leaves(rows), tree.leaves(partners)
    nodes = len(tree.cut)
    both = np.intersect1d(mine[0] * nodes + mine[1], theirs[0] * nodes + theirs[1]) // nodes
    return 1 - len(np.unique(both)) / len(rows)


def grow_forest(sample: np.ndarray, total: int, threshold: float, miss: float) -> list[Tree]:
    """As many trees as it takes for pairs right at the threshold."""
    width = sample.shape[1]
    rng = np.random.default_rng(7)
    noise = rng.standard_normal(sample.shape)
    noise -= (noise * sample).sum(axis=1, keepdims=True) * sample
    noise /= np.maximum(np.sqrt((noise * noise).sum(axis=1, keepdims=True)), 1e-300)
    partners = threshold * sample + sqrt(1 - threshold * threshold) * noise
    leaf = max(FEWEST, LEAF * len(sample) / max(total, 1))
    deeper = max(0.0, log(leaf * total / max(len(sample), 1) / LEAF_ROWS) / log(1.7)) if total else 0.0
    trees, missed = [], 1.0
    while missed > miss and len(trees) < TREES:
        tree = _new_tree(width, (width, len(trees)), threshold)
        tree.grow(sample @ tree.directions, leaf)
        trees.append(tree)
        if tree.depth == 0:
            break  # all vectors are in one leaf
        parted = max(_shares_no_leaf(tree, sample, partners), 1 / len(sample))
        missed *= 1 - (1 - parted) ** (1 + deeper / tree.depth)
    return trees


def balls(sample: np.ndarray, radius: float, threshold: float) -> np.ndarray:
    """Centres of families: what lies within ``radius`` (an angle) of one is linked with one another."""
    rows, centres = sample[:BALL_SAMPLE], []
    alike = rows @ rows.T >= threshold
    free = np.ones(len(rows), bool)
    while len(centres) < FAMILIES and free.any():
        counts = (alike & free).sum(axis=1) * free
        head = int(counts.argmax())
        if counts[head] < FAMILY:
            break
        centre = rows[alike[head] & free].sum(axis=0)
        centre /= sqrt(float(centre @ centre))
        inside = free & (rows @ centre >= cos(radius))
        if inside.sum() >= FAMILY:
            centres.append(centre)
        free &= ~inside & ~alike[head]
    return np.array(centres).reshape(len(centres), sample.shape[1])


def place(vectors: DataFrame, width: int, trees: list[Tree], centres: np.ndarray, radius: float) -> DataFrame:
    """Add ``ball`` (-1: none) and ``leaves`` (sorted) to ``vectors (class, rep, n, v)``."""
    kind = {"float": pa.float32(), "double": pa.float64()}[vectors.schema["v"].dataType.elementType.typeName()]
    build = arrow_batches({
        "class": pa.int64(), "rep": pa.int64(), "n": pa.int64(), "v": pa.list_(kind), "ball": pa.int32(),
        "leaves": pa.list_(pa.int64()),
    })

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, widths = _units(batch.column("v"), width)
            found = []
            for number, tree in enumerate(trees):
                row, node = tree.leaves(rows)
                code = widths[row] << 48 | number << 32 | node
                found.append((row, mix(code.astype(np.uint64)).view(np.int64)))
            row, leaf = (np.concatenate(part) for part in zip(*found))
            order = np.lexsort((leaf, row))
            ends = np.bincount(row, minlength=len(rows)).cumsum()
            leaves = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(leaf[order])
            )
            ball = np.full(len(rows), -1, np.int32)
            if len(centres):
                close = rows @ centres.T
                ball = np.where(close.max(axis=1) >= cos(radius), close.argmax(axis=1), -1).astype(np.int32)
            yield build(
                batch.column("class"), batch.column("rep"), batch.column("n"), batch.column("v").cast(pa.list_(kind)),
                pa.array(ball), leaves,
            )

    return vectors.mapInArrow(
        down, f"class long, rep long, n long, v array<{kind}>, ball int, leaves array<bigint>"
    )


def _grow_leaf(width: int, number: int, threshold: float):
    """A tree on the sampled rows of one leaf, as a row."""

    def grow(table: pa.Table) -> pa.Table:
        leaf, size = table.column("leaf")[0].as_py(), table.column("size")[0].as_py()
        rows, _ = _units(table.column("v"), width)
        tree = _new_tree(width, (width, number + 1, leaf & 0xFFFFFFFF), threshold)
        tree.grow(rows @ tree.directions, max(FEWEST, LEAF * len(rows) / size))
        return pa.table({
            "leaf": pa.array([leaf], pa.int64()), "turn": pa.array([tree.turn], pa.list_(pa.int32())),
            "cut": pa.array([tree.cut], pa.list_(pa.float64())),
            "left": pa.array([tree.left], pa.list_(pa.int32())),
            "right": pa.array([tree.right], pa.list_(pa.int32())),
        })

    return grow


def _pass_on(width: int, number: int, threshold: float):
    """Rows of large leaves to the leaves of the trees that come along with them."""
    build = arrow_batches({"class": pa.int64(), "leaf": pa.int64()})

    def pass_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, _ = _units(batch.column("v"), width)
            leaf = batch.column("leaf").to_numpy()
            name = batch.column("class").to_numpy()
            for one in np.unique(leaf):
                here = np.flatnonzero(leaf == one)
                tree = _new_tree(width, (width, number + 1, int(one) & 0xFFFFFFFF), threshold)
                tree.turn, tree.cut, tree.left, tree.right = (
                    batch.column(part)[int(here[0])].as_py() for part in ("turn", "cut", "left", "right")
                )
                row, node = tree.leaves(rows[here])
                code = mix(np.full(len(node), one).view(np.uint64)) + node.astype(np.uint64) + np.uint64(1)
                yield build(pa.array(name[here][row]), pa.array(mix(code).view(np.int64)))

    return pass_on


def split_large(placed: DataFrame, width: int, threshold: float, rounds: int = 40) -> DataFrame:
    """``placed`` with leaves of more than `LEAF_ROWS` rows split on, each by a tree grown on a sample of its rows.

    A leaf that no direction parts stays as it is; it is compared in blocks.
    """
    places = placed.select("class", F.explode("leaves").alias("leaf"))
    whole = None  # leaves that cannot be parted
    for number in range(rounds):
        large = places.groupBy("leaf").agg(F.count("*").alias("size")).where(F.col("size") > LEAF_ROWS)
        if whole is not None:
            large = large.join(whole, "leaf", "left_anti")
        large = materialize(large, "large-leaves")
        if not large.take(1):
            break
        there = materialize(
            places.join(large, "leaf").join(placed.select("class", "v"), "class").select("leaf", "size", "class", "v"),
            "in-large-leaves",
        )
        first = Window.partitionBy("leaf").orderBy(F.xxhash64("class"), "class")
        sample = there.withColumn("_at", F.row_number().over(first)).where(F.col("_at") <= LEAF_SAMPLE)
        trees = materialize(sample.select("leaf", "size", "class", "v").groupBy("leaf").applyInArrow(
            _grow_leaf(width, number, threshold),
            "leaf long, turn array<int>, cut array<double>, left array<int>, right array<int>"
        ), "leaf-trees")
        stuck = trees.where(F.size("cut") == 1).select("leaf")
        whole = stuck if whole is None else whole.unionByName(stuck)
        parted = there.join(trees.where(F.size("cut") > 1), "leaf").sortWithinPartitions("leaf").mapInArrow(
            _pass_on(width, number, threshold), "class long, leaf long"
        )
        split = trees.where(F.size("cut") > 1).select("leaf")
        places = materialize(places.join(split, "leaf", "left_anti").unionByName(parted), "places")
    else:
        raise RuntimeError(f"leaves did not settle in {rounds} rounds")
    if not number:
        return placed
    leaves = places.groupBy("class").agg(F.array_sort(F.collect_set("leaf")).alias("leaves"))
    return materialize(placed.drop("leaves").join(leaves, "class"), "placed")


def _exact(left: np.ndarray, right: np.ndarray) -> float:
    """The cosine in one order of summation, whatever matrix the pair was found in."""
    return float((left * right).sum()) / sqrt(float((left * left).sum()) * float((right * right).sum()))


def _compare(width: int, threshold: float):
    """Links of one group: rows of one leaf, or of two of its blocks."""
    near = 1e-9  # products closer than this to the threshold are computed anew, one by one

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        leaf, low, high = (value.as_py() for value in key)
        rows, widths = _units(table.column("v"), width)
        block = table.column("block").to_numpy()
        one, two = np.flatnonzero(block == low), np.flatnonzero(block == high)
        count, ball, rep = (table.column(name).to_numpy() for name in ("n", "ball", "rep"))
        found = rows[one] @ rows[two].T
        linked = found >= threshold - near
        linked &= (ball[one][:, None] != ball[two]) | (ball[one] < 0)[:, None]
        linked &= widths[one][:, None] == widths[two]
        if low == high:
            linked = np.triu(linked, 1)
        for i, j in np.argwhere(linked & (found < threshold + near)):
            linked[i, j] = _exact(rows[one[i]], rows[two[j]]) >= threshold
        mine, theirs = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
        if len(mine):
            # A pair counts in the first leaf that both rows are in.
            small = linked[np.ix_(mine, theirs)]
            small &= ~_met(table.column("leaves"), one[mine], two[theirs], leaf)
            linked[np.ix_(mine, theirs)] = small
        links = np.zeros(len(rows), np.int64)
        np.add.at(links, one, linked @ count[two])
        np.add.at(links, two, linked.T @ count[one])
        parents = _spanning(one, two, linked, rep)
        kept = np.flatnonzero(links)
        return pa.table({
            "class": table.column("class").take(pa.array(kept)), "links": pa.array(links[kept], pa.int64()),
            "a": pa.array(rep[kept], pa.int64()), "b": pa.array(parents[kept], pa.int64()),
        })

    return compare


def _met(leaves: pa.ChunkedArray, one: np.ndarray, two: np.ndarray, leaf: int) -> np.ndarray:
    """Which pairs of rows share a leaf that comes before this one."""
    met = np.zeros((len(one), len(two)), bool)
    columns: dict[int, list[int]] = {}
    lists = leaves.to_pylist()
    for at, row in enumerate(two):
        for other in lists[row]:
            if other >= leaf:
                break
            columns.setdefault(other, []).append(at)
    lines: dict[int, list[int]] = {}
    for at, row in enumerate(one):
        for other in lists[row]:
            if other >= leaf:
                break
            if other in columns:
                lines.setdefault(other, []).append(at)
    for other, ats in lines.items():
        met[np.ix_(ats, columns[other])] = True
    return met


def _spanning(one: np.ndarray, two: np.ndarray, linked: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """For each row the least id that it reaches within the group."""
    reach = rep.copy()
    lines = [(i, two[linked[at]]) for at, i in enumerate(one) if linked[at].any()]
    while True:
        before = reach.copy()
        for i, others in lines:
            least = min(int(reach[i]), int(reach[others].min()))
            reach[i] = least
            reach[others] = np.minimum(reach[others], least)
        if (before == reach).all():
            return reach


def _blocks(placed: DataFrame) -> DataFrame:
    """Rows dealt to the groups they are compared in: ``leaf, low, high, block, …``.

    A leaf of up to `LEAF_ROWS` rows is one group. A larger one is cut into blocks, the balls apart, and a group
    is a pair of blocks that are not of one ball.
    """
    rows = placed.select("*", F.explode("leaves").alias("leaf"))
    parts = rows.groupBy("leaf", "ball").agg(F.count("*").alias("_rows"))
    along = Window.partitionBy("leaf").orderBy("ball").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_all", F.sum("_rows").over(Window.partitionBy("leaf")))
    large = parts.where(F.col("_all") > LEAF_ROWS).withColumn(
        "_blocks", F.ceil(F.col("_rows") / LEAF_ROWS)
    ).withColumns({
        "_first": F.coalesce(F.sum("_blocks").over(along), F.lit(0)),
        "_of_all": F.sum("_blocks").over(Window.partitionBy("leaf")),
    }).select("leaf", "ball", "_blocks", "_first", "_of_all")
    large = materialize(large, "blocks")
    small = materialize(parts.where((F.col("_all") <= LEAF_ROWS) & (F.col("_all") > 1)).select("leaf").distinct(), "leaves")
    one = rows.join(small, "leaf").select(
        "*", F.lit(0).alias("block"), F.lit(0).alias("low"), F.lit(0).alias("high")
    )
    dealt = rows.join(large, ["leaf", "ball"]).withColumn(
        "block", (F.col("_first") + F.pmod(F.xxhash64("class"), F.col("_blocks"))).cast("int")
    ).withColumn("_other", F.explode(F.sequence(F.lit(0), (F.col("_of_all") - 1).cast("int"))))
    outside = (F.col("ball") < 0) | (F.col("_other") < F.col("_first")) | (
        F.col("_other") >= F.col("_first") + F.col("_blocks")
    )
    dealt = dealt.where(outside).withColumns({
        "low": F.least("block", "_other"), "high": F.greatest("block", "_other")
    }).drop("_blocks", "_first", "_of_all", "_other")
    return one.unionByName(dealt)


def near_copies(
    table: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, miss: float = MISS
) -> DataFrame:
    """One row per row: the key under its name, ``n_links``, ``component_id`` and ``kept``."""
    spark = table.sparkSession
    every = keyed_vectors(table, key, vector)
    rows = every.where(_usable())
    classes = materialize(
        rows.groupBy("v").agg(F.min("key").alias("rep"), F.count("*").alias("n")).withColumn(
            "class", F.monotonically_increasing_id()
        ),
        "distinct",
    )
    total, width = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    alone = every.where(~_usable()).select(
        "key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id")
    )
    out = F.col("key").alias(key), "n_links", "component_id", (F.col("key") == F.col("component_id")).alias("kept")
    if not total:
        return alone.select(*out)
    drawn = classes.select("class", "v").orderBy(F.xxhash64("v"), "class").limit(SAMPLE).toArrow()
    sample, _ = _units(drawn.column("v"), width)
    radius = acos(threshold) / 2 - 1e-9
    trees = grow_forest(sample, total, threshold, miss)
    centres = balls(sample, radius, threshold)
    placed = materialize(place(classes.select("class", "rep", "n", "v"), width, trees, centres, radius), "placed")
    placed = split_large(placed, width, threshold)
    groups = _blocks(placed).select("leaf", "low", "high", "block", "class", "rep", "n", "v", "ball", "leaves")
    found = materialize(groups.groupBy("leaf", "low", "high").applyInArrow(
        _compare(width, threshold), "class long, links long, a long, b long"
    ), "links")
    # Members of a ball of one width are all linked.
    families = placed.where("ball >= 0").groupBy("ball", F.size("v").alias("width")).agg(
        F.sum("n").alias("family"), F.min("rep").alias("head")
    )
    inside = placed.where("ball >= 0").select("class", "rep", "n", "ball", F.size("v").alias("width")).join(
        materialize(families, "families"), ["ball", "width"]
    )
    joined = rows.join(classes, "v").select("key", "class", "rep", F.col("n").alias("copies"))
    joined = materialize(joined, "members")
    repeated = joined.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key")
    edges = found.select("a", "b").unionByName(
        inside.select(F.col("head").alias("a"), F.col("rep").alias("b"))
    ).unionByName(
        joined.join(repeated, "key").select(F.col("key").alias("a"), F.col("rep").alias("b"))
    )
    components = connected_components(edges)
    links = found.select("class", "links").unionByName(
        inside.select("class", (F.col("family") - F.col("n")).alias("links"))
    ).groupBy("class").agg(F.sum("links").alias("links"))
    counted = classes.select("class", "rep", "n").join(links, "class", "left").join(
        components.withColumnRenamed("node", "rep"), "rep", "left"
    ).select(
        "class", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    linked = joined.select("key", "class").join(materialize(counted, "counted"), "class").select(
        "key", "n_links", "component_id"
    )
    return linked.unionByName(alone).select(*out)
