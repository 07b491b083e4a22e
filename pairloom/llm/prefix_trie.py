"""A trie of the prefixes that conversations share, with totals of every subtree.

A node is one distinct sequence of first turns. It is named by a digest that grows turn by turn (the sum
of two 60-bit hashes of each turn at its place), so prefixes are numbered by running sums, in chunks of
a conversation, and no text is compared or carried along.

Subtree totals are found by time-forward processing (Chiang et al., "External-memory graph algorithms"):
nodes are sorted by falling depth, and each sends its total to its parent through a priority queue, which
hands it over when the parent's turn comes. Shards are whole subtrees with at most `MEMBERS`
conversations; their roots' totals are summed up as messages to what stands above, which is cut into shards
of `MEMBERS` times as many conversations, and so on until the root. A shard is never held in memory: Spark
sorts it, spilling to disk, and the queue spills too.

Defined results: rows without a conversation id take no part; a null role or text counts as empty;
turns without a number come first; equal numbers are ordered by role and text, repeated rows are turns
of their own. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.checks import named, need_columns
from pairloom.llm.common import arrow_batches, rows_of
from pairloom.operators.rows import row_order
from pairloom.storage import materialize

#: Conversations in a shard of the lowest level; each level above has so many times more.
MEMBERS = 100

#: Turns of a conversation whose running sums one task forms.
CHUNK = 1000

#: Messages that a queue holds in memory before it writes a sorted run to the task's scratch space.
HELD = 500_000

#: Ids that one text holds when the members that end at a node are strung together.
STRUNG = 5000


def in_order(
    table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """``turns (conv_id, place, role, text)``, places from 0, and ``convs (conv_id, n_turns)``.

    Turns are put in order over all conversations at once, so one of any length is spread.
    """
    need_columns(table, conv, turn, role, text)
    rows = table.select(
        named(conv).cast("long").alias("conv_id"),
        named(turn).isNotNull().alias("_numbered"),
        F.coalesce(named(turn).cast("long"), F.lit(0)).alias("_turn"),
        F.coalesce(named(role), F.lit("")).alias("role"),
        F.coalesce(named(text), F.lit("")).alias("text"),
    ).where("conv_id IS NOT NULL")
    numbered = row_order(rows, ["conv_id", "_numbered", "_turn", "role", "text"]).numbered("_at")
    convs = materialize(
        numbered.groupBy("conv_id").agg(F.min("_at").alias("_first"), F.count("*").alias("n_turns")),
        "conversations",
    )
    turns = numbered.join(convs, "conv_id").select(
        "conv_id", (F.col("_at") - F.col("_first")).alias("place"), "role", "text"
    )
    return turns, convs.select("conv_id", "n_turns")


def share_openings(
    turns: DataFrame, convs: DataFrame, base: Column, shared: Column, most: int
) -> tuple[DataFrame, DataFrame]:
    """Each conversation begins with the first ``shared`` turns of the conversation ``base``, instead of its own.

    ``base`` and ``shared`` are expressions on ``conv_id``; no conversation shares more than ``most`` turns.
    Returns ``turns (conv_id, depth, role, text)``, depths from 1, and ``convs (conv_id, length)``.
    """
    asked = convs.select("conv_id", "n_turns", base.alias("base"), shared.cast("long").alias("asked"))
    there = convs.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("_there"))
    rebuilt = asked.join(there, "base", "left").withColumn(
        "taken", F.least("asked", F.coalesce("_there", F.lit(0)))
    )
    rebuilt = materialize(rebuilt.select(
        "conv_id", "base", "asked", "taken",
        (F.col("taken") + F.greatest(F.col("n_turns") - F.col("asked"), F.lit(0))).alias("length"),
    ), "rebuilt")
    own = turns.join(rebuilt, "conv_id").where("place >= asked").select(
        "conv_id", (F.col("taken") + F.col("place") - F.col("asked") + 1).alias("depth"), "role", "text"
    )
    heads = turns.where(F.col("place") < most).withColumnRenamed("conv_id", "base")
    opened = heads.join(rebuilt, "base").where("place < asked").select(
        "conv_id", (F.col("place") + 1).alias("depth"), "role", "text"
    )
    return own.unionByName(opened), rebuilt.select("conv_id", "length")


def _node_key(depth: Column, one: Column, two: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws("|", *(c.cast("string") for c in (depth, one, two)))))


def _zero() -> Column:
    return F.lit(0).cast("decimal(38,0)")


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, key, parent, words``: the node that each turn leads to, and the words of its text."""
    digest = F.sha2(F.concat(
        F.concat_ws(":", F.col("depth").cast("string"), F.length("role").cast("string"), "role"), "text"
    ), 256)

    def part(start: int) -> Column:
        return F.conv(F.substring("_digest", start, 15), 16, 10).cast("decimal(38,0)")

    hashed = turns.select(
        "conv_id", "depth", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        digest.alias("_digest"),
    ).select("conv_id", "depth", "words", part(1).alias("_g"), part(16).alias("_h")).withColumn(
        "_chunk", F.floor((F.col("depth") - 1) / CHUNK)
    )
    hashed = materialize(hashed, "turn-hashes")
    along = Window.partitionBy("conv_id", "_chunk").orderBy("depth").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    before = Window.partitionBy("conv_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = hashed.groupBy("conv_id", "_chunk").agg(F.sum("_g").alias("_g"), F.sum("_h").alias("_h"))
    earlier = materialize(
        chunks.select(
            "conv_id", "_chunk", F.sum("_g").over(before).cast("decimal(38,0)").alias("_g0"),
            F.sum("_h").over(before).cast("decimal(38,0)").alias("_h0"),
        ).where("_chunk > 0"),
        "chunks",
    )
    sums = hashed.withColumns({
        "_one": F.sum("_g").over(along).cast("decimal(38,0)"),
        "_two": F.sum("_h").over(along).cast("decimal(38,0)"),
    }).join(earlier, ["conv_id", "_chunk"], "left")
    one = (F.col("_one") + F.coalesce("_g0", _zero())).cast("decimal(38,0)")
    two = (F.col("_two") + F.coalesce("_h0", _zero())).cast("decimal(38,0)")
    return sums.select(
        "conv_id", "depth", _node_key(F.col("depth"), one, two).alias("key"),
        _node_key(
            F.col("depth") - 1, (one - F.col("_g")).cast("decimal(38,0)"), (two - F.col("_h")).cast("decimal(38,0)")
        ).alias("parent"),
        "words",
    )


class SpillingQueue:
    """A priority queue that holds a set number of entries; more are kept as sorted runs in scratch files.

    The files have no name and end with the task, like those of Spark's own sorts.
    """

    def __init__(self, held: int):
        self.held, self.heap, self.runs = held, [], []

    def push(self, entry: tuple) -> None:
        heapq.heappush(self.heap, entry)
        if len(self.heap) > self.held:
            file = tempfile.TemporaryFile()
            for one in sorted(self.heap):
                pickle.dump(one, file)
            file.seek(0)
            self.heap = []
            self._next(file)

    def _next(self, file) -> None:
        try:
            heapq.heappush(self.runs, (pickle.load(file), id(file), file))
        except EOFError:
            file.close()

    def pop_while(self, due) -> Iterator[tuple]:
        """Take out the least entry for as long as it is due."""
        while True:
            if self.runs and (not self.heap or self.runs[0][0] <= self.heap[0]):
                if not due(self.runs[0][0]):
                    return
                entry, _, file = heapq.heappop(self.runs)
                self._next(file)
            elif self.heap and due(self.heap[0]):
                entry = heapq.heappop(self.heap)
            else:
                return
            yield entry


_TOTALS = {
    "key": pa.binary(), "parent": pa.binary(), "top": pa.bool_(), "n_children": pa.int64(),
    "n_leaves": pa.int64(), "saved_tokens": pa.int64(),
}


def _pass_totals(held: int):
    """Nodes of whole subtrees, deepest first, to their totals."""
    build = arrow_batches(_TOTALS)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = SpillingQueue(held)
        for batch in batches:
            out = []
            for depth, key, parent, top, children, leaves, saved in rows_of(
                [batch], "depth", "key", "parent", "top", "n_children", "n_leaves", "saved_tokens"
            ):
                here = (-depth, key)
                for _, _, of_leaves, of_saved in waiting.pop_while(lambda entry: entry[:2] <= here):
                    children, leaves, saved = children + 1, leaves + of_leaves, saved + of_saved
                leaves = leaves if children else 1
                out.append((key, parent, top, children, leaves, saved))
                if not top:
                    waiting.push((1 - depth, parent, leaves, saved))
            if out:
                yield build(*zip(*out))

    return forward


def _levels(nodes: DataFrame, most: int) -> DataFrame:
    """Add ``level``: 1 for nodes with up to `MEMBERS` members, 2 for up to its square, and so on; the root is last."""
    level, limit, last = F.lit(1), MEMBERS, 2
    while limit < most:
        level = F.when(F.col("n_convs") > limit, last).otherwise(level)
        limit, last = limit * MEMBERS, last + 1
    return nodes.withColumn("level", F.when(F.col("depth") == 0, last).otherwise(level))


def subtree_totals(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """``key, n_children, n_leaves, saved_tokens`` of ``nodes (…, level)``, level by level.

    ``rows (conv_id, depth, key)`` leads from a node's least member to the root of the node's shard.
    """
    last = nodes.agg(F.max("level")).first()[0]
    # Levels above the first are few rows: each of their nodes has more than MEMBERS members.
    high = materialize(nodes.where("level > 1 AND depth > 0").select("key", "level"), "high")
    passed = rows.join(high, "key").groupBy("conv_id").agg(*(
        F.max(F.when(F.col("level") > level, F.col("depth"))).alias(f"_after_{level}")
        for level in range(1, last)
    ))
    passed = materialize(passed, "passed")
    done, messages = [], None
    for level in range(1, last + 1):
        here = nodes.where(F.col("level") == level)
        if level == last:
            here = here.withColumn("shard", F.col("key"))
        else:
            roots = rows.join(passed, "conv_id", "left").where(
                F.col("depth") == F.coalesce(f"_after_{level}", F.lit(0)) + 1
            ).select("conv_id", F.col("key").alias("shard"))
            here = here.join(roots, "conv_id")
        own = (F.col("n_convs") - 1) * F.col("words")
        if messages is None:
            here = here.withColumns({"n_children": F.lit(0), "n_leaves": F.lit(0), "saved_tokens": own})
        else:
            here = here.join(messages, "key", "left").withColumns({
                "n_children": F.coalesce("_children", F.lit(0)),
                "n_leaves": F.coalesce("_leaves", F.lit(0)),
                "saved_tokens": own + F.coalesce("_saved", F.lit(0)),
            })
        columns = ["depth", "key", "parent", "n_children", "n_leaves", "saved_tokens"]
        sorted_down = here.select("shard", *columns, (F.col("key") == F.col("shard")).alias("top")).select(
            "shard", "top", "depth", "key", "parent",
            *(F.col(name).cast("long").alias(name) for name in columns[3:]),
        ).repartition("shard").sortWithinPartitions(F.desc("depth"), "key")
        totals = materialize(sorted_down.drop("shard").mapInArrow(
            _pass_totals(HELD),
            "key binary, parent binary, top boolean, n_children long, n_leaves long, saved_tokens long",
        ), f"level-{level}")
        done.append(totals.select("key", "n_children", "n_leaves", "saved_tokens"))
        sent = totals.where("top AND parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(
            F.count("*").alias("_children"), F.sum("n_leaves").alias("_leaves"),
            F.sum("saved_tokens").alias("_saved"),
        )
        if messages is not None:  # to nodes of a level above this one
            sent = messages.join(nodes.where(F.col("level") > level).select("key"), "key", "left_semi").unionByName(
                sent
            ).groupBy("key").agg(*(F.sum(name).alias(name) for name in ("_children", "_leaves", "_saved")))
        messages = materialize(sent, "messages")
    out = done[0]
    for table in done[1:]:
        out = out.unionByName(table)
    return out


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one node as comma-joined texts of up to `STRUNG` ids."""
    build = arrow_batches({"key": pa.binary(), "first": pa.int64(), "ids": pa.string()})
    key, held = None, []
    for batch in batches:
        out = []
        for node, conv in rows_of([batch], "key", "conv_id"):
            if held and (node != key or len(held) == STRUNG):
                out.append((key, held[0], ",".join(map(str, held))))
                held = []
            key = node
            held.append(conv)
        if out:
            yield build(*zip(*out))
    if held:
        yield build([key], [held[0]], [",".join(map(str, held))])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in order to one digest per node; only the digest's state is held."""
    build = arrow_batches({"key": pa.binary(), "ends_sha256": pa.string()})
    key, state = None, None
    for batch in batches:
        out = []
        for node, ids in rows_of([batch], "key", "ids"):
            if node != key:
                if state is not None:
                    out.append((key, state.hexdigest()))
                key, state = node, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield build(*zip(*out))
    if state is not None:
        yield build([key], [state.hexdigest()])


def end_digests(ends: DataFrame) -> DataFrame:
    """``key, ends_sha256`` from ``ends (key, conv_id)``: ids ascending, joined by commas, hashed.

    Ids are strung together where range partitions put them, so the task that hashes a node reads long
    texts, one at a time, however many members end there.
    """
    strung = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(
        _strings, "key binary, first long, ids string"
    )
    return strung.repartition("key").sortWithinPartitions("key", "first").mapInArrow(
        _digests, "key binary, ends_sha256 string"
    )


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of ``turns (conv_id, depth, role, text)`` and ``convs (conv_id, length)``.

    ``conv_id`` is the least member, ``parent_conv_id`` that of the parent (null for the root); also
    ``depth``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.
    """
    rows = materialize(prefixes(turns), "prefixes")
    count, least = convs.agg(F.count("*"), F.min("conv_id")).first()
    nothing = hashlib.sha256(b"").hexdigest()
    root_key = _node_key(F.lit(0), _zero(), _zero())
    root = convs.agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")
    ).where("n_convs > 0").select(
        root_key.alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"),
        "conv_id", "n_convs", F.lit(0).cast("long").alias("words"),
    )
    nodes = rows.groupBy("key").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"), F.first("words").alias("words"),
    ).unionByName(root)
    nodes = materialize(_levels(nodes, count), "nodes")
    ends = rows.join(convs, "conv_id").where("depth = length").select("key", "conv_id").unionByName(
        convs.where("length = 0").select(root_key.alias("key"), "conv_id")
    )
    digests = end_digests(ends)
    totals = subtree_totals(nodes, rows.select("conv_id", "depth", "key")) if count else nodes.select(
        "key", *(F.lit(0).cast("long").alias(name) for name in ("n_children", "n_leaves", "saved_tokens"))
    )
    parents = nodes.where("depth > 0").select(
        F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")
    )
    # The root may have any number of children: they need no join to find it.
    below_root = nodes.where("depth <= 1").withColumn(
        "parent_conv_id", F.when(F.col("depth") == 1, F.lit(least)).cast("long")
    )
    placed = below_root.unionByName(nodes.where("depth > 1").join(parents, "parent"))
    return placed.join(totals, "key").join(digests, "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
