"""Passages that repeat across documents: MinHash banding of paragraphs, verified and clustered."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from pairloom.checks import named
from pairloom.llm.common import (
    arrow_batches, connected_components, id_and_text, in_blocks, mix, shingle_hashes, whole_groups,
)
from pairloom.storage import materialize

#: A paragraph begins at a word whose hash is least among so many words to either side.
REACH = 6
#: Words after which a paragraph without such a place is cut.
LONGEST = 64
SHINGLE = 5
#: Rows of a band that are compared in one task, beyond which blocks of it are compared two by two.
BAND = 4096
#: Words that are cut into paragraphs at a time, beyond which a text is the last one.
WORDS = 50_000
#: Pairs of paragraphs whose sets are compared at a time.
PAIRS = 20_000
#: Words beyond a matched paragraph that are compared with those beyond its first occurrence.
CONTEXT = 64
#: Words in a row that may differ there, and the equal ones that must follow for each: a similarity of 0.8.
EDITS, AFTER = 3, 4
#: A passage's least length.
PASSAGE_WORDS = 32

_FAR = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def paragraph_starts(hashes: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
    """Where paragraphs begin: places that the words around them alone decide, so that a passage is cut
    alike in every document, whatever stands before it.

    ``hashes`` may be those of several texts, one after the other, which end at ``ends``.
    """
    ends = np.array([len(hashes)]) if ends is None else np.asarray(ends)
    counts = np.diff(ends, prepend=0)
    ends, counts = ends[counts > 0], counts[counts > 0]
    if not len(ends):
        return np.zeros(0, np.int64)
    first = np.zeros(len(hashes), bool)
    first[ends - counts] = True
    # texts stand apart, so that no word is compared with one of another text
    at = np.arange(len(hashes)) + REACH * first.cumsum()
    pair = np.full(len(hashes), _FAR)
    pair[:-1] = mix(hashes[:-1] ^ mix(hashes[1:] + _ODD))
    pair[ends - 1] = _FAR
    padded = np.full(len(hashes) + REACH * (len(ends) + 1), _FAR)
    padded[at] = pair
    windows = padded[: len(padded) - REACH + 1].copy()
    for k in range(1, REACH):
        np.minimum(windows, padded[k : k + len(windows)], out=windows)
    least = (pair < windows[at - REACH]) & (pair <= windows[at + 1])
    edges = np.flatnonzero(first | least & np.repeat(counts > REACH, counts))
    pieces = -(-np.diff(edges, append=len(hashes)) // LONGEST)
    piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.repeat(edges, pieces) + piece * LONGEST


def least_values(shingles: np.ndarray, starts: np.ndarray, counts: np.ndarray, percent: int):
    """``values, of``: the least MinHash values of each range of ``counts`` shingles from ``starts`` on, rising.

    Of n distinct values, as many as it takes that two sets which overlap by ``percent`` percent of their
    union always have one in common: their least common value is preceded by what the other set lacks, which
    is at most a ``100 - percent`` percent share of n. All of them where ``percent`` is 0.
    """
    values, of = [shingles[:0]], [np.zeros(0, np.int64)]
    for count in np.unique(counts):
        ranges = np.flatnonzero(counts == count)
        rows = np.sort(shingles[starts[ranges, None] + np.arange(count)], axis=1)
        new = np.ones(rows.shape, bool)
        new[:, 1:] = rows[:, 1:] != rows[:, :-1]
        sizes = new.sum(axis=1)
        taken = new & (new.cumsum(axis=1) <= (sizes - (percent * sizes + 99) // 100 + 1)[:, None])
        values.append(rows[taken])
        of.append(np.repeat(ranges, taken.sum(axis=1)))
    values, of = np.concatenate(values), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return values[order], of[order]


def _contents(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of the words of each paragraph; paragraphs follow one another without a gap."""
    within = np.arange(len(hashes)) - np.repeat(starts, sizes)
    placed = mix(hashes + (within.astype(np.uint64) + np.uint64(1)) * _ODD)
    return mix(np.add.reduceat(placed, starts))


def paragraphs(hashes: np.ndarray, percent: int, ends: np.ndarray | None = None):
    """``starts, sizes, contents`` of the paragraphs with at least ``SHINGLE`` words; ``bands, of``: their
    MinHash values, and the paragraph that each is of. ``hashes`` may be those of several texts, which end at
    ``ends``."""
    starts = paragraph_starts(hashes, ends)
    sizes = np.diff(starts, append=len(hashes))
    contents = _contents(hashes, starts, sizes)
    kept = sizes >= SHINGLE
    starts, sizes, contents = starts[kept], sizes[kept], contents[kept]
    bands, of = least_values(shingle_hashes(hashes, SHINGLE), starts, sizes - SHINGLE + 1, percent)
    return starts, sizes, contents, bands, of


def _hashed(words: list[bytes]) -> np.ndarray:
    """``word_hashes`` without its cache: looking up words of a wide vocabulary takes longer than hashing them."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _lists(values: np.ndarray, of: np.ndarray, count: int) -> pa.Array:
    """``count`` lists of the values, of which ``of`` tells the list."""
    offsets = np.concatenate([[0], np.bincount(of, minlength=count).cumsum()]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _cut(source: DataFrame, percent: int) -> DataFrame:
    """``doc_id, start, size, content`` of paragraphs, and the array ``bands`` of their bands."""
    build = arrow_batches({
        "doc_id": pa.int64(), "start": pa.int32(), "size": pa.int32(), "content": pa.int64(),
        "bands": pa.list_(pa.int64()),
    })

    def rows(keys: list, counts: list, words: list) -> pa.RecordBatch:
        ends = np.cumsum(counts)
        starts, sizes, contents, bands, of = paragraphs(_hashed(words), percent, ends)
        text = np.searchsorted(ends, starts, side="right")
        return build(
            np.array(keys)[text], (starts - (ends - counts)[text]).astype(np.int32), sizes.astype(np.int32),
            contents.view(np.int64), _lists(bands, of, len(starts)),
        )

    def cut(batches):
        for batch in batches:
            keys, counts, words = [], [], []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for key, text in zip(batch.column("key").to_pylist(), texts):
                split = text.lower().split()
                if key is None or len(split) < SHINGLE:
                    continue
                keys.append(key)
                counts.append(len(split))
                words += split
                if len(words) >= WORDS:
                    yield rows(keys, counts, words)
                    keys, counts, words = [], [], []
            if words:
                yield rows(keys, counts, words)

    return source.mapInArrow(cut, "doc_id long, start int, size int, content long, bands array<long>")


def _sets(places: DataFrame, source: DataFrame) -> DataFrame:
    """``content, shingles`` of paragraphs at ``places (content, doc_id, start, size)``, one place for each."""
    spans = places.groupBy(F.col("doc_id").alias("key")).agg(
        F.collect_list(F.struct("content", "start", "size")).alias("spans")
    )
    build = arrow_batches({"content": pa.int64(), "shingles": pa.list_(pa.int64())})

    def rows(contents: list, sizes: list, words: list) -> pa.RecordBatch:
        contents, sizes, hashes = np.array(contents), np.array(sizes), _hashed(words)
        starts = np.cumsum(sizes) - sizes
        # of rows with one id only those that have these words there
        there = _contents(hashes, starts, sizes).view(np.int64) == contents
        starts, sizes, contents = starts[there], sizes[there], contents[there]
        values, of = least_values(shingle_hashes(hashes, SHINGLE), starts, sizes - SHINGLE + 1, 0)
        return build(contents, _lists(values, of, len(contents)))

    def shingle(batches):
        for batch in batches:
            contents, sizes, words = [], [], []
            spans = batch.column("spans")
            each = [spans.flatten().field(name).to_pylist() for name in ("content", "start", "size")]
            at = 0
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for text, count in zip(texts, spans.value_lengths().to_pylist()):
                split = text.lower().split()
                for content, start, size in zip(*(values[at : at + count] for values in each)):
                    if start + size <= len(split):
                        contents.append(content)
                        sizes.append(size)
                        words += split[start : start + size]
                at += count
                if len(words) >= WORDS:
                    yield rows(contents, sizes, words)
                    contents, sizes, words = [], [], []
            if words:
                yield rows(contents, sizes, words)

    return source.join(spans, "key").select("text", "spans").mapInArrow(
        shingle, "content long, shingles array<long>"
    ).dropDuplicates(["content"])


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs (a, b)`` of contents whose shingle sets overlap enough."""
    common = F.size(F.array_intersect("left", "right"))
    union = F.size("left") + F.size("right") - common
    return pairs.join(sets.select(F.col("content").alias("a"), F.col("shingles").alias("left")), "a").join(
        sets.select(F.col("content").alias("b"), F.col("shingles").alias("right")), "b"
    ).where(100 * common >= percent * union).select("a", "b")


def _common(values: np.ndarray, ends: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many values the sets ``i`` and ``j`` have in common, pair by pair; ``values`` are below 2**31."""
    starts = np.concatenate([[0], ends[:-1]])

    def listed(side: np.ndarray) -> np.ndarray:
        sizes = ends[side] - starts[side]
        pair = np.repeat(np.arange(len(side)), sizes)
        at = np.arange(len(pair)) + np.repeat(starts[side] - (np.cumsum(sizes) - sizes), sizes)
        return (pair << 31) + values[at]

    both = np.sort(np.concatenate([listed(i), listed(j)]))
    return np.bincount(both[1:][both[1:] == both[:-1]] >> 31, minlength=len(i))


def _joins(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of components to join: those of similar sets within the groups ``band, x, y`` of a table sorted by
    them. Components that are joined already are not compared, so that pairs are fewer than rows."""
    place = [table.column(name).to_numpy() for name in ("band", "x", "y")]
    change = np.logical_or.reduce([values[1:] != values[:-1] for values in place])
    group = np.concatenate([[0], change.cumsum()])
    names, part = np.unique(table.column("component").to_numpy(), return_inverse=True)
    own, across = table.column("block").to_numpy(), place[1] != place[2]
    sets = table.column("shingles").combine_chunks()
    sizes = sets.value_lengths().to_numpy().astype(np.int64)
    shingles = sets.flatten().to_numpy().view(np.uint64)
    ends = np.cumsum(sizes)
    # a bit that one set has and the other lacks stands for at least one shingle that the other lacks
    bits = np.bitwise_or.reduceat(np.uint64(1) << (shingles & np.uint64(63)), ends - sizes)
    values = np.unique(shingles, return_inverse=True)[1].astype(np.int64)
    parent, found = list(range(len(names))), []

    def root(at: int) -> int:
        while parent[at] != at:
            parent[at] = at = parent[parent[at]]
        return at

    def join(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        common = _common(values, ends, i, j)
        alike = 100 * common >= percent * (sizes[i] + sizes[j] - common)
        for one, two in set(zip(part[i[alike]].tolist(), part[j[alike]].tolist())):
            one, two = root(one), root(two)
            if one != two:
                parent[max(one, two)] = min(one, two)
                found.append((min(one, two), max(one, two)))
        return np.array([root(at) for at in range(len(names))])[part] if alike.any() else part

    waiting, count = [], 0
    for apart in range(1, len(own)):
        i = np.flatnonzero(group[apart:] == group[:-apart])
        if not len(i):
            break
        j = i + apart
        fit = (part[i] != part[j]) & (~across[i] | (own[i] != own[j]))
        i, j = i[fit], j[fit]
        most = np.minimum(
            sizes[i] - np.bitwise_count(bits[i] & ~bits[j]), sizes[j] - np.bitwise_count(bits[j] & ~bits[i])
        )
        fit = (100 + percent) * most >= percent * (sizes[i] + sizes[j])
        waiting.append((i[fit], j[fit]))
        count += int(fit.sum())
        if count >= PAIRS:
            part, waiting, count = join(*(np.concatenate(side) for side in zip(*waiting))), [], 0
    if count:
        join(*(np.concatenate(side) for side in zip(*waiting)))
    one, two = np.array(found, np.int64).reshape(-1, 2).T
    return names[one], names[two]


def _across(blocks: DataFrame, percent: int) -> DataFrame:
    """``a, b``: components to join, in each band (``band, x, y, block, component, shingles``).

    Two blocks ``x, y`` of a band are compared inside one task, a block with itself where they are the same;
    many small groups are compared together.
    """
    build = arrow_batches({"a": pa.int64(), "b": pa.int64()})

    def compare(batches):
        for table in whole_groups(batches, ("band", "x", "y"), BAND):
            yield build(*_joins(table, percent))

    place = ["band", "x", "y"]
    return blocks.select(*place, "block", "component", "shingles").repartition(
        *place
    ).sortWithinPartitions(*place).mapInArrow(compare, "a long, b long")


def linked_paragraphs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``node, component`` of the contents in ``members (band, a, content)``, ``a`` the band's least, that are
    linked: every two in a band whose ``sets (content, shingles)`` overlap enough, directly or not.

    All are compared with the band's least member first. What then is in different components of a band is
    compared with each other, a large band in blocks.
    """
    pairs = materialize(
        members.where("a <> content").select("a", F.col("content").alias("b")).distinct(), "pairs"
    )
    first = materialize(connected_components(materialize(_similar(pairs, sets, percent), "links")), "components")
    rest = members.where("a <> content").join(
        first.withColumnRenamed("node", "content"), "content", "left"
    ).select(
        "band", F.lit(0).alias("number"), F.col("content").alias("key"),
        F.coalesce("component", "content").alias("component"),
    )
    mixed = rest.groupBy("band", "component").agg(F.count("*").alias("rows")).groupBy("band").agg(
        F.sum("rows").alias("size"), F.max(F.struct(F.col("rows").alias("most"), "component")).alias("top"),
        F.count("*").alias("components"),
    ).where("components > 1").select("band", "size", "top.most", F.col("top.component").alias("major"))
    blocks = in_blocks(rest.join(materialize(mixed, "mixed"), "band"), BAND).join(
        sets.withColumnRenamed("content", "key"), "key"
    )
    joined = materialize(connected_components(_across(blocks, percent)), "components")
    known = first.withColumnRenamed("component", "part").join(
        joined.select(F.col("node").alias("part"), "component"), "part", "left"
    ).select("node", F.coalesce("component", "part").alias("component"))
    return known.unionByName(joined.join(first.select("node"), "node", "left_anti"))


def reach(mine: list, theirs: list) -> tuple[int, int]:
    """How far two sequences go on alike from their beginnings: the words of each that belong together.

    Up to ``EDITS`` words that were changed, added or left out are passed if ``AFTER`` equal ones follow
    for each; the last word is an equal one.
    """
    i = j = 0
    while i < len(mine) and j < len(theirs):
        if mine[i] == theirs[j]:
            i, j = i + 1, j + 1
            continue
        for a, b in _STEPS:
            n = AFTER * max(a, b)
            ahead = mine[i + a : i + a + n]
            if len(ahead) == n and ahead == theirs[j + b : j + b + n]:
                i, j = i + a + n, j + b + n
                break
        else:
            break
    return i, j


#: Words passed on either side, the fewest first.
_STEPS = sorted(
    ((a, b) for a in range(EDITS + 1) for b in range(EDITS + 1) if a or b), key=lambda s: (max(s), sum(s))
)
#: Words beyond the room that a passage has, which tell whether the last ones in it belong to it.
_BEYOND = (AFTER + 1) * EDITS


def _contexts(places: DataFrame, source: DataFrame) -> DataFrame:
    """``places (doc_id, start, end, left, right, ...)`` with the words ``before`` and ``after`` them."""
    rest = [c for c in places.columns if c != "doc_id"]
    listed = places.groupBy(F.col("doc_id").alias("key")).agg(F.collect_list(F.struct(*rest)).alias("places"))
    types = {f.name: f.dataType.simpleString() for f in places.schema.fields}

    def words(batches):
        for batch in batches:
            before, after, at = [], [], 0
            kept, spots = batch.column("places").value_lengths().to_numpy(), batch.column("places").flatten()
            each = [spots.field(name).to_pylist() for name in ("start", "end", "left", "right")]
            for text, count in zip(batch.column("text").cast(pa.binary()).to_pylist(), kept.tolist()):
                split = text.lower().split()
                for start, end, left, right in zip(*(values[at : at + count] for values in each)):
                    low = max(0, start - left - _BEYOND) if left else start
                    high = end + right + _BEYOND if right else end
                    before.append(b" ".join(split[low:start]).decode())
                    after.append(b" ".join(split[end:high]).decode())
                at += count
            doc_ids = np.repeat(np.arange(len(kept)), kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(doc_ids)), *spots.flatten(),
                 pa.array(before, pa.string()), pa.array(after, pa.string())],
                names=["doc_id", *rest, "before", "after"],
            )

    columns = ["doc_id", *rest]
    return source.join(listed, "key").select("key", "text", "places").mapInArrow(
        words, ", ".join(f"{c} {types[c]}" for c in columns) + ", before string, after string"
    )


def _extended(flagged: DataFrame, source: DataFrame) -> DataFrame:
    """``flagged`` places with the words around them that go on alike in another place.

    A removed place is compared with its component's first one, and that one with all of them. Words beyond
    ``room`` belong to the neighbours.
    """
    ends = flagged.where("removed AND (left > 0 OR right > 0)")
    heads = flagged.where("NOT removed").join(ends.select("component").distinct(), "component").select(
        "component", F.col("first_doc_id").alias("doc_id"), "start", "end",
        F.lit(CONTEXT).alias("left"), F.lit(CONTEXT).alias("right"), "removed", "first_doc_id",
    )
    around = materialize(_contexts(ends.select(*heads.columns).unionByName(heads), source), "contexts")
    first = around.where("NOT removed").groupBy("component").agg(
        F.min(F.struct("before", "after")).alias("head")
    ).select("component", F.col("head.before").alias("head_before"), F.col("head.after").alias("head_after"))
    build = arrow_batches({
        "component": pa.int64(), "doc_id": pa.int64(), "start": pa.int32(), "end": pa.int32(),
        "first_doc_id": pa.int64(), "head_left": pa.int32(), "head_right": pa.int32(),
    })
    names = ["component", "doc_id", "start", "end", "first_doc_id", "left", "right"]
    texts = ["before", "head_before", "after", "head_after"]

    def compare(batches):
        for batch in batches:
            rows = []
            columns = (batch.column(name).to_pylist() for name in names + texts)
            for component, doc_id, start, end, first_id, left, right, *around in zip(*columns):
                before, head_before, after, head_after = (part.split() for part in around)
                mine, head_left = reach(before[::-1], head_before[::-1])
                start -= min(mine, left)
                mine, head_right = reach(after, head_after)
                rows.append((
                    component, doc_id, start, end + min(mine, right), first_id, head_left, head_right,
                ))
            yield build(*(list(zip(*rows)) or [[]] * 7))

    wide = materialize(
        around.where("removed").join(first, "component").select(*names, *texts).mapInArrow(
            compare,
            "component long, doc_id long, start int, end int, first_doc_id long, head_left int, head_right int",
        ),
        "extended",
    )
    shared = wide.groupBy("component").agg(F.max("head_left").alias("l"), F.max("head_right").alias("r"))
    kept = flagged.where("NOT removed").join(shared, "component", "left").select(
        "doc_id", (F.col("start") - F.least("left", F.coalesce("l", F.lit(0)))).alias("start"),
        (F.col("end") + F.least("right", F.coalesce("r", F.lit(0)))).alias("end"),
        "component", "first_doc_id", "removed",
    )
    inner = flagged.where("removed AND left = 0 AND right = 0").select(*kept.columns)
    return kept.unionByName(inner).unionByName(
        wide.withColumn("removed", F.lit(True)).select(*kept.columns)
    )


def _occurrences(source: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, start, size, content`` of the paragraphs that are like another one, or might be, and
    ``node, component`` of the contents that are."""
    cut = materialize(_cut(source, percent), "paragraphs")
    placed = cut.select("doc_id", "start", "size", "content")
    banded = cut.select(F.explode("bands").alias("band"), "content")
    twice = placed.groupBy("content").agg(F.count("*").alias("n")).where("n > 1").select("content")
    shared = materialize(
        banded.groupBy("band").agg(F.min("content").alias("a"), F.max("content").alias("high")).where(
            "a <> high"
        ).select("band", "a"),
        "bands",
    )
    members = materialize(banded.join(shared, "band").distinct(), "members")
    compared = members.select("content").distinct()
    wanted = materialize(twice.unionByName(compared).distinct(), "contents")
    occurs = materialize(placed.join(wanted, "content").distinct(), "occurrences")
    places = occurs.join(compared, "content").groupBy("content").agg(
        F.min(F.struct("doc_id", "start", "size")).alias("p")
    ).select("content", "p.doc_id", "p.start", "p.size")
    sets = materialize(_sets(places, source), "sets")
    return occurs, linked_paragraphs(members, sets, percent)


def paragraph_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80
) -> DataFrame:
    """``node, component``: the contents of paragraphs that are linked to others, and the least one reached."""
    return _occurrences(id_and_text(docs, key, text), percent)[1]


def repeated_passages(
    docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80,
    passage_words: int = PASSAGE_WORDS,
) -> DataFrame:
    """``doc_id, passage, start_word, end_word, n_words, component_id, first_doc_id, removed``.

    Texts are cut into paragraphs of about 13 words at places that their words decide. Paragraphs with a
    MinHash value in common are compared by their sets of five-word runs; those that overlap by ``percent``
    percent of the union, and equal ones, are one component: all of them, since two such paragraphs always
    have a value in common (see ``least_values``). A component counts if it lies in
    several documents; its first paragraph, by document and place, stays, the others go. Up to ``CONTEXT``
    words to either side are compared, word by word, with those around the first paragraph, and belong to
    the passage as far as they go on alike (see ``reach``). What touches and shares this fate makes a
    passage; those with at least ``passage_words`` words are returned, with the least component and the
    earliest document among them. ``removed`` is false for the ones that stay. Words are counted from 0; A-Z
    equal a-z.

    Equal paragraphs are one node of the graph, however often they occur, and are counted per task before
    they are shuffled. Candidates of a band are compared with its least member, then with those of it that
    are still apart from them.

    Null and empty texts and null ids have no passages; documents without any give no row; rows that repeat a
    document are the same document, not a repetition; an empty table gives no rows.
    """
    source = id_and_text(docs, key, text)
    occurs, components = _occurrences(source, percent)
    clustered = materialize(
        occurs.join(components.withColumnRenamed("node", "content"), "content", "left").select(
            "doc_id", "start", "size", F.coalesce("component", "content").alias("component")
        ),
        "clustered",
    )
    classes = clustered.groupBy("component").agg(
        F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last")
    ).where("first_doc_id <> last").select("component", "first_doc_id")
    flagged = clustered.join(classes, "component")
    # the first place within the first document
    heads = flagged.where("doc_id = first_doc_id").groupBy("component").agg(F.min("start").alias("head"))
    flagged = flagged.join(heads, "component").withColumn(
        "removed", (F.col("doc_id") != F.col("first_doc_id")) | (F.col("start") != F.col("head"))
    )
    order = Window.partitionBy("doc_id").orderBy("start")
    stop = F.col("start") + F.col("size")
    flagged = materialize(flagged.select(
        "doc_id", "start", stop.alias("end"), "component", "first_doc_id", "removed",
        F.least(
            F.col("start") - F.coalesce(F.lag(stop).over(order), F.lit(0)), F.lit(CONTEXT)
        ).alias("left"),
        F.least(F.coalesce(F.lead("start").over(order) - stop, F.lit(CONTEXT)), F.lit(CONTEXT)).alias("right"),
    ), "flagged")
    order = Window.partitionBy("doc_id", "removed").orderBy("start", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    marked = _extended(flagged, source).withColumn(
        "new", F.when(F.col("start") <= F.max("end").over(before), 0).otherwise(1)
    )
    runs = marked.withColumn("passage", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    passages = runs.groupBy("doc_id", "passage", "removed").agg(
        F.min("start").cast("long").alias("start_word"), F.max("end").cast("long").alias("end_word"),
        F.min("component").alias("component_id"), F.min("first_doc_id").alias("first_doc_id"),
    ).withColumn("n_words", F.col("end_word") - F.col("start_word")).where(F.col("n_words") >= passage_words)
    return passages.select(
        "doc_id", "passage", "start_word", "end_word", "n_words", "component_id", "first_doc_id", "removed"
    )


def remove_passages(docs: DataFrame, passages: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the removed passages cut from their texts; texts left without a word go.

    All columns stay, in their order. A cut takes the white space after it along.
    """
    at = docs.columns.index(text)
    numbered = [f"column_{i}" for i in range(len(docs.columns))]  # names of any kind, and none taken twice
    spans = passages.where("removed").groupBy(F.col("doc_id").alias("span_key")).agg(
        F.collect_list(F.struct("start_word", "end_word")).alias("spans")
    )
    joined = docs.select(
        *(named(c).alias(n) for c, n in zip(docs.columns, numbered)), named(key).cast("long").alias("span_key")
    ).join(spans, "span_key", "left").select(*numbered, "spans")
    schema = StructType([StructField(n, f.dataType) for n, f in zip(numbered, docs.schema.fields)])

    def cut(batches):
        for batch in batches:
            texts, kept = [], []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column("spans").to_pylist()):
                if spans:
                    text = without_words(text, [(s["start_word"], s["end_word"]) for s in spans])
                texts.append(text)
                kept.append(not spans or bool(text.strip(" \t\n\x0b\x0c\r")))
            arrays = [
                pa.array(texts, batch.schema.field(i).type) if i == at else batch.column(i)
                for i in range(len(numbered))
            ]
            whole = pa.RecordBatch.from_arrays(arrays, names=numbered)
            yield whole.filter(pa.array(kept, pa.bool_()))

    return joined.mapInArrow(cut, schema).toDF(*docs.columns)


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without these ranges of words."""
    data = text.encode()
    starts = [m.start() for m in _WORD.finditer(data)] + [len(data)]
    parts, at = [], 0
    for start, end in sorted(spans):
        parts.append(data[at : starts[start]])
        at = max(at, starts[min(end, len(starts) - 1)])
    parts.append(data[at:])
    return b"".join(parts).decode()
