"""MinHash near-duplicates with sequential Bayesian verification."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import (
    arrow_batches, connected_components, id_and_text, in_blocks, mix, partitions, shingle_hashes,
    whole_groups, word_hashes,
)
from pairloom.storage import materialize

#: Two sets of similarity 0.8 agree on all rows of some band but for 1 in 1,000,000.
BANDS, ROWS = 60, 7
#: Hashes of the signature that candidates are compared on, 16 bits each, and of a batch of them. The
#: whole signature goes on with the bands' hashes.
SIGNATURE, BATCH = 128, 32
WHOLE = 544
#: Chance that a pair at the threshold is pruned before its sets are compared.
MISS = 1e-6
#: Rows of a bucket that are compared in one task, beyond which blocks of it are compared two by two;
#: members of one verification group.
BUCKET, GROUP = 4096, 256
#: Pairs whose signatures are compared at a time.
PAIRS = 20_000
#: Shingles of the sets of one side that a task holds when it confirms a bucket's candidates, one set more at most.
HELD = 2_000_000

_ROUND = 128  # shingles hashed at a time, so that they stay in the processor's cache


def _draw(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    values = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) + np.uint64(seed << 32))
    values = (values >> np.uint64(32)).astype(np.uint32)
    return values[:count] | np.uint32(1), values[count:]


def min_hashes(shingles: np.ndarray, multiply: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the shingles."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(multiply), 0xFFFFFFFF, np.uint32)
    room = np.empty((min(_ROUND, len(short)), len(multiply)), np.uint32)
    for start in range(0, len(short), _ROUND):
        part = short[start : start + _ROUND, None]
        values = room[: len(part)]
        np.multiply(part, multiply, out=values)
        np.add(values, add, out=values)
        np.minimum(least, values.min(axis=0), out=least)
    return least


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted hashes of the distinct word runs of a text, A-Z lower-cased."""
    return np.unique(shingle_hashes(word_hashes(text.encode().lower().split()), size))


def _signatures(docs: DataFrame, shingle_words: int) -> DataFrame:
    """``key, n, digest, bands, signature, whole`` of each document; null bands for an empty set."""
    multiply, add = _draw(BANDS * ROWS + SIGNATURE, 1)
    build = arrow_batches({
        "key": pa.int64(), "n": pa.int64(), "digest": pa.binary(),
        "bands": pa.list_(pa.int64()), "signature": pa.binary(), "whole": pa.binary(),
    })
    numbers = np.arange(BANDS, dtype=np.uint64)

    def sign(batches):
        for batch in batches:
            rows = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                shingles = shingle_set(text, shingle_words)
                if not len(shingles):
                    rows.append((key, 0, b"", None, b"", b""))
                    continue
                least = min_hashes(shingles, multiply, add)
                grid = least[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
                band = mix(numbers)
                for k in range(ROWS):
                    band = mix(band ^ grid[:, k])
                signature = (least & np.uint32(0xFFFF)).astype("<u2").tobytes()
                cut = 2 * BANDS * ROWS
                rows.append((
                    key, len(shingles), xxhash.xxh3_128_digest(shingles.tobytes()),
                    band.view(np.int64).tolist(), signature[cut:], (signature[cut:] + signature)[: 2 * WHOLE],
                ))
            yield build(*(list(zip(*rows)) or [[]] * 6))

    return docs.mapInArrow(
        sign, "key long, n long, digest binary, bands array<long>, signature binary, whole binary"
    )


def _tail(agree: int, compared: int, threshold: float) -> float:
    """P(similarity >= threshold | agreements), under an even prior: a beta distribution's tail.

    For whole numbers it equals a binomial sum: P(X <= agree) with X ~ Binomial(compared + 1, threshold).
    """
    return math.fsum(
        math.comb(compared + 1, i) * threshold**i * (1 - threshold) ** (compared + 1 - i)
        for i in range(agree + 1)
    )


@lru_cache
def least_agreements(hashes: int, threshold: float, miss: float) -> tuple[int, ...]:
    """After each batch, the fewest agreements at which a pair may still reach the threshold."""
    return tuple(
        next(m for m in range(n + 1) if _tail(m, n, threshold) >= miss)
        for n in range(BATCH, hashes + 1, BATCH)
    )


def survives(left: np.ndarray, right: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Which rows of two signature matrices are not pruned, batch after batch of hashes."""
    alive, agree = np.arange(len(left)), np.zeros(len(left), np.int64)
    for k, least in enumerate(least_agreements(left.shape[1], threshold, miss)):
        part = slice(k * BATCH, (k + 1) * BATCH)
        agree[alive] += (left[alive, part] == right[alive, part]).sum(axis=1)
        alive = alive[agree[alive] >= least]
    kept = np.zeros(len(left), bool)
    kept[alive] = True
    return kept


def _matrix(column: pa.Array, hashes: int = SIGNATURE) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, hashes)


def prune(pairs: DataFrame, signed: DataFrame, threshold: float, miss: float) -> DataFrame:
    """The ``pairs (a, b)`` whose signatures leave the threshold possible."""
    left = signed.select(F.col("key").alias("a"), F.col("signature").alias("left"))
    right = signed.select(F.col("key").alias("b"), F.col("signature").alias("right"))

    def keep(batches):
        for batch in batches:
            if batch.num_rows:
                mask = survives(
                    _matrix(batch.column("left")), _matrix(batch.column("right")), threshold, miss
                )
                yield batch.select(["a", "b"]).filter(pa.array(mask))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(
        keep, "a long, b long"
    )


def similar(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets overlap by ``percent`` percent of their union."""
    small, large = sorted((one, other), key=len)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(small) + len(large) - common)


def verify(pairs: DataFrame, docs: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """The ``pairs (a, b)`` whose full sets have ``100 * intersection >= percent * union``.

    The members ``b`` of each ``a`` are compared in groups of bounded size, which each get the text of
    ``a`` once, ahead of the members.
    """
    sized = pairs.groupBy("a").agg(F.count("*").alias("size"))
    grouped = pairs.join(sized, "a").select(
        "a", "b",
        F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / GROUP).cast("long")).alias("part"),
    )
    members = grouped.join(docs.withColumnRenamed("key", "b"), "b").select("a", "part", "b", "text")
    heads = grouped.select("a", "part").distinct().join(docs.withColumnRenamed("key", "a"), "a").select(
        "a", "part", F.lit(None).cast("long").alias("b"), "text"
    )
    rows = heads.unionByName(members).repartition(partitions(docs.sparkSession), "a", "part")
    rows = rows.sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    build = arrow_batches({"a": pa.int64(), "b": pa.int64()})

    def compare(batches):
        head, heads = None, []
        for batch in batches:
            found = []
            for a, part, b, text in zip(*(batch.column(n).to_pylist() for n in ("a", "part", "b", "text"))):
                if head != (a, part):
                    head, heads = (a, part), []
                shingles = shingle_set(text, shingle_words)
                if b is None:
                    heads.append(shingles)  # more than one only for a repeated id
                elif any(similar(other, shingles, percent) for other in heads):
                    found.append((a, b))
            yield build(*(list(zip(*found)) or [[]] * 2))

    return rows.mapInArrow(compare, "a long, b long")


def _unlike(rows: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int, miss: float) -> np.ndarray:
    """Which of the pairs of rows are left after batch upon batch of hashes."""
    alive, agree = np.arange(len(i)), np.zeros(len(i), np.int64)
    for k, least in enumerate(least_agreements(rows.shape[1], percent / 100, miss)):
        part = rows[:, k * BATCH : (k + 1) * BATCH]
        agree[alive] += (part[i[alive]] == part[j[alive]]).sum(axis=1)
        alive = alive[agree[alive] >= least]
        if not len(alive):
            break
    return alive


def _parts(group: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The part of its group that each row is in: rows in order, cut where ``sizes`` add up to ``HELD``."""
    total = np.cumsum(sizes) - sizes
    first = np.searchsorted(group, group)
    return (total - total[first]) // HELD


def _candidates(table: pa.Table, percent: int, miss: float) -> pa.RecordBatch:
    """Candidates within the groups ``band, x, y`` of a table that is sorted by them, of all groups at once.

    A row is a key in a group ``band, x, y, u, v`` with those of its ``partners`` there that are larger; a key
    that is only a partner has none. ``u`` and ``v`` are parts of the group: see ``_parts``.
    """
    place = [table.column(name).to_numpy() for name in ("band", "x", "y")]
    change = np.logical_or.reduce([values[1:] != values[:-1] for values in place])
    group = np.concatenate([[0], change.cumsum()])
    keys, components, sizes, own, number = (
        table.column(name).to_numpy() for name in ("key", "component", "n", "block", "number")
    )
    across = place[1] != place[2]
    rows = np.frombuffer(b"".join(table.column("whole").to_pylist()), "<u2").reshape(len(keys), -1)
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(keys), -1)
    found, waiting, count = [], [], 0

    def flush() -> None:
        i, j = (np.concatenate(side) for side in zip(*waiting))
        alive = _unlike(rows, i, j, percent, miss)
        i, j = i[alive], j[alive]
        # a pair leaves from the first of the buckets that both members are in
        first = (bands[i] == bands[j]).argmax(axis=1) == number[i]
        found.append((i[first], j[first]))

    for apart in range(1, len(keys)):
        i = np.flatnonzero(group[apart:] == group[:-apart])
        if not len(i):
            break
        j = i + apart
        # sets of too different sizes cannot overlap enough
        low, high = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
        fit = (components[i] != components[j]) & (100 * low >= percent * high)
        fit &= ~across[i] | (own[i] != own[j])
        if fit.any():
            waiting.append((i[fit], j[fit]))
            count += int(fit.sum())
        if count >= PAIRS:
            flush()
            waiting, count = [], 0
    if waiting:
        flush()
    i, j = (np.concatenate(side) for side in zip(*found)) if found else np.zeros((2, 0), np.int64)
    part = _parts(group, sizes)
    u, v = np.minimum(part[i], part[j]), np.maximum(part[i], part[j])
    a, b = np.minimum(keys[i], keys[j]), np.maximum(keys[i], keys[j])
    columns = _distinct(group[i], u, v, a, b)
    head = _changes(*columns[:4])
    starts = np.flatnonzero(head)
    alone = _missing(tuple(column[starts] for column in columns[:4]), (*columns[:3], columns[4]))
    partners = pa.ListArray.from_arrays(
        pa.array(np.concatenate([starts, np.full(len(alone[0]) + 1, len(head))]), pa.int32()),
        pa.array(columns[4], pa.int64()),
    )
    of, u, v, key = (np.concatenate([one[starts], two]) for one, two in zip(columns[:4], alone))
    first = np.searchsorted(group, of)
    return pa.RecordBatch.from_arrays(
        [pa.array(values[first]) for values in place] + [
            pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(key, pa.int64()), partners,
        ], names=["band", "x", "y", "u", "v", "key", "partners"],
    )


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Which rows of sorted columns differ from the row before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([values[1:] != values[:-1] for values in columns])
    return out


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct rows, sorted."""
    order = np.lexsort(columns[::-1])
    columns = tuple(values[order] for values in columns)
    new = _changes(*columns)
    return tuple(values[new] for values in columns)


def _missing(there: tuple[np.ndarray, ...], wanted: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The distinct rows of ``wanted`` that are not in ``there``."""
    both = [np.concatenate(side) for side in zip(there, wanted)]
    late = np.repeat([0, 1], [len(there[0]), len(wanted[0])])
    *columns, late = _distinct(*both, late)
    chosen = _changes(*columns) & (late == 1)
    return tuple(values[chosen] for values in columns)


def _across(blocks: DataFrame, percent: int, miss: float) -> DataFrame:
    """``band, x, y, u, v, key, partners`` of what is not pruned of the pairs of different components in each
    bucket (``band, key, n, component, whole, bands``); see ``_candidates``.

    Two blocks ``x, y`` of a bucket are compared inside one task, a block with itself where they are the
    same; many small groups are compared together. Only survivors leave a task, one row for each member
    of a group and not for each pair.
    """
    def compare(batches):
        for table in whole_groups(batches, ("band", "x", "y"), BUCKET):
            yield _candidates(table, percent, miss)

    place = ["band", "x", "y"]
    return blocks.select(
        *place, "number", "key", "component", "block", "n", "whole", "bands"
    ).repartition(*place).sortWithinPartitions(*place).mapInArrow(
        compare, "band long, x int, y int, u long, v long, key long, partners array<long>"
    )


def _confirm(candidates: DataFrame, docs: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """``a, b``: links of the candidates (see ``_candidates``) whose full sets overlap enough.

    A group's sets are made once, in one task. A pair that links of its group have joined already is
    not compared, so that links are fewer than members.
    """
    place = ["band", "x", "y", "u", "v"]
    rows = candidates.join(docs, "key").select(*place, "key", "partners", "text").repartition(
        partitions(docs.sparkSession), *place
    ).sortWithinPartitions(*place)
    build = arrow_batches({"a": pa.int64(), "b": pa.int64()})

    def links(sets: dict, partners: dict) -> list:
        parent, found = {key: key for key in sets}, []

        def root(key):
            while parent[key] != key:
                parent[key] = key = parent[parent[key]]
            return key

        for a, others in partners.items():
            for b in others:
                one, two = root(a), root(b)
                # a repeated id has several sets
                if one != two and any(similar(left, right, percent) for left in sets[a] for right in sets[b]):
                    parent[max(one, two)] = min(one, two)
                    found.append((a, b))
        return found

    def compare(batches):
        group, sets, partners = None, {}, {}
        for batch in batches:
            found = []
            columns = (batch.column(name).to_pylist() for name in (*place, "key", "partners", "text"))
            for *at, key, others, text in zip(*columns):
                if at != group:
                    found += links(sets, partners)
                    group, sets, partners = at, {}, {}
                sets.setdefault(key, []).append(shingle_set(text, shingle_words))
                if others:
                    partners[key] = others
            yield build(*(list(zip(*found)) or [[]] * 2))
        yield build(*(list(zip(*links(sets, partners))) or [[]] * 2))

    return rows.mapInArrow(compare, "a long, b long")


def _in_blocks(buckets: DataFrame) -> DataFrame:
    return in_blocks(buckets, BUCKET)


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = 5,
    percent: int = 80, miss: float = MISS,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, n_rows``: which documents are linked, directly or not.

    Two documents are linked when the sets of their distinct word runs overlap by ``percent`` percent of
    the union; links are confirmed on the full sets. Equal sets are one class, compared once. Candidates
    share a band of MinHash values. First each bucket's members are compared with its hub, the one that meets
    most others in all its buckets; that joins groups of copies by a number of pairs that grows with the
    group, not its square. Then what is still in different components within a bucket is compared, all of it,
    a large bucket in blocks. Sets whose sizes differ by more than the threshold allows are no candidates. A
    candidate's signatures are compared batch after batch; it is dropped once the posterior chance of
    reaching the threshold is below ``miss``.

    Text without a word (null, empty) has an empty set and no links. Repeated ids are one document, linked
    by any of its texts, with the largest of their sets' sizes; documents with a null id are one row, not
    linked, without component and not kept. An empty table gives no rows.
    """
    source = id_and_text(docs, key, text)
    threshold = percent / 100
    signed = materialize(_signatures(source, shingle_words), "signatures")
    # One class per set: the least id stands for all.
    classes = materialize(
        signed.where("n > 0 AND key IS NOT NULL").select("key", "digest").join(
            signed.where("n > 0 AND key IS NOT NULL").groupBy("digest").agg(F.min("key").alias("least")),
            "digest",
        ).select("key", "least").distinct(),
        "classes",
    )
    # a repeated id may have several sets; all of them speak for it
    leaders = signed.where("n > 0").join(
        classes.where("key = least").select("key").distinct(), "key", "left_semi"
    )
    banded = leaders.select("key", "n", F.posexplode("bands").alias("number", "band"))
    shared = materialize(
        banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "buckets"
    )
    buckets = materialize(banded.join(shared, "band"), "banded")
    met = buckets.groupBy("key").agg(F.sum("size").alias("met"))
    hubs = buckets.join(met, "key").groupBy("band").agg(
        F.max(F.struct("met", (-F.col("key")).alias("minus"), "n")).alias("hub")
    ).select("band", (-F.col("hub.minus")).alias("hub"), F.col("hub.n").alias("hub_n"))
    texts = materialize(source.join(buckets.select("key").distinct(), "key", "left_semi"), "texts")

    first = materialize(
        buckets.join(hubs, "band").where("hub <> key").where(
            100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
        ).select(
            F.least("hub", "key").alias("a"), F.greatest("hub", "key").alias("b")
        ).distinct(),
        "pairs",
    )
    links = materialize(
        verify(prune(first, leaders, threshold, miss), texts, shingle_words, percent), "links"
    )
    joined = materialize(connected_components(links), "components")

    named = buckets.join(joined.withColumnRenamed("node", "key"), "key", "left").select(
        "band", "number", "key", F.coalesce("component", "key").alias("component")
    )
    mixed = named.groupBy("band", "component").agg(F.count("*").alias("rows")).groupBy("band").agg(
        F.sum("rows").alias("size"), F.max(F.struct(F.col("rows").alias("most"), "component")).alias("top"),
        F.count("*").alias("components"),
    ).where("components > 1").select("band", "size", "top.most", F.col("top.component").alias("major"))
    # of a repeated id's sets, those that are in the bucket
    blocks = _in_blocks(named.join(mixed, "band")).join(
        leaders.select("key", "n", "whole", "bands"), "key"
    ).where(F.col("bands")[F.col("number")] == F.col("band"))
    more = _confirm(
        materialize(_across(blocks, percent, miss), "candidates"), texts, shingle_words, percent
    )
    links = links.unionByName(more).unionByName(
        classes.where("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b"))
    )
    components = connected_components(materialize(links, "links"))
    sizes = signed.groupBy(F.col("key").alias("doc_id")).agg(
        F.max("n").alias("n_shingles"), F.count("*").alias("n_rows")
    )
    return sizes.join(components.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(False)).alias("kept"),
        "n_rows",
    )
