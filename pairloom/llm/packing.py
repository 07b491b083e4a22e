"""Packing of token sequences by minimum bin slack."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from pairloom.llm import bpe
from pairloom.llm.common import arrow_batches, id_and_text

#: Documents whose remainders are packed together; bounds a task's memory.
BLOCK_DOCS = 20_000

COLUMNS = {
    "doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(),
    "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(),
}
SCHEMA = ", ".join(f"{name} long" for name in COLUMNS)


def best_fill(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The multiset of lengths, at most ``counts`` of each, whose sum is closest to ``room`` from below.

    Subset sums are bits of one integer, one integer per length tried, longest first; the last one is
    walked back to find how many of each length were used. Trying ends once ``room`` itself is reached.
    """
    sums, mask, layers = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        layers.append((length, sums))
        fresh, copies = sums, min(counts[length], room // length)
        for _ in range(copies):
            fresh = (fresh << length) & mask
            if not fresh:
                break
            sums |= fresh
        if sums >> room & 1:
            break
    left, picked = sums.bit_length() - 1, []
    for length, without in reversed(layers):
        used = 0
        while not without >> left & 1:
            left -= length
            used += 1
        if used:
            picked.append((length, used))
    return picked


def pack_lengths(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces ``(item, start in the item, length)`` for items shorter than ``capacity``.

    Each window takes the longest piece left and the multiset of others that leaves least slack; a
    multiset is used as often as the counts allow. Slack that no multiset fills takes the head of the
    longest piece left, whose tail goes back among the pieces. So only the last window can be short;
    it is cut at powers of two, lengths that need no padding.
    """
    pool: dict[int, list[tuple[int, int]]] = {}
    for item, length in enumerate(lengths):
        pool.setdefault(length, []).append((item, 0))
    counts = Counter({length: len(items) for length, items in pool.items()})
    windows: list[list[tuple[int, int, int]]] = []

    def take(length: int) -> tuple[int, int, int]:
        counts[length] -= 1
        if not counts[length]:
            del counts[length]
        item, start = pool[length].pop()
        return item, start, length

    while counts:
        longest = max(counts)
        others = dict(counts)
        others[longest] -= 1
        others = {length: n for length, n in others.items() if n}
        picked = Counter(dict(best_fill(others, capacity - longest)))
        picked[longest] += 1
        slack = capacity - sum(length * n for length, n in picked.items())
        if slack:
            window = [take(length) for length, n in picked.items() for _ in range(n)]
            if counts:  # every piece left is longer than the slack
                item, start, length = take(max(counts))
                window.append((item, start, slack))
                pool.setdefault(length - slack, []).append((item, start + slack))
                counts[length - slack] += 1
            windows.append(window)
            continue
        for _ in range(min(counts[length] // n for length, n in picked.items())):
            windows.append([take(length) for length, n in picked.items() for _ in range(n)])
    if windows and sum(x[2] for x in windows[-1]) < capacity:
        windows[-1:] = _at_powers_of_two(windows[-1])
    return windows


def _at_powers_of_two(window: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    total, cut, pieces = sum(x[2] for x in window), [], list(reversed(window))
    for bit in range(total.bit_length() - 1, -1, -1):
        room, part = total & 1 << bit, []
        while room:
            item, start, length = pieces.pop()
            used = min(room, length)
            part.append((item, start, used))
            if used < length:
                pieces.append((item, start + used, length - used))
            room -= used
        if part:
            cut.append(part)
    return cut


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 1024,
    key: str = "doc_id", text: str = "text", block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """Cut each document's ids, ended by ``end_id``, into pieces and pack them into sequences.

    A document fills as many whole sequences as it can; the remainders of each ``block_docs`` documents
    of a task are packed by minimum bin slack over their length counts. One row per piece; a sequence is
    full or a power of two long, so nothing is padded. Sequence ids are unique, not gapless: they hold
    the partition's number and a running number. A task needs no other task's rows; one that is run
    again gives the same pieces.

    A null or empty text is the end id alone; a null id is kept; rows that repeat are packed each on its
    own; an empty table gives no rows; texts of any length are encoded whole.
    """
    build = arrow_batches(COLUMNS)

    def crc(ids: np.ndarray) -> int:
        return zlib.crc32(ids.astype("<u4").tobytes())

    def pack(batches):
        encoder = bpe.load(tokenizer)
        end = np.array([end_id], encoder.dtype)
        number = TaskContext.get().partitionId() << 40
        rests: list[tuple] = []

        def flush():
            nonlocal number
            rows = []
            for window in pack_lengths([len(rest[3]) for rest in rests], capacity):
                offset = 0
                for item, start, length in window:
                    doc, total, begin, ids = rests[item]
                    piece = ids[start : start + length]
                    rows.append((doc, begin + start, length, crc(piece), total, number, offset))
                    offset += length
                number += 1
            rests.clear()
            return build(*zip(*rows)) if rows else build(*[[]] * len(COLUMNS))

        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                ids = np.concatenate([encoder.encode(text), end])
                whole = len(ids) - len(ids) % capacity
                for start in range(0, whole, capacity):
                    rows.append((
                        doc, start, capacity, crc(ids[start : start + capacity]), len(ids), number, 0,
                    ))
                    number += 1
                if whole < len(ids):
                    rests.append((doc, len(ids), whole, ids[whole:].copy()))
            if rows:
                yield build(*zip(*rows))
            if len(rests) >= block_docs:
                yield flush()
        if rests:
            yield flush()

    return id_and_text(docs, key, text).mapInArrow(pack, SCHEMA)
