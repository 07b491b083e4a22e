import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from pairloom.llm import prefix_trie
from pairloom.llm.queries import QUERIES, SQL
from tests.oracle import connect, difference


def brute(rows):
    """The nodes by dictionaries of whole prefixes."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {conv: [t[2:] for t in sorted(turns)] for conv, turns in own.items()}
    members = {}
    full = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        base = conv - (conv % 20 if conv >= 0 else -(-conv % 20))
        full[conv] = own.get(base, [])[:h] + turns[h:]
        for d in range(len(full[conv]) + 1):
            members.setdefault(tuple(full[conv][:d]), []).append(conv)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        saved = sum(
            (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p
        )
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[:-1] == p for q in members if q)]
        ends = ",".join(str(c) for c in sorted(convs) if len(full[c]) == len(path))
        out.append((
            min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(children),
            len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def run(spark, rows):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "'own' AS key", "0 AS depth", "1 AS place", "2 AS level"
    ).repartition(3, "text")
    turns, convs = prefix_trie.in_order(table)
    base = F.col("conv_id") - F.col("conv_id") % 20
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    found = prefix_trie.prefix_trie(*prefix_trie.share_openings(turns, convs, base, shared, 3))
    return sorted((tuple(r) for r in found.collect()), key=repr)


def conversations(seed=4, convs=90):
    rng = random.Random(seed)
    texts = ["a b", "a  b c", "", "x\ty", "z"]
    return [
        (conv, turn, rng.choice(["user", "assistant"]), rng.choice(texts))
        for conv in range(convs) for turn in range(rng.randint(1, 6))
    ]


@pytest.fixture(params=["production", "small"])
def limits(request, monkeypatch):
    if request.param == "small":
        for name, value in {"MEMBERS": 3, "CHUNK": 2, "HELD": 2, "STRUNG": 3}.items():
            monkeypatch.setattr(prefix_trie, name, value)


def test_equals_brute_force(spark, limits):
    rows = conversations()
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark, limits):
    rows = [
        (None, 0, "user", "lost"), (1, None, "user", "first"), (1, 0, None, None), (1, 0, None, None),
        (1, 0, "b", "tie"), (1, 0, "a", "tie"), (-25, 0, "user", "q"), (-25, 1, "user", "r"), (-20, 0, "user", "s"),
        (21, 3, "user", "w " * 70_000), (22, 3, "user", "w " * 70_000), (20, 0, "", "turnless base"), (3, 9, "u", "v"),
    ]
    assert run(spark, rows) == brute(rows)


def test_one_long_and_many_equal_conversations(spark, limits):
    rows = [(500, turn, "user", f"t{turn % 7}") for turn in range(150)]
    rows += [(conv, 0, "user", "same") for conv in range(60)] + [(conv, 1, "user", "end") for conv in range(0, 60, 2)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "a", "b")]) == []


def test_queue_gives_back_in_order():
    queue, rng = prefix_trie.SpillingQueue(5), random.Random(1)
    entries = [(rng.randrange(50), i) for i in range(200)]
    taken = []
    for at, entry in enumerate(entries):
        queue.push((entry[0] + at, entry[1]))
        taken += queue.pop_while(lambda found, at=at: found[0] < at)
    taken += queue.pop_while(lambda found: True)
    assert sorted(taken) == sorted((value + at, i) for at, (value, i) in enumerate(entries))
    assert [value for value, _ in taken] == sorted(value for value, _ in taken)


def test_query_equals_its_twin(spark):
    folder = "/root/testdata/sf0.01"
    assert difference(
        spark, connect(folder), folder, QUERIES["op11_prefix_trie"], SQL["op11_prefix_trie"]
    ) is None
