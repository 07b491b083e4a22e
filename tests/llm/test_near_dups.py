import random
from pathlib import Path

import numpy as np
import pytest

from pairloom.llm import near_dups
from pairloom.llm.common import connected_components


def words(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "").split()


def shingles(text, size):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}


def brute(rows, size, percent):
    sets = {}
    for key, text in rows:
        sets.setdefault(key, []).append(shingles(text, size))
    keys = [k for k in sets if k is not None]
    label = {k: k for k in keys}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                low, high = sorted((root(a), root(b)))
                label[high] = low
    return {k: root(k) for k in keys}


def corpus(seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, 500)}" for _ in range(rng.randint(20, 120))] for _ in range(12)]
    rows, key = [], 0
    for text in base:
        for _ in range(rng.randint(1, 14)):
            edited = [w if rng.random() > 0.03 else f"n{rng.randint(0, 99)}" for w in text]
            rows.append((key, " ".join(edited)))
            key += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_are_those_of_all_pairs(documents, seed):
    rows = corpus(seed)
    rows += [(900, None), (901, ""), (902, "one two"), (903, "ONE  two"), (904, "two one"), (905, " \n")]
    rows += [rows[0], (None, rows[0][1]), (None, None), (906, "é É"), (907, "é é")]
    found = near_dups.near_duplicates(documents(rows)).collect()
    want = brute(rows, 5, 80)
    mine = {r.doc_id: r.component_id for r in found if r.doc_id is not None}
    assert mine == want
    assert all(r.kept == (r.doc_id is not None and r.component_id == r.doc_id) for r in found)
    sizes = {r.doc_id: r.n_shingles for r in found}
    assert all(sizes[k] == len(shingles(t, 5)) for k, t in rows if k is not None)
    assert near_dups.near_duplicates(documents([])).count() == 0


def test_large_buckets_are_split_and_groups_cut(documents, monkeypatch):
    monkeypatch.setattr(near_dups, "BUCKET", 3)
    monkeypatch.setattr(near_dups, "GROUP", 2)
    rows = corpus(3)
    found = near_dups.near_duplicates(documents(rows)).collect()
    assert {r.doc_id: r.component_id for r in found} == brute(rows, 5, 80)


def test_pairs_at_the_threshold_meet_in_large_buckets(documents, monkeypatch):
    """Twins at just over 0.8, all with one long run in common, which puts them into buckets with many others."""
    for name, value in {"BUCKET": 32, "BANDS": 12, "ROWS": 2, "WHOLE": 152}.items():
        monkeypatch.setattr(near_dups, name, value)
    rng = random.Random(5)
    shared, rows = [f"s{i}" for i in range(208)], []
    for i in range(100):
        text = shared + [f"p{i}x{rng.randint(0, 10**6)}" for _ in range(37)]
        other = [*text[:-25], *(f"q{i}x{k}" for k in range(25))]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(other))]
    want = brute(rows, 5, 80)
    assert len(set(want.values())) == 100
    found = near_dups.near_duplicates(documents(rows)).collect()
    assert {r.doc_id: r.component_id for r in found} == want


@pytest.mark.parametrize("held", [near_dups.HELD, 900])
def test_candidates_below_the_threshold_are_rows_by_member_not_by_pair(documents, monkeypatch, held):
    """Many texts of similarity 0.77 to each other, none linked, and two at 0.9 to one of them."""
    written, write = {}, near_dups.materialize

    def count(df, label="table", by=()):
        table = write(df, label, by)
        written[label] = max(written.get(label, 0), table.count())
        return table

    monkeypatch.setattr(near_dups, "materialize", count)
    monkeypatch.setattr(near_dups, "HELD", held)
    rng = random.Random(9)
    shared = [f"s{i}" for i in range(200)]
    rows = [(i, " ".join([*shared, *(f"p{i}x{rng.randint(0, 10**6)}" for _ in range(26))])) for i in range(80)]
    rows += [(80 + i, " ".join([*rows[7][1].split()[:-4], f"e{i}"])) for i in range(2)]
    found = near_dups.near_duplicates(documents(rows)).collect()
    assert {r.doc_id: r.component_id for r in found} == brute(rows, 5, 80)
    pairs = len(rows) * (len(rows) - 1) // 2
    assert written["candidates"] > 80 and max(written["pairs"], written["links"]) < pairs // 4
    if held == near_dups.HELD:
        assert written["candidates"] < pairs // 4


def test_blocks_are_bounded_and_a_joined_component_is_not_compared(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BUCKET", 200)
    rows = [(9, 3, key, 1 if key < 900 else key, 1000, 900, 1) for key in range(1, 1001)]
    rows += [(8, 3, key, key % 2, 50, 25, 0) for key in range(50)]
    names = "band long, number int, key long, component long, size long, most long, major long"
    groups = {}
    for r in near_dups._in_blocks(spark.createDataFrame(rows, names)).collect():
        groups.setdefault((r.band, r.x, r.y), []).append(r)
    assert max(map(len, groups.values())) <= 200
    met = {8: set(), 9: set()}
    for (band, x, y), members in groups.items():
        assert len({r.component for r in members}) > 1
        met[band] |= {
            (a.key, b.key) for a in members for b in members
            if a.key < b.key and a.component != b.component and (x == y or a.block != b.block)
        }
    for band in met:
        mine = {r[2]: r[3] for r in rows if r[0] == band}
        assert met[band] == {(a, b) for a in mine for b in mine if a < b and mine[a] != mine[b]}


def test_bayes_bound_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    least = near_dups.least_agreements(near_dups.SIGNATURE, 0.8, 1e-6)
    agree = rng.random((20_000, near_dups.SIGNATURE)) < 0.8
    for k, bound in enumerate(least):
        assert (agree[:, : (k + 1) * near_dups.BATCH].sum(1) >= bound).all()
    low = rng.random((20_000, near_dups.SIGNATURE)) < 0.3
    assert (low[:, : near_dups.BATCH].sum(1) >= least[0]).mean() < 0.25


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)]
    edges += [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(50)] + [(5, 5)]
    found = {r.node: r.component for r in connected_components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((root(a), root(b)))
            label[high] = low
    assert found == {x: root(x) for x in list(label)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("name", ["op1_minhash_dedup", "op2_warc_roundtrip", "op7_mtree_topk"])
def test_query_equals_its_twin(spark, name):
    from pairloom.llm.queries import QUERIES, SQL
    from tests.oracle import connect, difference

    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("no test data")
    assert difference(spark, connect(folder), folder, QUERIES[name], SQL[name]) is None
