import numpy as np
import pytest

from pairloom.llm import tree_forest
from pairloom.llm.common import read_table
from pairloom.llm.queries import op12_tree_forest

FOLDER = "/root/testdata/sf0.001"


def brute(rows, threshold=0.95):
    """Links, least reachable id: by all pairs."""
    good = [
        (key, np.array(v, np.float64)) for key, v in rows
        if key is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    units = [v / np.abs(v).max() for _, v in good]
    units = [v / np.sqrt((v * v).sum()) for v in units]
    links, reach = [0] * len(good), [key for key, _ in good]
    pairs = [
        (i, j) for i in range(len(good)) for j in range(i)
        if len(units[i]) == len(units[j]) and float(units[i] @ units[j]) >= threshold
    ]
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    twins = [(i, j) for i in range(len(good)) for j in range(i) if good[i][0] == good[j][0]]
    changed = True
    while changed:
        changed = False
        for i, j in pairs + twins:
            least = min(reach[i], reach[j])
            changed |= reach[i] != least or reach[j] != least
            reach[i] = reach[j] = least
    out = sorted((key, n, c, key == c) for (key, _), n, c in zip(good, links, reach))
    ids = [key for key, _ in good]
    left = list(rows)
    for key, v in rows:
        if key in ids and any(k == key and len(w) == len(v or ()) and np.array_equal(w, v) for k, w in good):
            left.remove((key, v))
    return sorted([*out, *((k, 0, k, None if k is None else True) for k, _ in left)], key=repr)


def run(spark, rows, **options):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr(
        "*", "'x' AS key", "1 AS v", "2 AS class", "3 AS leaf"
    )
    return sorted((tuple(r) for r in tree_forest.near_copies(table, **options).collect()), key=repr)


def clustered(seed=3, groups=40, width=16):
    """Loose and tight groups around random directions, and one family of near copies."""
    rng = np.random.default_rng(seed)
    rows = []
    for group in range(groups):
        centre = rng.standard_normal(width)
        for _ in range(int(rng.integers(1, 12))):
            rows.append(centre + rng.standard_normal(width) * rng.choice([0.02, 0.15, 0.3]))
    centre = rng.standard_normal(width)
    rows += [centre + rng.standard_normal(width) * 0.04 for _ in range(120)]
    return [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(rows)) * 3, rows)]


@pytest.fixture
def small(monkeypatch):
    for name, value in {"SAMPLE": 128, "BALL_SAMPLE": 128, "FAMILY": 8, "LEAF": 12, "LEAF_ROWS": 24,
                        "LEAF_SAMPLE": 32, "FEWEST": 4}.items():
        monkeypatch.setattr(tree_forest, name, value)


def test_equals_all_pairs(spark, small):
    rows = clustered()
    assert run(spark, rows) == brute(rows)


def test_a_family_beyond_any_leaf_without_balls(spark, small, monkeypatch):
    monkeypatch.setattr(tree_forest, "FAMILIES", 0)
    rows = clustered(seed=5, groups=10)
    assert run(spark, rows) == brute(rows)


def test_leaves_are_split_on(spark, small, monkeypatch):
    """Grown on few vectors, the first trees have leaves that are far too large."""
    monkeypatch.setattr(tree_forest, "SAMPLE", 16)
    rng = np.random.default_rng(11)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(300)]
    rows += [(1000 + i, (np.array(v) * 2 + rng.standard_normal(16) * 0.02).tolist()) for i, v in rows[:60]]
    found, wanted = run(spark, rows, miss=1e-9), brute(rows)
    recall = sum(a[1] for a in found) / sum(b[1] for b in wanted)
    assert recall >= 0.95
    assert all(a[1] <= b[1] for a, b in zip(found, wanted))


def test_recall_right_at_the_threshold(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((4000, 32))
    base /= np.linalg.norm(base, axis=1)[:, None]
    noise = rng.standard_normal((500, 32))
    noise -= (noise * base[:500]).sum(axis=1)[:, None] * base[:500]
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    pairs = 0.951 * base[:500] + np.sqrt(1 - 0.951**2) * noise
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, pairs]))]
    assert sum(r[1] for r in run(spark, rows)) >= 0.99 * 2 * 500


def test_odd_rows(spark):
    rows = [
        (5, [1.0, 0.0]), (4, [2.0, 0.0]), (9, [1.0, 0.0]), (9, [0.0, 1.0]), (8, [0.0, 3.0]), (None, [1.0, 0.0]),
        (1, None), (2, []), (3, [0.0, 0.0]), (6, [None, 1.0]), (7, [float("nan"), 1.0]),
        (10, [float("inf"), 1.0]), (11, [1.0]), (12, [1e300, 0.0]), (13, [1e-300, 1e-302]), (14, [1.0, 0.0, 0.0]),
    ]
    assert run(spark, rows) == brute(rows)


def test_empty_and_unusable(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (None, [])]) == [(1, 0, 1, True), (None, 0, None, None)]


def test_query_equals_all_pairs(spark):
    table = read_table(spark, FOLDER, "embeddings").toPandas()
    rows = [(int(k), list(map(float, v))) for k, v in zip(table["vec_id"], table["embedding"])]
    found = op12_tree_forest(spark, FOLDER)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows)
