import math
import random

from pyspark.sql import functions as F

from pairloom.llm import metric_tree


def brute(rows, k):
    valid = [
        (key, [math.floor(1024 * x) for x in v]) for key, v in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    asked = {}
    for key, v in valid:
        if key is not None and key % 10 == 0:
            asked[key] = min(v, asked.get(key, v))
    out = {}
    for own, q in asked.items():
        scored = sorted(
            (-sum(a * b for a, b in zip(q, v)), key) for key, v in valid if key is not None and key != own
        )
        out[own] = [(i + 1, key, -score) for i, (score, key) in enumerate(scored[:k])]
    return out


def run(spark, rows, k=10):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1))
    found = {}
    for r in metric_tree.top_k(table, F.col("vec_id") % 10 == 0, k).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {key: sorted(v) for key, v in found.items()}


def test_equals_all_scores(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    rows += [(400 + i, [0.5] * 6) for i in range(120)]
    rows += [(600, None), (601, [None, 1.0]), (602, [float("nan")] * 6), (603, [float("inf")] + [0.0] * 5),
             (604, []), (610, [1.0, 2.0]), (None, [1.0] * 6), (410, [0.5] * 6), (10, [0.1] * 6)]
    monkeypatch.setattr(metric_tree, "PAGE", 8)
    monkeypatch.setattr(metric_tree, "PART", 50)
    monkeypatch.setattr(metric_tree, "SAMPLE", 64)
    monkeypatch.setattr(metric_tree, "ROUTING", 9)
    assert run(spark, rows) == brute(rows, 10)


def test_few_rows(spark):
    assert run(spark, [(10, [1.0]), (11, [2.0]), (20, [3.0])]) == brute(
        [(10, [1.0]), (11, [2.0]), (20, [3.0])], 10)
    assert run(spark, []) == {}
