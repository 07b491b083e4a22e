import math

import pytest
from pyspark.sql import functions as F

from pairloom import operators as op
from pairloom.plans import recipes


def plain_curve(values, n_max=None):
    """The definition, value by value."""
    values, curve = sorted(values), {}
    total = len(values)
    for n in range(1, min(total, n_max or total) + 1):
        p = [(i / total) ** n - ((i - 1) / total) ** n for i in range(1, total + 1)]
        mean = sum(v * q for v, q in zip(values, p))
        curve[n] = (mean, math.sqrt(sum((v - mean) ** 2 * q for v, q in zip(values, p))))
    return curve


def table(spark, groups):
    rows = [(m, v) for m, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "method string, v double")


CASES = {
    "one": [0.7], "equal": [0.5] * 6, "ties": [0.1, 0.5, 0.5, 0.7, 0.3, 0.5],
    "many": [((i * 37) % 101) / 101 for i in range(80)], "negative": [-3.0, 1e6, 2.0],
}


def test_curves_equal_the_definition(spark):
    got = op.expected_max(table(spark, CASES), "method", "v").collect()
    assert len(got) == sum(map(len, CASES.values()))
    for row in got:
        mean, std = plain_curve(CASES[row.method])[row.n]
        assert row.mean == pytest.approx(mean, rel=1e-12)
        assert row["std"] == pytest.approx(std, rel=1e-9, abs=1e-12)
        assert (row.min, row.max) == (min(CASES[row.method]), max(CASES[row.method]))
        assert row.n_max == len(CASES[row.method])


def test_curve_properties(spark):
    curve = {r.n: r for r in op.expected_max(table(spark, CASES), "method", "v")
             .where("method = 'many'").collect()}
    assert curve[1].mean == pytest.approx(sum(CASES["many"]) / 80)
    assert all(curve[n].mean <= curve[n + 1].mean + 1e-12 for n in range(1, 80))


def test_missing_values_and_n_max(spark):
    df = table(spark, {"a": [0.2, None, float("nan"), 0.8, 0.4], "none": [None]})
    got = op.expected_max(df, "method", "v", n_max=2).collect()
    assert sorted((r.method, r.n) for r in got) == [("a", 1), ("a", 2)]
    assert {r.n: r.mean for r in got}[2] == pytest.approx(plain_curve([0.2, 0.4, 0.8])[2][0])
    assert op.expected_max(df.where("false"), "method", "v").count() == 0


def test_one_heavy_method_is_spread_over_range_partitions(spark, monkeypatch, plan_of):
    """Values of one method in many partitions give the curve of the whole method."""
    import pairloom.operators.sweeps as sweeps

    monkeypatch.setattr(sweeps, "TASK_WORK", 1000)
    values = [((i * 7919) % 10007) / 10007 for i in range(3000)]
    df = table(spark, {"hot": values, "small": [0.1, 0.9]}).repartition(7)
    counts, tasks = sweeps._partitioned_counts(df, "method", "v", 4)
    sizes = [r["count"] for r in counts.groupBy("part").count().collect()]
    assert tasks == 8 and len(sizes) > 8 and max(sizes) < 3000 / 5
    curves = op.expected_max(df, "method", "v", n_max=4)
    got = {(r.method, r.n): r for r in curves.collect()}
    for n, (mean, std) in plain_curve(values, 4).items():
        assert got["hot", n].mean == pytest.approx(mean, rel=1e-10)
        assert got["hot", n]["std"] == pytest.approx(std, rel=1e-9)
    assert ("small", 3) not in got and got["small", 1].mean == pytest.approx(0.5)


def test_a_full_curve_has_no_limit(spark):
    """12,000 values: every point equals the plain formula."""
    import numpy as np

    rng = np.random.default_rng(4)
    values = np.round(rng.normal(0.5, 0.1, 12_000), 2)
    rows = spark.createDataFrame([("m", float(v)) for v in values], "method string, v double")
    got = op.expected_max(rows, "method", "v").orderBy("n").toPandas()
    assert got.n.tolist() == list(range(1, 12_001))
    distinct, counts = np.unique(values, return_counts=True)
    upto = np.cumsum(counts) / len(values)
    below = np.concatenate([[0.0], upto[:-1]])
    for n in (1, 2, 17, 900, 11_999, 12_000):
        chance = upto**n - below**n
        mean = (distinct * chance).sum()
        std = np.sqrt(max(0.0, ((distinct - mean) ** 2 * chance).sum()))
        row = got.iloc[n - 1]
        assert row["mean"] == pytest.approx(mean, rel=1e-9) and row["std"] == pytest.approx(std, abs=1e-7)


def test_numbered_methods_are_matched_as_numbers(spark):
    rows = spark.createDataFrame(
        [(1, 0.1, 5, 0.5), (1, 0.1, 6, 0.7), (0, 0.1, 5, 0.4)], "p int, kl double, every int, winrate double"
    )
    from pairloom.plans.recipes import single_sweep

    curves = single_sweep(rows, kl="kl", method="p", interval="every", keep=["1.0"]).collect()
    assert {r.method for r in curves} == {"1.0"} and len(curves) >= 1


@pytest.mark.parametrize("values", [
    [0.71 + i * 1e-9 for i in range(50)], [1.0] * 400 + [1e6], [-1e6] + [1.0] * 400,
    [1e12 + i for i in range(30)],
])
def test_the_spread_survives_cancellation(spark, values):
    for row in op.expected_max(table(spark, {"m": values}), "method", "v", n_max=30).collect():
        mean, std = plain_curve(values, 30)[row.n]
        assert row.mean == pytest.approx(mean, rel=1e-12)
        # The plain formula itself has an error of some units in the last place of the values.
        assert row["std"] == pytest.approx(std, rel=1e-7, abs=max(map(abs, values)) * 1e-14)


def test_means_leave_out_missing_keys_and_values(spark):
    df = spark.createDataFrame(
        [(0.1, 1, 0.5), (0.1, 1, 0.7), (0.1, 1, None), (0.1, 1, float("nan")), (None, 1, 9.0),
         (float("nan"), 1, 9.0), (0.1, None, 9.0), (0.3, 1, 0.0)],
        "kl double, every int, winrate double",
    )
    got = {(r.kl, r.every): r.winrate for r in op.mean_by(df, ["kl", "every"], "winrate").collect()}
    assert got == {(0.1, 1): pytest.approx(0.6), (0.3, 1): 0.0}


def test_methods_are_ordered_with_names_first(spark):
    df = spark.createDataFrame(
        [(m, n) for m in ("0.2", "1.0", "FedAvg", "0.6") for n in (2, 1)], "method string, n int"
    )
    assert [(r.method, r.n) for r in op.order_methods(df).collect()] == [
        (m, n) for m in ("FedAvg", "1.0", "0.6", "0.2") for n in (1, 2)
    ]


def test_last_point_is_trimmed_for_all_but_one(spark):
    df = op.expected_max(table(spark, {"0.2": [1.0, 2.0], "1.0": [1.0, 2.0, 3.0]}), "method", "v")
    kept = op.trim_curve(df, "0.2")
    assert sorted((r.method, r.n) for r in kept.collect()) == [
        ("0.2", 1), ("0.2", 2), ("1.0", 1), ("1.0", 2),
    ]


def sweep(spark):
    rows = [
        (kl, sp, ue, (i + j * 3 + k * 7 + r) % 11 / 11)
        for i, kl in enumerate((0.03, 0.1, 0.3)) for j, sp in enumerate((0.2, 0.4, 1.0))
        for k, ue in enumerate((1, 3, 7)) for r in range(4)
    ]
    return rows, spark.createDataFrame(
        rows,
        "advantage_reward_kl_coeff double, reference_protocol_weightage_self_preference double, "
        "reference_update_every_n_steps int, winrate double",
    )


def means(rows, sp):
    settings = {}
    for kl, own, ue, v in rows:
        if own == sp:
            settings.setdefault((kl, ue), []).append(v)
    return [sum(vs) / len(vs) for vs in settings.values()]


def test_single_sweep(spark):
    rows, df = sweep(spark)
    got = recipes.single_sweep(df)
    assert {r.method for r in got.collect()} == {"1.0", "0.2"}
    for r in got.collect():
        mean, std = plain_curve(means(rows, float(r.method)))[r.n]
        assert r.mean == pytest.approx(mean) and r["std"] == pytest.approx(std)
        assert r.lo == pytest.approx(mean - std) and r.hi == pytest.approx(mean + std)
    trimmed = recipes.single_sweep(df, left_out_kl=recipes.LEFT_OUT_KL, full="0.2")
    counts = {r.method: r["count"] for r in trimmed.groupBy("method").count().collect()}
    assert counts == {"1.0": 2, "0.2": 3}


def test_sweep_with_a_federated_method(spark):
    rows, df = sweep(spark)
    fed = df.where("reference_protocol_weightage_self_preference = 0.4").select(
        "advantage_reward_kl_coeff", "reference_update_every_n_steps",
        (F.col("winrate") / 2).alias("global_winrate"), F.lit(0.14).alias("self_preference"),
        F.lit("x").alias("only_here"),
    )
    got = {(r.method, r.n): r for r in recipes.sweep_with_federated(df, fed).collect()}
    assert {m for m, _ in got} == {"FedAvg", "1.0", "0.2"}
    assert got["1.0", 1].label == "Isolated" and got["0.2", 1].label == "PR 0.2"
    mean, std = plain_curve([v / 2 for v in means(rows, 0.4)])[9]
    assert got["FedAvg", 9].mean == pytest.approx(mean)
    assert got["FedAvg", 9]["std"] == pytest.approx(std)
