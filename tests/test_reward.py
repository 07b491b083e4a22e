from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom import operators as op
from pairloom.operators.reward import _bucket
from pairloom.plans.catalog import QUERIES


def planted(spark, n):
    """Chosen texts hold more good words than bad ones, amid noise."""
    noise = F.concat_ws(" ", *(
        F.concat(F.lit("w"), F.pmod(F.hash("id", F.lit(i)), F.lit(40)).cast("string")) for i in range(6)
    ))
    return spark.range(n).select(
        "id", F.concat(noise, F.lit(" good fine")).alias("chosen"),
        F.concat(F.reverse(noise), F.lit(" bad")).alias("rejected"),
    )


def buckets(spark, words, features):
    table = spark.createDataFrame([(word,) for word in words], "w string")
    return {r.w: r.b for r in table.select("w", _bucket(F.col("w"), features).alias("b")).collect()}


def plain_fit(x, reg, steps=200):
    """Newton steps on the loss, one pair a row."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(x @ w))
        gradient = -(x * p[:, None]).mean(axis=0) + reg * w
        curvature = (x * (p * (1 - p))[:, None]).T @ x / len(x) + reg * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        w -= step
        if np.abs(step).max() < 1e-13:
            break
    return w, float(np.log1p(np.exp(-(x @ w))).mean())


def test_equals_a_plain_fit(spark):
    features, table = 64, planted(spark, 150)
    rows = table.collect()
    at = buckets(spark, {w for r in rows for w in f"{r.chosen} {r.rejected}".split()}, features)
    x = np.zeros((len(rows), features))
    for i, row in enumerate(rows):
        for word in row.chosen.split():
            x[i, at[word]] += 1
        for word in row.rejected.split():
            x[i, at[word]] -= 1
    weights, loss = plain_fit(x, 0.05)
    fitted = op.fit_pairwise_reward(table, features=features, reg=0.05, max_iter=200)
    assert fitted.weights == pytest.approx(weights, abs=1e-4)
    assert fitted.evaluate(table).first().log_loss == pytest.approx(loss, abs=1e-5)


def test_a_planted_signal_on_unseen_pairs(spark):
    split = op.hash_split(planted(spark, 400), "id", 0.25)
    fitted = op.fit_pairwise_reward(split.where("split = 'train'"), features=1 << 10)
    held_out = split.where("split = 'validation'")
    result = fitted.evaluate(held_out).first()
    assert result.pairs == held_out.count() > 50 and result.accuracy > 0.9 and result.log_loss < 0.3
    assert tuple(fitted.pair_accuracy(held_out).first()) == (result.pairs, result.accuracy)
    scored = fitted.score(held_out, "chosen")
    assert scored.columns == [*held_out.columns, "score"]


def test_turning_all_pairs_round_turns_the_weights_round(spark):
    table = planted(spark, 100)
    one = op.fit_pairwise_reward(table, features=64)
    two = op.fit_pairwise_reward(table, "rejected", "chosen", features=64)
    assert one.weights == pytest.approx(-two.weights, abs=1e-4)


def test_odd_texts(spark):
    table = spark.createDataFrame(
        [("a b", "a c"), ("a", "a"), (None, "c"), ("", ""), ("b " * 5000, "c"), ("b", None)],
        "chosen string, rejected string",
    ).withColumns({"_up": F.lit("own"), "row": F.lit(0), "term": F.lit(1)})
    fitted = op.fit_pairwise_reward(table, features=16)
    assert fitted.evaluate(table).first().pairs == 6
    scores = {r.chosen: r.score for r in fitted.score(table, "chosen").collect()}
    assert scores[None] is None and scores[""] == 0 and scores["b " * 5000] > 0
    with pytest.raises(ValueError, match="no pairs"):
        op.fit_pairwise_reward(table.limit(0))


def test_word_differences(spark):
    rows = [(i, f"a b{i % 3} a", f"b1 {'c ' * i}") for i in range(8)] + [(9, None, "x"), (10, "", "")]
    table = spark.createDataFrame(rows, "pair int, chosen string, rejected string").withColumn("sign", F.lit(5))
    found = {(r.pair, r.word): r.difference for r in op.word_differences(table, "pair").collect()}
    wanted = {}
    for pair, chosen, rejected in rows:
        count = Counter((chosen or "").split())
        count.subtract((rejected or "").split())
        wanted |= {(pair, word): n for word, n in count.items() if n}
    assert found == wanted


def test_quality_is_learnt_from_the_given_pairs(spark):
    result = QUERIES["reward_on_quality"].run(spark, "/root/testdata/sf0.1").first()
    assert result.pairs >= 50 and result.accuracy > 0.85 and result.log_loss < 0.4


def test_evaluation_scores_both_texts_in_one_worker(spark, plan_of, monkeypatch):
    from pairloom.operators import reward

    monkeypatch.setattr(reward, "SCORED", 3)
    model = reward.PairwiseReward(np.arange(16, dtype=float) - 7)
    texts = ["", None, "a", "a b c a", "d e", "f g h", "i", "j k", "l m n", "o p"]
    table = spark.createDataFrame([(a, b) for a in texts for b in texts], "chosen string, rejected string")
    assert plan_of(model.evaluate(table)).count("ArrowEvalPython") == 1
    of = dict(map(tuple, model.score(table, "chosen").select("chosen", "score").distinct().collect()))
    whole = model.score(spark.createDataFrame([("a",), ("b",), ("c",)], "t string"), "t").collect()
    alone = {r.t: r.score for r in whole}
    assert of["a b c a"] == 2 * alone["a"] + alone["b"] + alone["c"] and of[""] == 0 and of[None] is None
    margins = [of[a] - of[b] for a in texts for b in texts if a is not None and b is not None]
    row = model.evaluate(table).first()
    assert row.pairs == 100
    assert row.accuracy == pytest.approx(np.mean(np.array(margins) > 0))
    assert row.log_loss == pytest.approx(np.mean(np.logaddexp(0, -np.array(margins))))
