"""A reward model that a cluster without GPUs can fit: Bradley-Terry on word counts.

A pair enters the fit as one sparse vector, the word counts of its chosen text less those of its rejected one; the
chance that the chosen text wins is the logistic function of the vector's product with the weights. The
vectors are put together by Spark's own functions and written once; Spark ML reads them in each iteration,
and only gradients of fixed length leave the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.checks import fresh, named, need_columns
from pairloom.operators.tokens import words
from pairloom.storage import materialize

#: Texts of a batch whose weights are looked up at a time: a bound on a worker's memory.
SCORED = 500


def _signed(chosen: str, rejected: str, as_term) -> Column:
    """Each word of both texts with +1 or -1, as an array of ``(term, sign)``. A null text has no words."""

    def side(column: str, sign: int) -> Column:
        found = F.coalesce(words(named(column)), F.array().cast("array<string>"))
        return F.transform(found, lambda word: F.struct(as_term(word).alias("term"), F.lit(sign).alias("sign")))

    return F.concat(side(chosen, 1), side(rejected, -1))


def _differences(df: DataFrame, key: str, signed: Column) -> DataFrame:
    """``key, term, difference``, without terms that both texts have as often."""
    terms = df.select(named(key), F.explode(signed).alias("_t")).select(named(key), "_t.term", "_t.sign")
    return terms.groupBy(named(key), "term").agg(F.sum("sign").alias("difference")).where("difference <> 0")


def word_differences(
    df: DataFrame, key: str, chosen: str = "chosen", rejected: str = "rejected"
) -> DataFrame:
    """How much oftener each word stands in the chosen text: ``key, word, difference``."""
    need_columns(df, key, chosen, rejected)
    return _differences(df, key, _signed(chosen, rejected, lambda word: word)).withColumnRenamed("term", "word")


def _bucket(word: Column, features: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(features)).cast("int")


@dataclass(frozen=True)
class PairwiseReward:
    """A fitted reward model: a score for every text, higher for the ones preferred."""

    weights: np.ndarray

    def score(self, df: DataFrame, text: str, out: str = "score") -> DataFrame:
        """Add the score of a text column: the sum of its words' weights, 0 without words, null for null."""
        need_columns(df, text)
        return df.withColumn(out, self._scores(df, [text])["score0"])

    def _scores(self, df: DataFrame, texts: list[str]) -> Column:
        """A struct ``score0, score1, ...`` of the scores of text columns, all by one Python worker a task."""
        # As many weights as the fit had features.
        held = df.sparkSession.sparkContext.broadcast(self.weights)
        names = [f"score{at}" for at in range(len(texts))]

        def sums(column: pa.Array) -> pa.Array:
            out = np.zeros(len(column))
            for at in range(0, len(column), SCORED):
                part = column.slice(at, SCORED)
                lengths = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
                found = held.value[part.flatten().to_numpy(zero_copy_only=False)]
                out[at : at + len(part)] = np.bincount(np.repeat(np.arange(len(part)), lengths), found, len(part))
            return pa.array(out, pa.float64(), mask=column.is_null().to_numpy(zero_copy_only=False))

        def totals(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for batch in batches:
                columns = batch if isinstance(batch, tuple) else (batch,)  # Spark hands a single one over as it is
                yield pa.StructArray.from_arrays([sums(column) for column in columns], names=names)

        features = len(self.weights)
        buckets = [F.transform(words(named(text)), lambda word: _bucket(word, features)) for text in texts]
        scored = F.arrow_udf(totals, ", ".join(f"{name} double" for name in names)).asNondeterministic()
        return scored(*buckets)

    def evaluate(self, df: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
        """One row: pairs, the share in which the chosen text scores higher, and the mean log loss.

        The loss of a model that knows nothing is log 2.
        """
        need_columns(df, chosen, rejected)
        held = fresh(df, "_scores")
        both = df.select(self._scores(df, [chosen, rejected]).alias(held))
        margin = F.col(held)["score0"] - F.col(held)["score1"]
        loss = F.greatest(-margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin)))
        return both.agg(
            F.count("*").alias("pairs"), F.avg((margin > 0).cast("double")).alias("accuracy"),
            F.avg(loss).alias("log_loss"),
        )

    def pair_accuracy(
        self, df: DataFrame, chosen: str = "chosen", rejected: str = "rejected"
    ) -> DataFrame:
        """One row: pairs, and the share in which the chosen text scores higher."""
        return self.evaluate(df, chosen, rejected).select("pairs", "accuracy")


def difference_vectors(df: DataFrame, chosen: str, rejected: str, features: int) -> DataFrame:
    """``features, label``: a sparse vector per pair, every other pair turned round with label 0.

    Turning a pair round changes nothing in the loss; Spark ML wants to see both labels.
    """
    pairs = materialize(
        df.select(named(chosen).alias("chosen"), named(rejected).alias("rejected")).withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "pairs",
    )
    found = _differences(pairs, "row", _signed("chosen", "rejected", lambda word: _bucket(word, features)))
    gathered = found.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("term", "difference"))).alias("entries")
    )
    entries = F.coalesce("entries", F.array().cast("array<struct<term:int,difference:bigint>>"))
    label = F.pmod(F.xxhash64("row"), F.lit(2)).cast("double")
    vector = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(features).alias("size"),
        F.transform(entries, lambda e: e["term"]).alias("indices"),
        F.transform(entries, lambda e: e["difference"] * (2 * label - 1)).alias("values"),
    )
    written = materialize(
        pairs.select("row").join(gathered, "row", "left").select(vector.alias("features"), label.alias("label")),
        "difference-vectors",
    )
    # The struct is what Spark ML's vectors are made of: read as such, they need no Python.
    schema = T.StructType([T.StructField("features", VectorUDT()), T.StructField("label", T.DoubleType())])
    return df.sparkSession.read.schema(schema).parquet(*written.inputFiles())


def fit_pairwise_reward(
    df: DataFrame,
    chosen: str = "chosen",
    rejected: str = "rejected",
    features: int = 1 << 16,
    reg: float = 0.01,
    max_iter: int = 50,
) -> PairwiseReward:
    """Fit a score so that chosen texts beat rejected ones.

    Minimises the mean of ``log(1 + exp(score(rejected) - score(chosen)))`` plus ``reg / 2`` times the squared
    weights. Words are counted in ``features`` buckets by their hash.
    """
    need_columns(df, chosen, rejected)
    vectors = difference_vectors(df, chosen, rejected, features)
    labels = [row[0] for row in vectors.select("label").distinct().collect()]
    if not labels:
        raise ValueError("there are no pairs to fit on")
    fit = LogisticRegression(
        fitIntercept=False, standardization=False, regParam=reg, maxIter=max_iter, tol=1e-9
    )
    return PairwiseReward(fit.fit(vectors).coefficients.toArray())
