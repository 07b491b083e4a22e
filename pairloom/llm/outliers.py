"""Quality rules: counts of a text, and robust multivariate outliers among them."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.checks import named
from pairloom.llm.common import arrow_batches
from pairloom.storage import materialize

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
_WORDLESS = re.compile(r"[\x20\x09-\x0d]*")

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: The statistics and the least standard deviation of each, in transformed units: about what one more symbol,
#: repeated line or repeated window changes in a text of usual length. Clean text is often constant in a
#: statistic; without a floor its first deviation would be infinitely far. A floor takes the place of a smaller
#: variance and adds nothing to a larger one.
FEATURES = {
    "word_length": 0.1,  # log of characters per word
    "symbol_rate": 0.5,  # log(1 + symbols per 100 words)
    "line_repeats": 0.5,  # log(1 + repeated lines per 10 lines)
    "word_repeats": 0.85,  # log(1 + words in repeated windows per 100 words)
}
SIZE = len(FEATURES)
_X = [f"x{i}" for i in range(SIZE)]
_PAIRS = [(i, j) for i in range(SIZE) for j in range(i, SIZE)]
_GROUP = ["g_lang", "g_source"]

# Fixed values of the chi-square distribution with SIZE = 4 degrees of freedom: its median, the quantile that rows
# must not pass to count in the reweighted estimate, by how much that understates the variances (0.975 over the
# distribution with 6 degrees at that quantile), and the quantiles that a stated share of clean rows passes.
CHI2_MEDIAN = 3.3567
CHI2_INSIDE, CHI2_FACTOR = 11.1433, 1.0645
CHI2_CUTOFFS = {0.01: 13.2767, 0.001: 18.4668, 0.0001: 23.5127}

#: Share of the correlations that is kept, so that a covariance can always be inverted.
CORRELATED = 0.99

#: Bins of a distance per factor of two, and of a statistic per unit.
DISTANCE_BINS, VALUE_BINS = 32, 512


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three found more than once."""
    count = len(words)
    if count < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, count)
    kinds = len(number)
    pairs = np.unique(ids[:-1] * kinds + ids[1:], return_inverse=True)[1]
    windows = pairs[:-1] * kinds + ids[2:]
    _, where, often = np.unique(windows, return_inverse=True, return_counts=True)
    twice = often[where] > 1
    covered = np.zeros(count, bool)
    for k in range(3):
        covered[k : count - 2 + k] |= twice
    return int(covered.sum())


def text_counts(text: str) -> tuple[int, int, int, int, int, int]:
    """The five counts of a text and its number of lines with a word."""
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, BLANKS))
    lines = Counter(x for x in text.split("\n") if not _WORDLESS.fullmatch(x))
    repeats = lines.total() - len(lines)
    symbols = sum(map(text.count, SYMBOLS))
    return len(words), chars, symbols, repeats, repeated_words(words), lines.total()


def count_texts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
    source: str = "source",
) -> DataFrame:
    """``doc_id, lang, source``, the counts and ``n_lines`` of every whole text.

    A null text has no words and all counts 0; null languages and sources stay null; rows that repeat
    are counted each on its own.
    """
    build = arrow_batches(
        {"doc_id": pa.int64(), "lang": pa.string(), "source": pa.string()}
        | dict.fromkeys([*COUNTS, "n_lines"], pa.int64())
    )

    def count(batches):
        for batch in batches:
            rows = [text_counts(x or "") for x in batch.column("text").to_pylist()]
            yield build(
                batch.column("doc_id"), batch.column("lang"), batch.column("source"),
                *(list(zip(*rows)) or [[]] * 6),
            )

    schema = "doc_id long, lang string, source string, " + ", ".join(
        f"{name} long" for name in (*COUNTS, "n_lines")
    )
    return docs.select(
        named(key).cast("long").alias("doc_id"), named(lang).cast("string").alias("lang"),
        named(source).cast("string").alias("source"), named(text).alias("text"),
    ).mapInArrow(count, schema)


def _statistics() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        F.log1p(100 * F.col("n_symbols") / words),
        F.log1p(10 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.log1p(100 * F.col("n_repeat_words") / words),
    ]


_FLOOR = np.square(list(FEATURES.values()))


def _sound(cov: np.ndarray) -> np.ndarray:
    """A covariance with no variance below its floor, and an inverse."""
    out = CORRELATED * cov
    np.fill_diagonal(out, np.maximum(np.diag(cov), _FLOOR))
    return out


_ESTIMATE = [*(f"m{i}" for i in range(SIZE)), *(f"p{i}{j}" for i, j in _PAIRS), "n_group"]
_ESTIMATE_SCHEMA = ", ".join(
    [*(f"{name} string" for name in _GROUP), *(f"{name} double" for name in _ESTIMATE)]
)


def _row(group, center: np.ndarray, cov: np.ndarray, count: float) -> pd.DataFrame:
    inverse = np.linalg.inv(cov)
    values = [*group, *center, *(inverse[i, j] for i, j in _PAIRS), float(count)]
    return pd.DataFrame([values], columns=[*_GROUP, *_ESTIMATE])


def _weighted_median(values: np.ndarray, counts: np.ndarray) -> float:
    order = np.argsort(values, kind="stable")
    running = np.cumsum(counts[order])
    return float(values[order][np.searchsorted(running, running[-1] / 2)])


def _start(group: tuple, table: pd.DataFrame) -> pd.DataFrame:
    """Medians, and spreads from the median absolute deviations."""
    center, spread, count = np.zeros(SIZE), np.zeros(SIZE), 0
    for i, part in table.groupby("i"):
        values, counts = part["value"].to_numpy() / VALUE_BINS, part["n"].to_numpy()
        center[i] = _weighted_median(values, counts)
        spread[i] = 1.4826 * _weighted_median(np.abs(values - center[i]), counts)
        count = counts.sum()
    return _row(group, center, _sound(np.diag(spread**2)), count)


def _moments(inside: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from sums per distance bin."""
    count = inside["n"].sum()
    center = inside[[f"s{i}" for i in range(SIZE)]].sum().to_numpy() / count
    cov = np.zeros((SIZE, SIZE))
    for i, j in _PAIRS:
        cov[i, j] = cov[j, i] = inside[f"s{i}{j}"].sum() / count - center[i] * center[j]
    return center, cov


def _concentrate(share: float, last: bool):
    """Mean and covariance of the rows at the smallest distances."""

    def estimate(group: tuple, table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("bin")
        running, total = table["n"].cumsum().to_numpy(), table["n"].sum()
        wanted = min(total, max(np.ceil(share * total), (total + SIZE + 1) // 2))
        center, cov = _moments(table.iloc[: int(np.searchsorted(running, wanted)) + 1])
        cov = _sound(cov)
        if last:  # the half with the smallest distances understates the spread of all
            at = int(np.searchsorted(running, total / 2))
            median = 2.0 ** (table["bin"].iloc[at] / DISTANCE_BINS)
            cov *= max(1.0, median / CHI2_MEDIAN)
        return _row(group, center, cov, total)

    return estimate


def _reweigh(group: tuple, table: pd.DataFrame) -> pd.DataFrame:
    """Mean and covariance of all rows that the first estimate does not find odd."""
    table = table.sort_values("bin")
    inside = table[table["bin"] <= np.floor(np.log2(CHI2_INSIDE) * DISTANCE_BINS)]
    if inside.empty:  # none is near: what is nearest stands for the group
        inside = table.iloc[:1]
    center, cov = _moments(inside)
    return _row(group, center, _sound(CHI2_FACTOR * cov), table["n"].sum())


def _squared_distance() -> Column:
    total = F.lit(0.0)
    for i, j in _PAIRS:
        term = F.col(f"p{i}{j}") * (F.col(f"x{i}") - F.col(f"m{i}")) * (F.col(f"x{j}") - F.col(f"m{j}"))
        total = total + (term if i == j else 2 * term)
    return F.greatest(total, F.lit(0.0))


def fit_mcd(vectors: DataFrame, share: float = 0.5, steps: int = 4) -> DataFrame:
    """Minimum-covariance-determinant estimates, one row per group ``g_lang, g_source``.

    The start is the medians and median absolute deviations; each concentration step takes the ``share``
    of a group's rows at the smallest Mahalanobis distances and estimates anew from them, which never
    raises the determinant. Last, all rows that this does not find odd are weighed in. A step reads the vectors once: it sums them per group and distance bin, and
    a group's bins, whose number is bounded, give subset, mean and covariance. No group's rows meet in
    one task. Rows in the last bin, ties included, all belong to the subset.
    """
    group = [F.col(name) for name in _GROUP]
    stacked = vectors.select(*group, F.posexplode(F.array(*_X)).alias("i", "x"))
    estimate = stacked.groupBy(*_GROUP, "i", F.round(F.col("x") * VALUE_BINS).alias("value")).agg(
        F.count("*").alias("n")
    ).groupBy(*_GROUP).applyInPandas(_start, _ESTIMATE_SCHEMA)
    for step in range(steps + 1):
        estimate = materialize(estimate, "mcd")
        squared = F.greatest(F.col("d2"), F.lit(2.0**-20))
        binned = vectors.join(estimate, _GROUP).withColumn("d2", _squared_distance()).groupBy(
            *_GROUP, F.ceil(F.log2(squared) * DISTANCE_BINS).alias("bin")
        ).agg(
            F.count("*").alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(SIZE)),
            *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in _PAIRS),
        )
        estimate = binned.groupBy(*_GROUP).applyInPandas(
            _reweigh if step == steps else _concentrate(share, step == steps - 1), _ESTIMATE_SCHEMA
        )
    return materialize(estimate, "mcd")


def quality_rules(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
    source: str = "source", rate: float = 0.001, min_words: int = 50, repeat_percent: int = 50,
) -> DataFrame:
    """One row per document: its counts, ``base_failed``, ``kept`` and the Mahalanobis ``distance``.

    ``base_failed``: fewer than ``min_words`` words, or more than ``repeat_percent`` percent of them in
    repeated windows. The others of each language and source are fitted (`fit_mcd`); those
    further from their group's centre than all but a share ``rate`` of normally distributed rows would be
    (a key of `CHI2_CUTOFFS`) are not kept. The distance is null where the base rules fail.

    Null texts have no words and fail; a null language or source is a group of its own; a group of one
    row keeps it; repeated rows each count; an empty table gives no rows.
    """
    cutoff = CHI2_CUTOFFS[rate] ** 0.5
    counts = materialize(count_texts(docs, key, text, lang, source), "counts")
    failed = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words")
    )
    counts = counts.withColumn("base_failed", failed)
    for name, column in zip(_GROUP, ("lang", "source")):  # nulls join as a value of their own
        counts = counts.withColumn(name, F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit("")))
    vectors = counts.where("NOT base_failed").select(
        *_GROUP, *(x.alias(name) for name, x in zip(_X, _statistics()))
    )
    estimate = fit_mcd(vectors)
    judged = counts.select("*", *(x.alias(name) for name, x in zip(_X, _statistics()))).join(
        estimate, _GROUP, "left"
    )
    distance = F.when(~F.col("base_failed"), F.sqrt(_squared_distance()))
    return judged.withColumn("distance", distance).select(
        "doc_id", *COUNTS, "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(False))).alias("kept"),
        "distance",
    )
