"""Language of a text by expectation-maximisation over language proportions."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.checks import named, need_columns
from pairloom.llm.common import arrow_batches, id_and_text

#: Byte runs of this many bytes are counted in this many buckets.
GRAM, BUCKETS = 3, 1 << 16
#: Added to each bucket's count.
PRIOR = 0.5
#: Most steps for a text, and the change of a proportion at which it has settled.
STEPS, SETTLED = 30, 1e-4

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order, and the log-probability of each bucket (rows) in each of them (columns)."""

    languages: tuple[str, ...]
    log_likelihood: np.ndarray


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the lower-cased text's byte runs, blanks around it included, and their counts."""
    data = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    value = np.zeros(max(0, len(data) - GRAM + 1), np.uint32)
    for k in range(GRAM):
        value = value * np.uint32(0x01000193) + data[k : k + len(value)]
    value = (value * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return np.unique(value, return_counts=True)


def fit_languages(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Run counts of all rows with a text and a language.

    A task adds its counts up per language before anything is shuffled; the model is BUCKETS numbers per
    language, so its size is set by the number of languages alone.
    """
    need_columns(docs, text, lang)
    build = arrow_batches({"lang": pa.string(), "bucket": pa.int32(), "n": pa.int64()})

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for language, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if language not in totals:
                    totals[language] = np.zeros(BUCKETS, np.int64)
                buckets, counts = gram_counts(text)
                totals[language][buckets] += counts
        for language, total in totals.items():
            some = np.flatnonzero(total)
            yield build([language] * len(some), some.astype(np.int32), total[some])

    rows = docs.select(named(lang).cast("string").alias("lang"), named(text).alias("text")).where(
        "lang IS NOT NULL AND text IS NOT NULL"
    ).mapInArrow(count, "lang string, bucket int, n long")
    table = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    found = table.column("lang").to_pylist()
    languages = tuple(sorted(set(found)))
    counts = np.full((BUCKETS, len(languages)), PRIOR)
    place = {language: i for i, language in enumerate(languages)}
    columns = np.array([place[x] for x in found], np.int64)
    counts[table.column("bucket").to_numpy(), columns] += table.column("n").to_numpy()
    return LanguageModel(languages, np.log(counts / counts.sum(axis=0)))


def mixture(log_likelihood: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions that maximise the likelihood of the counted runs (rows), and its logarithm."""
    top = log_likelihood.max(axis=1, keepdims=True)
    likelihood = np.exp(log_likelihood - top)
    total = counts.sum()
    shares = np.full(likelihood.shape[1], 1 / likelihood.shape[1])
    for _ in range(STEPS if len(shares) > 1 else 0):
        weighted = likelihood * shares
        new = (counts / weighted.sum(axis=1)) @ weighted / total
        moved = np.abs(new - shares).max()
        shares = new
        if moved < SETTLED:
            break
    return shares, float(counts @ (np.log(likelihood @ shares) + top[:, 0]))


def languages_of(text: str, model: LanguageModel, penalty: float = 1.0) -> dict[int, float]:
    """The selected languages' proportions.

    Languages come in order of their proportion when all are allowed. The first ones are taken as
    long as the penalised likelihood grows: each language costs ``penalty / 2 * log(runs)``, with runs
    that overlap counted once.
    """
    buckets, counts = gram_counts(text)
    counts = counts / GRAM
    rows = model.log_likelihood[buckets]
    shares, _ = mixture(rows, counts)
    order = np.argsort(-shares, kind="stable")
    cost = penalty / 2 * math.log(max(counts.sum(), 2.0))
    best, chosen = -math.inf, {}
    for size in range(1, len(order) + 1):
        members = order[:size]
        found, value = mixture(rows[:, members], counts)
        if value - cost * size <= best:
            break
        best, chosen = value - cost * size, dict(zip(members.tolist(), found.tolist()))
    return chosen


def identify_languages(
    docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, lang_pred, score, languages`` of every whole text.

    The prediction is the selected language with the largest proportion (the first in order of name where
    two are equal), the score that proportion, ``languages`` all selected ones with theirs. A null
    text, one without a letter, or a model without languages gives ``und``, score 0 and no languages. Rows
    that repeat are judged each on its own; an empty table gives no rows.
    """
    kinds = pa.map_(pa.string(), pa.float64())
    build = arrow_batches({
        "doc_id": pa.int64(), "lang_pred": pa.string(), "score": pa.float64(), "languages": kinds,
    })

    def judge(text):
        chosen = languages_of(text, model) if model.languages and _LETTER.search(text) else {}
        if not chosen:
            return UNKNOWN, 0.0, []
        best = min(chosen, key=lambda i: (-chosen[i], i))
        named = {model.languages[i]: share for i, share in chosen.items()}
        return model.languages[best], min(1.0, chosen[best]), list(named.items())

    def identify(batches):
        for batch in batches:
            found = [judge(x) for x in batch.column("text").to_pylist()]
            yield build(batch.column("key"), *(list(zip(*found)) or [[]] * 3))

    return id_and_text(docs, key, text).mapInArrow(
        identify, "doc_id long, lang_pred string, score double, languages map<string,double>"
    )
