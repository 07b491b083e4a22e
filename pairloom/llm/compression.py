"""Quality classifier from compressed sizes under two dictionaries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.checks import named, need_columns
from pairloom.llm.common import arrow_batches, id_and_text
from pairloom.storage import materialize

#: Bytes that are compressed at a time: a dictionary helps at the start of a frame only.
PIECE = 4096
#: Largest dictionary, and bytes added to a text's size so that a few words settle little.
DICTIONARY_BYTES, SMOOTHING = 112_640, 64
LEVEL = 3
#: Bounds of the sample that is fitted on: labelled documents per class for the dictionaries and for the
#: calibration, and pieces of text per class that a dictionary is built from.
DICTIONARY_DOCS, CALIBRATION_DOCS, DICTIONARY_PIECES = 1500, 4000, 1000
#: Size differences near 0 decide; this is the width of "near".
WIDTH = 0.02


@dataclass(frozen=True)
class CompressionModel:
    """A dictionary per class (0, 1) and the calibration ``1 / (1 + exp(-(slope * x + offset)))``."""

    dictionaries: tuple[bytes, bytes]
    slope: float
    offset: float

    def score(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * squash(difference) + self.offset)))


def squash(difference: np.ndarray) -> np.ndarray:
    return difference / (np.abs(difference) + WIDTH)


def pieces(text: str) -> Iterator[bytes]:
    """The whole text, ``PIECE`` bytes at a time."""
    data = memoryview(text.encode())
    for start in range(0, len(data), PIECE):
        yield data[start : start + PIECE]


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little text to train on, the text itself."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


class SizeDifference:
    """(size under the bad dictionary - size under the good one) / size of the text."""

    def __init__(self, dictionaries: tuple[bytes, bytes]):
        self.compressors = []
        for data in dictionaries:
            dictionary = zstandard.ZstdCompressionDict(data) if data else None
            if dictionary:
                dictionary.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=dictionary, write_content_size=False, write_dict_id=False,
            ))

    def __call__(self, text: str) -> float:
        bad, good = (sum(len(c.compress(x)) for x in pieces(text)) for c in self.compressors)
        return (bad - good) / (len(text.encode()) + SMOOTHING)


def _differences(texts: DataFrame, dictionaries: tuple[bytes, bytes], schema: str) -> DataFrame:
    """``schema`` names the columns to keep, all longs, and ends in ``difference double``."""
    kept = [part.split()[0] for part in schema.split(", ")[:-1]]
    build = arrow_batches(dict.fromkeys(kept, pa.int64()) | {"difference": pa.float64()})

    def measure(batches):
        difference = SizeDifference(dictionaries)
        for batch in batches:
            values = [difference(text) for text in batch.column("text").to_pylist()]
            yield build(*(batch.column(name) for name in kept), values)

    return texts.select(*kept, "text").mapInArrow(measure, schema)


def _first(rows: DataFrame, count: int, *order: str) -> DataFrame:
    return rows.orderBy(*order).limit(count)


def sample_labelled(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str,
    dictionary_docs: int = DICTIONARY_DOCS, calibration_docs: int = CALIBRATION_DOCS,
) -> DataFrame:
    """``key, quality, part, text`` of a bounded number of labelled documents, the first by hash.

    Part 0 is for the dictionaries, part 1 for the calibration; the hash of the id decides. Only their
    ids are broadcast, at most ``2 * (dictionary_docs + calibration_docs)``.
    """
    need_columns(labels, key, label)
    rows = labels.select(
        named(key).cast("long").alias("key"), named(label).cast("long").alias("quality")
    ).where("key IS NOT NULL AND quality IN (0, 1)").distinct()
    rows = rows.withColumn("order", F.xxhash64("key")).withColumn("part", F.pmod("order", F.lit(2)))
    chosen = [
        _first(rows.where((F.col("quality") == quality) & (F.col("part") == part)), count, "order", "key")
        for quality in (0, 1) for part, count in ((0, dictionary_docs), (1, calibration_docs))
    ]
    chosen = reduce(DataFrame.unionByName, chosen).select("key", "quality", "part")
    return id_and_text(docs, key, text).join(F.broadcast(chosen), "key")


def fit_compression(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
    label: str = "quality", **bounds: int,
) -> CompressionModel:
    """Fit on a bounded sample of the labelled rows; see `sample_labelled` for the bounds.

    Dictionaries are built from pieces of the first part's texts, the calibration is logistic, on the
    counts per class and binned difference in the second part. Without labels of one class its dictionary
    is empty; without any calibration rows the score is 1/2 at no difference.
    """
    sample = materialize(sample_labelled(docs, labels, key, text, label, **bounds), "labelled")
    build = arrow_batches({"quality": pa.int64(), "order": pa.int64(), "piece": pa.binary()})

    def cut(batches):
        for batch in batches:
            names = ("key", "quality", "text")
            rows = [
                # a mixed order: pieces of one long text are spread among the others'
                (quality, (doc * 1_000_003 + at) * 0x9E3779B97F4A7C15 % (1 << 63), bytes(piece))
                for doc, quality, text in zip(*(batch.column(n).to_pylist() for n in names))
                for at, piece in enumerate(pieces(text))
            ]
            yield build(*(list(zip(*rows)) or [[]] * 3))

    parts = sample.where("part = 0").mapInArrow(cut, "quality long, order long, piece binary")
    dictionaries = tuple(
        build_dictionary([
            bytes(row.piece) for row in
            _first(parts.where(F.col("quality") == quality), DICTIONARY_PIECES, "order", "piece").collect()
        ])
        for quality in (0, 1)
    )
    measured = _differences(
        sample.where("part = 1"), dictionaries, "quality long, difference double"
    )
    counts = measured.groupBy(
        F.round(F.col("difference") * 10_000).alias("bin"), "quality"
    ).count().orderBy("bin", "quality").collect()
    slope, offset = _logistic(
        squash(np.array([row["bin"] / 10_000 for row in counts])),
        np.array([row["quality"] for row in counts], float),
        np.array([row["count"] for row in counts], float),
    )
    return CompressionModel(dictionaries, slope, offset)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope, at least 0, and offset by Newton's method, with a small penalty that keeps them finite."""
    beta = np.zeros(2)
    if not len(x):
        return 1.0, 0.0
    rows = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-rows @ beta))
        gradient = rows.T @ (weight * (y - p)) - 1e-3 * beta
        hessian = (rows * (weight * p * (1 - p))[:, None]).T @ rows + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return max(float(beta[0]), 0.0), float(beta[1])


def score_quality(
    docs: DataFrame, model: CompressionModel, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, score`` of every whole text: the calibrated chance of label 1.

    A null or empty text has no size difference and the score of that; rows that repeat are scored each
    on its own, null ids are kept, an empty table gives no rows.
    """
    measured = _differences(
        id_and_text(docs, key, text), model.dictionaries, "key long, difference double"
    )
    x = F.col("difference") / (F.abs("difference") + WIDTH)
    score = 1 / (1 + F.exp(-(model.slope * x + model.offset)))
    return measured.select(F.col("key").alias("doc_id"), score.alias("score"))
