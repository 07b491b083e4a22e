"""From raw documents to packed training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.checks import named
from pairloom.llm import compression, near_dups, outliers, packing, passages
from pairloom.llm.common import read_table
from pairloom.llm.queries import quality_model
from pairloom.storage import materialize


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` but for the ids in ``rejected (doc_id)``; rows with a null id stay."""
    return docs.join(materialize(rejected.select("doc_id"), "rejected"), "doc_id", "left_anti").select(
        *map(named, docs.columns)
    )


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the compression classifier scores 0.3 or more."""
    scored = compression.score_quality(docs, quality_model(spark, docs, sf_dir))
    return _without(docs, scored.where("score < 0.3"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what passes the base rules and is no outlier of its language and source."""
    return _without(docs, outliers.quality_rules(docs).where("NOT kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each group, and of rows with one id the least."""
    found = materialize(near_dups.near_duplicates(docs), "groups").where("doc_id IS NOT NULL")
    repeated = found.where("kept AND n_rows > 1").select("doc_id")
    once = _without(docs, found.where("NOT kept").select("doc_id").unionByName(repeated))
    rest = [named(name) for name in docs.columns if name != "doc_id"]
    least = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.min(F.struct(*rest)).alias("row")
    ).select("doc_id", "row.*").select(*map(named, docs.columns))
    return once.unionByName(least)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that an earlier document has; ``n_chars`` follows the text."""
    found = passages.repeated_passages(docs)
    return passages.remove_passages(docs, found).withColumn(
        "n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)
    )


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack token ids into sequences of 1024."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", cut_passages),
    ("packing", pack),
]

#: SQL can express neither the compression model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
