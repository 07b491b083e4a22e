"""Answers that are kept: a model is asked each prompt once, over all runs.

An `AnswerStore` is a folder of Parquet files, one subfolder per model and its settings, with the SHA-256 of each
prompt and the answer to it. Before a call, prompts whose answer is there are left out by an anti-join; equal
prompts of a table are asked once. New answers are appended part by part, so that a run that dies keeps all parts that
were finished: the next run goes on from there. What is lost is one part, whatever the table's size.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from hashlib import sha256
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.checks import fresh, named
from pairloom.storage import materialize

_SCHEMA = "prompt_hash string, answer string, about string"


@dataclass(frozen=True)
class AnswerStore:
    """Where answers are kept.

    ``settings`` names, for each column of answers, all that an answer hangs on: the model and its version,
    how it samples, how long an answer may be. Whether prompts are sent as chats, and after which system message, is added.
    ``parts`` is how many parts the new prompts of a call are cut into.
    """

    root: str
    settings: Mapping[str, Mapping[str, Any]]
    parts: int = 16

    def about(self, name: str, chat: bool, system: str | None) -> str:
        if name not in self.settings:
            raise ValueError(f"the store has no settings for {name!r}; it has {sorted(self.settings)}")
        return json.dumps(
            {"settings": self.settings[name], "chat": chat, "system": system}, sort_keys=True, default=str
        )

    def path(self, about: str) -> str:
        return f"{self.root.rstrip('/')}/settings={sha256(about.encode()).hexdigest()[:32]}"

    def read(self, spark: SparkSession, about: str) -> DataFrame:
        """``prompt_hash, answer``: one row per prompt, also where two runs have asked it at the same time."""
        try:
            found = spark.read.schema(_SCHEMA).parquet(self.path(about))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], "prompt_hash string, answer string")
        return found.groupBy("prompt_hash").agg(F.min("answer").alias("answer"))

    def append(self, answers: DataFrame, about: str) -> None:
        """Add ``prompt_hash, answer``."""
        rows = answers.select("prompt_hash", "answer", F.lit(about).alias("about"))
        rows.write.mode("append").parquet(self.path(about))


def answer_once(
    df: DataFrame,
    text: Column,
    names: Sequence[str],
    ask: Callable[[DataFrame, Sequence[str]], DataFrame],
    store: AnswerStore,
    chat: bool,
    system: str | None,
) -> DataFrame:
    """``df`` with a column of answers per name, from the store, which is filled up first.

    ``ask(prompts, names)`` adds the named columns of answers to ``prompts (…, prompt)``. Prompts that lack the
    answers of several names are asked for all of these in one pass. A null prompt has null answers.
    """
    if store.parts < 1:
        raise ValueError("parts must be positive")
    spark = df.sparkSession
    about = {name: store.about(name, chat, system) for name in names}
    key = fresh(df, "_prompt_hash")
    keyed = df.withColumn(key, F.sha2(text, 256))
    wanted = df.select(F.sha2(text, 256).alias("prompt_hash"), text.alias("prompt")).where(
        "prompt IS NOT NULL"
    ).groupBy("prompt_hash").agg(F.first("prompt").alias("prompt"))
    lacking = F.lit(0)
    for bit, name in enumerate(names):
        there = store.read(spark, about[name]).select("prompt_hash", F.lit(True).alias(f"_has_{bit}"))
        wanted = wanted.join(there, "prompt_hash", "left")
        lacking = lacking + F.when(F.col(f"_has_{bit}").isNull(), 1 << bit).otherwise(0)
    asked = wanted.select("prompt_hash", "prompt", lacking.alias("lacks")).where("lacks > 0").withColumn(
        "part", F.pmod(F.xxhash64("prompt_hash"), F.lit(store.parts)).cast("int")
    )
    asked = materialize(asked, "prompts", by=("lacks", "part"))
    for lacks, part in sorted(map(tuple, asked.select("lacks", "part").distinct().collect())):
        own = [name for bit, name in enumerate(names) if lacks >> bit & 1]
        rows = asked.where((F.col("lacks") == lacks) & (F.col("part") == part)).select("prompt_hash", "prompt")
        answered = ask(rows, own)
        if len(own) > 1:  # one pass over the model, whose answers go to several folders
            answered = materialize(answered, "answers")
        for name in own:
            store.append(answered.select("prompt_hash", named(name).alias("answer")), about[name])
    out = keyed
    for name in names:
        answers = store.read(spark, about[name]).select(
            F.col("prompt_hash").alias(key), F.col("answer").alias(fresh(df, f"_{name}"))
        )
        out = out.join(answers, key, "left")
    return out.select(
        *(named(column) for column in df.columns if column not in names),
        *(named(fresh(df, f"_{name}")).alias(name) for name in names),
    )
