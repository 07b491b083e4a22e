"""Preference data: verdicts freed of position bias, and what is built from them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.checks import named, need_choice, need_columns, reject_nulls
from pairloom.functions.hashing import key_hash
from pairloom.functions.text import INVALID_RANK, TLDR_SUFFIX
from pairloom.operators.columns import append_suffix, cat_columns
from pairloom.operators.sweeps import win_rate
from pairloom.storage import materialize

INVALID_POLICIES = ("error", "drop", "quarantine")

#: A judge reads ``text``, ``response0``, ``response1`` and adds ``rank``.
Judge = Callable[[DataFrame], DataFrame]


def choose_best(
    df: DataFrame,
    pref: str = "overall_preference",
    r1: str = "response1",
    r2: str = "response2",
    out: str = "best_response",
    on_null: str = "error",
) -> DataFrame:
    """The second response where the preference is positive, else the first; ties go to it."""
    need_columns(df, pref, r1, r2)
    best = F.when(F.col(pref) <= 0, F.col(r1)).when(F.col(pref) > 0, F.col(r2))
    return df.withColumn(out, reject_nulls(best, [F.col(pref)], on_null, pref))


def flip_mask(key: Column | str, seed: int | str = 0) -> Column:
    """True for half of all row keys."""
    return F.substring(key_hash(key, seed), 1, 1) < F.lit("8")


def flip_pairs(
    df: DataFrame,
    key: str,
    a: str = "completion_a",
    b: str = "completion_b",
    seed: int | str = 0,
    shuffle_order: bool = True,
    on_null: str = "error",
) -> DataFrame:
    """Add ``flip`` and the two completions in the order the judge gets to see.

    A row without a key fails the job: left in place it would be judged with the position's bias.
    """
    need_columns(df, key, a, b)
    flip = F.col("flip")
    chance = reject_nulls(flip_mask(named(key), seed), [named(key)], on_null, key)
    return df.withColumn("flip", chance if shuffle_order else F.lit(False)).withColumns({
        "response0": F.when(flip, F.col(b)).otherwise(F.col(a)),
        "response1": F.when(flip, F.col(a)).otherwise(F.col(b)),
    })


def unflip_rank(rank: Column | str, flip: Column | str) -> Column:
    """The verdict in terms of the original order. An invalid verdict stays invalid."""
    verdict = F.col(rank) if isinstance(rank, str) else rank
    flipped = F.col(flip) if isinstance(flip, str) else flip
    return F.when(verdict.isin(0, 1) & flipped, 1 - verdict).otherwise(verdict)


def judge_pairs(
    df: DataFrame,
    judge: Judge,
    key: str,
    a: str = "completion_a",
    b: str = "completion_b",
    seed: int | str = 0,
    shuffle_order: bool = True,
) -> DataFrame:
    """Add ``rank``: 0 or 1 for the better completion, -1 if the judge decided on neither."""
    judged = judge(flip_pairs(df, key, a, b, seed, shuffle_order))
    need_columns(judged, "rank")
    return judged.withColumn("rank", unflip_rank("rank", "flip")).drop(
        "flip", "response0", "response1"
    )


def rule_judge(rule: Column) -> Judge:
    """A judge that applies an expression on ``response0`` and ``response1``."""
    return lambda df: df.withColumn("rank", rule)


def to_preference(
    df: DataFrame,
    rank: str = "rank",
    a: str = "completion_a",
    b: str = "completion_b",
    on_invalid: str = "error",
) -> tuple[DataFrame, DataFrame | None]:
    """Add ``chosen`` and ``rejected``.

    A rank other than 0 and 1 fails the job (``error``), is left out (``drop``), or goes to a
    second table, unchanged (``quarantine``); the second result is null otherwise.
    """
    need_choice(on_invalid, INVALID_POLICIES, "on_invalid")
    need_columns(df, rank, a, b)
    verdict = F.col(rank)
    valid = F.coalesce(verdict.isin(0, 1), F.lit(False))
    invalid = df.where(~valid) if on_invalid == "quarantine" else None
    if on_invalid != "error":
        df = df.where(valid)
    refuse = F.raise_error(F.lit("the judge chose neither completion"))
    table = df.withColumns({
        "chosen": F.when(verdict == 0, F.col(a)).when(verdict == 1, F.col(b)).otherwise(refuse),
        "rejected": F.when(verdict == 0, F.col(b)).when(verdict == 1, F.col(a)).otherwise(refuse),
    })
    return table, invalid


@dataclass(frozen=True)
class PreferenceBuild:
    """A preference table, its win rates, and the pairs without a verdict (if set aside)."""

    table: DataFrame
    win_rates: DataFrame
    invalid: DataFrame | None


def build_preference(
    df: DataFrame,
    judge: Judge,
    key: str,
    text: str = "text",
    a: str = "summary_a",
    b: str = "summary_b",
    by: tuple[str, ...] = ("config", "split"),
    seed: int | str = 0,
    on_invalid: str = "error",
) -> PreferenceBuild:
    """Judge every pair once and make the preference table of it.

    The verdicts are written out before use: table, win rates and invalid pairs share them, and a
    model is not asked again.
    """
    need_columns(df, key, text, a, b, *by)
    pairs = df.select(
        *by, key, F.col(text).alias("text"),
        F.col(a).alias("completion_a"), F.col(b).alias("completion_b"),
    )
    judged = materialize(judge_pairs(pairs, judge, key, seed=seed), "verdicts")
    table, invalid = to_preference(judged, on_invalid=on_invalid)
    table = table.select(
        *by, key, "text", "completion_a", "completion_b", "chosen", "rejected", "rank"
    )
    return PreferenceBuild(table, win_rate(judged, "rank", by), invalid)


def build_reward_pairs(
    df: DataFrame,
    text: str = "text",
    config: str = "config",
    language: str = "language",
    suffix: str = TLDR_SUFFIX,
) -> DataFrame:
    """Texts for a reward model: text + suffix + chosen, text + suffix + rejected.

    All configs stay in one table; ``language`` names the config a row came from.
    """
    need_columns(df, text, config, "chosen", "rejected")
    labelled = append_suffix(df.withColumn(language, F.col(config)), text, suffix)
    return cat_columns(labelled, [text, text], ["chosen", "rejected"], ["chosen", "rejected"])
