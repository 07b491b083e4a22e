"""The published data sets, each as one plan from input table to output table.

Every recipe takes a table with ``split`` (and ``config``, where a data set has subsets) as
columns, covers all subsets in one job, and leaves writing to
:func:`pairloom.sources.publish`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.messages import ChatTemplate
from pairloom.functions.text import path_label_of
from pairloom.operators.columns import (
    append_suffix,
    apply_chat_template,
    cat_columns,
    drop_columns,
    rename_columns,
    select_as,
)
from pairloom.operators.feeds import training_view
from pairloom.operators.filters import drop_values, keep_equal, keep_values
from pairloom.operators.generation import (
    MakeFn,
    candidate_pairs,
    comparison_table,
    map_generate,
    map_judge,
)
from pairloom.operators.keys import fan_out, with_key
from pairloom.operators.preference import (
    PreferenceBuild,
    build_preference,
    build_reward_pairs,
    choose_best,
)
from pairloom.operators.rows import hash_split, head_per_group, head_rows, slice_rows
from pairloom.operators.sweeps import method_names, sweep_curves
from pairloom.operators.tables import concat_tables, fold_splits
from pairloom.operators.tokens import limit_length

# Sizes, ranges and names of the published data sets.
SFT_TRAIN_ROWS = 16722
SFT_VALIDATION_ROWS = 2000
PPO_TRAIN_RANGE = (16722, 116722)
COMPARISON_ROWS = 100
HUMAN_COMPARISON_ROWS = 1000
VALIDATION_FRACTION = 0.1
PAIRED_ROWS = {"train": 10000, "validation": 1000}
ARTICLE_LANGUAGES = (
    "it", "ko", "es", "tr", "nl", "vi", "hi", "fr", "th", "en", "de", "ar", "pt", "ru", "ja",
    "cs", "zh", "id",
)
SUMMARY_LANGUAGES = ("en", "ru", "de", "fr", "es", "it", "nl")
SFT_FEED = {"train": 16722, "validation": 1500}
REWARD_FEED = {"train": 92858, "validation": 2000}
MULTILINGUAL_REWARD_FEED = {"train": 70000, "validation": 2000}
SFT_TOKENS = REWARD_TOKENS = 1024
MULTILINGUAL_REWARD_TOKENS = 2048
SHOWN_METHODS = ("1.0", "0.6", "0.2")
LEFT_OUT_KL = (0.1, 0.3, 1.0)
UNTRIMMED_METHOD = "0.2"
FEDERATED = "FedAvg"
METHOD_LABELS = {"FedAvg": "FedAvg", "1.0": "Isolated", "0.6": "PR 0.6", "0.2": "PR 0.2"}

# Our own wording; pass another to ask a model differently.
SUMMARY_SYSTEM_PROMPT = "Summarise the text you are given in a few sentences. Write nothing else."
JUDGE_TEMPLATE = (
    "Two summaries of a text follow. Decide which one a reader would prefer.\n\n"
    "Text:\n{text}\n\nSummary 0:\n{response0}\n\nSummary 1:\n{response1}\n\n"
    "End your answer with the number of the better summary, 0 or 1."
)


def instruction_splits(df: DataFrame, key: str, seed: int | str = 0) -> DataFrame:
    """One table cut into train and validation, a tenth of the rows to validation."""
    return hash_split(df, key, VALIDATION_FRACTION, seed, exact=True)


def sft_rows(
    df: DataFrame,
    order_by: Sequence[str],
    train: int = SFT_TRAIN_ROWS,
    validation: int = SFT_VALIDATION_ROWS,
) -> DataFrame:
    """The first rows of train and validation, and the whole of test."""
    return training_view(
        df, {"train": train, "validation": validation, "test": None}, order_by
    )


def ppo_rows(
    df: DataFrame, order_by: Sequence[str], train: tuple[int, int] = PPO_TRAIN_RANGE
) -> DataFrame:
    """The train rows after those used for fine-tuning; validation and test whole."""
    part = slice_rows(keep_equal(df, "split", "train"), *train, order_by)
    return concat_tables(part, keep_values(df, "split", ["validation", "test"]))


def sft_feed(
    df: DataFrame,
    order_by: Sequence[str],
    id_columns: Sequence[str] = (),
    caps: dict[str, int | None] = SFT_FEED,
    tokens: int = SFT_TOKENS,
    encode: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """The rows a fine-tuning trainer is given; longer id lists are cut.

    ``encode`` adds the id columns, to the chosen rows only.
    """
    rows = encode(training_view(df, caps, order_by))
    return limit_length(rows, list(id_columns), tokens, "truncate")


def reward_feed(
    df: DataFrame,
    order_by: Sequence[str],
    id_columns: Sequence[str] = (),
    caps: dict[str, int | None] = REWARD_FEED,
    tokens: int = REWARD_TOKENS,
    encode: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """The pairs a reward trainer is given; a pair with a longer id list is dropped."""
    rows = encode(training_view(df, caps, order_by))
    return limit_length(rows, list(id_columns), tokens, "drop")


def multilingual_reward_feed(
    df: DataFrame,
    order_by: Sequence[str],
    id_columns: Sequence[str] = (),
    encode: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """:func:`reward_feed` with the row caps and the length of the multilingual set."""
    return reward_feed(
        df, order_by, id_columns, MULTILINGUAL_REWARD_FEED, MULTILINGUAL_REWARD_TOKENS, encode
    )


def prompted_pairs(df: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Prompt in front of both the chosen and the rejected answer."""
    return cat_columns(df, [prompt, prompt], ["chosen", "rejected"], ["chosen", "rejected"])


def topic_subsets(df: DataFrame, prompt: str = "prompt") -> DataFrame:
    """One config per topic named in the prompts; test rows join validation."""
    folded = fold_splits(with_key(df, prompt, "topic"), {"test": "validation"})
    return fan_out(folded, "topic").drop("topic")


def model_comparison(
    df: DataFrame,
    order_by: Sequence[str],
    models: dict[str, MakeFn],
    rows: int = COMPARISON_ROWS,
    prompt: str = "prompt",
) -> DataFrame:
    """The first test prompts with the answer of each model, columns named by model path."""
    first = head_rows(keep_equal(df, "split", "test"), rows, order_by)
    return comparison_table(
        first, prompt, {path_label_of(path): make_fn for path, make_fn in models.items()}
    )


def human_comparison(
    df: DataFrame,
    order_by: Sequence[str],
    model_path: str,
    make_fn: MakeFn,
    rows: int = HUMAN_COMPARISON_ROWS,
) -> DataFrame:
    """The first test prompts with the human text (prompt + completion) and a model's."""
    first = head_rows(keep_equal(df, "split", "test"), rows, order_by)
    human = drop_columns(cat_columns(first, ["prompt"], ["completion"], ["human"]), "completion")
    return map_generate(human, "prompt", path_label_of(model_path), make_fn, batch_size=32)


def chat_prompts(df: DataFrame, template: ChatTemplate, prompt: str = "prompt") -> DataFrame:
    """Prompts written as a model expects them, ready for its answer."""
    slim = drop_columns(df, "prompt_id", "messages")
    return apply_chat_template(slim, [prompt], template, add_generation_prompt=True)


def article_subsets(
    df: DataFrame, languages: Sequence[str] = ARTICLE_LANGUAGES
) -> DataFrame:
    """Articles and summaries of the wanted languages, one config each."""
    kept = keep_values(df, "config", list(languages))
    return drop_columns(kept, "source_language", "target_language", "references")


def article_prompts(
    df: DataFrame, languages: Sequence[str] = SUMMARY_LANGUAGES
) -> DataFrame:
    """Articles that ask for a summary, beside the summary."""
    asked = append_suffix(keep_values(df, "config", list(languages)), "source")
    return select_as(
        asked, {"config": "config", "split": "split", "source": "text", "target": "summary"}
    )


def paired_summaries(
    df: DataFrame,
    order_by: Sequence[str],
    make_a: MakeFn,
    make_b: MakeFn,
    languages: Sequence[str] = SUMMARY_LANGUAGES,
    rows: dict[str, int] | None = None,
    text: str = "source",
    system: str = SUMMARY_SYSTEM_PROMPT,
) -> DataFrame:
    """Two model summaries for the first articles of every config and split."""
    rows = PAIRED_ROWS if rows is None else rows
    wanted = keep_values(keep_values(df, "config", list(languages)), "split", list(rows))
    cap = F.lit(0)
    for split, n in rows.items():
        cap = F.when(F.col("split") == split, F.lit(n)).otherwise(cap)
    first = head_per_group(wanted, ["config", "split"], cap, order_by)
    slim = first.select("config", "split", *order_by, F.col(text).alias("text"))
    return candidate_pairs(slim, "text", make_a, make_b, chat=True, system=system)


def judged_summaries(
    df: DataFrame,
    key: str,
    make_judge: MakeFn,
    template: str = JUDGE_TEMPLATE,
    seed: int | str = 0,
    on_invalid: str = "error",
    languages: Sequence[str] = SUMMARY_LANGUAGES,
    chat: bool = False,
    system: str | None = None,
) -> PreferenceBuild:
    """Paired summaries judged by a model: preference table and win rate per config and split."""
    wanted = keep_values(df, "config", list(languages))
    return build_preference(
        wanted, lambda pairs: map_judge(pairs, template, make_judge, chat=chat, system=system), key,
        seed=seed, on_invalid=on_invalid,
    )


def summary_rewards(df: DataFrame) -> DataFrame:
    """Judged summaries of all languages as reward-model texts in one table."""
    return build_reward_pairs(df)


def best_responses(df: DataFrame, domain: str) -> DataFrame:
    """Rated responses of one domain, one config per language, with the better response."""
    return choose_best(fan_out(keep_equal(df, "domain", domain), "language"))


def single_sweep(
    df: DataFrame,
    kl: str = "advantage_reward_kl_coeff",
    value: str = "winrate",
    method: str = "reference_protocol_weightage_self_preference",
    interval: str = "reference_update_every_n_steps",
    left_out_kl: Sequence[float] = (),
    keep: Sequence[str] | None = SHOWN_METHODS,
    full: str | None = None,
) -> DataFrame:
    """The curves of one sweep, a method per self-preference value."""
    if left_out_kl:
        df = drop_values(df, kl, list(left_out_kl))
    named = rename_columns(df, {method: "method"})
    return sweep_curves(named, "method", [kl, "method", interval], value, keep=keep, full=full)


def sweep_with_federated(
    df: DataFrame,
    federated: DataFrame,
    kl: str = "advantage_reward_kl_coeff",
    value: str = "winrate",
    method: str = "reference_protocol_weightage_self_preference",
    interval: str = "reference_update_every_n_steps",
    keep: Sequence[str] | None = (*SHOWN_METHODS, FEDERATED),
) -> DataFrame:
    """A sweep beside a second one, all runs of which count as one federated method."""
    own = rename_columns(method_names(df, method), {method: "method"})
    other = rename_columns(federated, {"global_winrate": value, "self_preference": "method"})
    both = concat_tables(own, other.withColumn("method", F.lit(FEDERATED)), allow_missing=True)
    return sweep_curves(
        both, "method", [kl, "method", interval], value, keep=keep, legend=METHOD_LABELS
    )
