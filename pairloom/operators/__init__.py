"""Operators: functions from DataFrame to DataFrame."""

from pairloom.operators.answers import AnswerStore
from pairloom.operators.columns import (
    append_suffix,
    apply_chat_template,
    cat_columns,
    constant_column,
    drop_columns,
    rename_columns,
    select_as,
)
from pairloom.operators.feeds import training_view
from pairloom.operators.filters import drop_values, keep_equal, keep_values, single_vs_rest
from pairloom.operators.generation import (
    candidate_pairs,
    comparison_table,
    map_generate,
    map_generate_many,
    map_judge,
)
from pairloom.operators.keys import distinct_keys, fan_out, keep_key, with_key
from pairloom.operators.preference import (
    PreferenceBuild,
    build_preference,
    build_reward_pairs,
    choose_best,
    flip_pairs,
    judge_pairs,
    rule_judge,
    to_preference,
    unflip_rank,
)
from pairloom.operators.reward import PairwiseReward, fit_pairwise_reward, word_differences
from pairloom.operators.rows import (
    assign_batches,
    attach_by_position,
    hash_split,
    head_per_group,
    head_rows,
    slice_rows,
    trim_curve,
    with_row_index,
)
from pairloom.operators.sweeps import (
    expected_max,
    legend_names,
    mean_by,
    order_methods, rank_methods,
    sweep_curves,
    value_range,
    win_rate,
    with_band,
)
from pairloom.operators.tables import bundle_splits, concat_tables, fold_splits
from pairloom.operators.tokens import (
    build_vocab,
    encode_tokens,
    limit_length,
    tokenize_with,
    with_special_ids,
)

__all__ = [
    "AnswerStore",
    "PairwiseReward", "PreferenceBuild", "append_suffix", "apply_chat_template", "assign_batches",
    "attach_by_position", "build_preference", "build_reward_pairs", "build_vocab",
    "bundle_splits", "candidate_pairs", "cat_columns", "choose_best", "comparison_table",
    "concat_tables", "constant_column", "distinct_keys", "drop_columns", "drop_values",
    "encode_tokens", "expected_max", "fan_out", "fit_pairwise_reward", "flip_pairs",
    "fold_splits", "hash_split", "head_per_group", "head_rows", "judge_pairs", "keep_equal",
    "keep_values", "legend_names", "limit_length", "map_generate", "map_generate_many",
    "map_judge", "mean_by", "order_methods", "rename_columns", "rule_judge", "select_as",
    "single_vs_rest", "slice_rows", "sweep_curves", "to_preference", "tokenize_with",
    "training_view", "trim_curve", "unflip_rank", "value_range", "win_rate", "with_band", "word_differences",
    "keep_key", "rank_methods", "with_key", "with_row_index", "with_special_ids",
]
