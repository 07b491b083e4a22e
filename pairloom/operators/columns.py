"""Projections: columns dropped, added, renamed, joined up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.checks import named, need_choice, need_columns, reject_nulls
from pairloom.functions.chat_templates import CompiledTemplate
from pairloom.functions.messages import ChatTemplate, render_messages, to_messages
from pairloom.functions.text import TLDR_SUFFIX

MESSAGE_FORMATS = ("plain", "conversational")


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns; an unknown name is an error, not a no-op."""
    need_columns(df, *names)
    return df.drop(*names)


def constant_column(df: DataFrame, name: str, value: Column | str | int | float) -> DataFrame:
    """Write one label, or another column's value, into a whole column."""
    return df.withColumn(name, value if isinstance(value, Column) else F.lit(value))


def select_as(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Keep the named columns only, under new names: ``{old: new}``."""
    need_columns(df, *mapping)
    return df.select(*(named(old).alias(new) for old, new in mapping.items()))


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename columns and keep the others."""
    need_columns(df, *mapping)
    return df.withColumnsRenamed(mapping)


def cat_columns(
    df: DataFrame, lhs: list[str], rhs: list[str], out: list[str], on_null: str = "error"
) -> DataFrame:
    """``out[i] = lhs[i] + rhs[i]`` for text or arrays, pair by pair.

    Pairs run in order: a later pair sees what an earlier one wrote. Surplus list entries are
    ignored.
    """
    for left, right, target in zip(lhs, rhs, out):
        need_columns(df, left, right)
        joined = F.concat(named(left), named(right))
        df = df.withColumn(
            target,
            reject_nulls(joined, [named(left), named(right)], on_null, f"{left} + {right}"),
        )
    return df


def append_suffix(
    df: DataFrame, column: str, suffix: str = TLDR_SUFFIX, on_null: str = "error"
) -> DataFrame:
    """Append a literal to a text column, in place."""
    need_columns(df, column)
    longer = F.concat(named(column), F.lit(suffix))
    return df.withColumn(column, reject_nulls(longer, [named(column)], on_null, column))


def apply_chat_template(
    df: DataFrame,
    columns: list[str],
    template: ChatTemplate | CompiledTemplate,
    fmt: str = "plain",
    add_generation_prompt: bool = False,
    new_columns: list[str] | None = None,
    system_prompt: str | None = None,
    on_null: str = "error",
) -> DataFrame:
    """Write columns through a chat template, in place or into ``new_columns``.

    ``plain`` columns hold text, which becomes the user message (after ``system_prompt`` if
    given). ``conversational`` columns hold message lists, taken as they are; ``system_prompt``
    has no effect on them. ``template`` is one fixed shape of turn, or a model's own template, compiled
    (`pairloom.functions.compile_template`): that may use any text field of the messages.
    """
    need_choice(fmt, MESSAGE_FORMATS, "fmt")
    for name, target in zip(columns, new_columns or columns):
        need_columns(df, name)
        messages = to_messages(name, system_prompt) if fmt == "plain" else named(name)
        if isinstance(template, CompiledTemplate):
            fields = ["role", "content"] if fmt == "plain" else df.schema[name].dataType.elementType.names
            written = template.render(messages, add_generation_prompt, fields)
        else:
            written = render_messages(messages, template, add_generation_prompt)
        if on_null == "error":
            written = F.coalesce(
                written, F.raise_error(F.lit(f"null message in {name}")).cast("string")
            )
        df = df.withColumn(target, written)
    return df
