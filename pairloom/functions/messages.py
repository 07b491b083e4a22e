"""Column functions on message lists: arrays of ``struct<role, content>``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """How a model wants a message list written out as one text."""

    bos: str = ""
    role_open: str = ""
    role_close: str = ""
    end: str = ""
    generation_prompt: str = ""


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def to_messages(column: Column | str, system: str | None = None) -> Column:
    """One user message holding the text, after a system message if ``system`` is given."""
    text = F.col(column) if isinstance(column, str) else column
    user = message("user", text)
    return F.array(user) if system is None else F.array(message("system", F.lit(system)), user)


def render_messages(
    messages: Column | str, template: ChatTemplate, add_generation_prompt: bool = False
) -> Column:
    """A message list as one text. Null if the list or any role or content is null."""
    turns = F.col(messages) if isinstance(messages, str) else messages
    written = F.transform(
        turns,
        lambda m: F.concat(
            F.lit(template.role_open), m["role"], F.lit(template.role_close),
            m["content"], F.lit(template.end),
        ),
    )
    # array_join skips nulls, which would lose a turn in silence.
    broken = F.exists(turns, lambda m: m["role"].isNull() | m["content"].isNull())
    body = F.when(~broken, F.array_join(written, ""))
    tail = template.generation_prompt if add_generation_prompt else ""
    return F.concat(F.lit(template.bos), body, F.lit(tail))
