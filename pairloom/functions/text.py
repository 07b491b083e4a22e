"""Column functions on text."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.checks import named, need_choice, reject_nulls

# They must equal the published data sets' formats.
TLDR_SUFFIX = "\n\nTL;DR: "
TOPIC_PATTERN = r"^SUBREDDIT:\s*r/(\w+)"
VALID_VERDICTS = ("0", "1")
INVALID_RANK = -1
# The blanks at the end of an answer that do not count: those of Python's str.strip.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

MISSING_POLICIES = ("error", "drop", "null")


def extract_key(
    column: Column | str, pattern: str = TOPIC_PATTERN, group: int = 1, on_missing: str = "error"
) -> Column:
    """The captured group of the first match of ``pattern``.

    ``on_missing`` decides about text without a match: fail the job, or give null. (``"drop"``
    gives null too; :func:`pairloom.operators.keys.with_key` removes those rows.)
    """
    need_choice(on_missing, MISSING_POLICIES, "on_missing")
    text = F.col(column) if isinstance(column, str) else column
    # (?U) makes \w and \s cover letters and blanks beyond ASCII.
    key = F.nullif(F.regexp_extract(text, "(?U)" + pattern, group), F.lit(""))
    if on_missing != "error":
        return key
    refuse = F.raise_error(F.lit(f"no key found by {pattern}")).cast("string")
    # The last branch is never reached. It marks the key as never null, so that a join on it does
    # not run the pattern a second time in a null filter.
    return F.coalesce(key, refuse, F.lit(""))


def path_label(column: Column | str) -> Column:
    """The part of a path after its first slash and before the next."""
    path = F.col(column) if isinstance(column, str) else column
    return F.split_part(path, F.lit("/"), F.lit(2))


def path_label_of(path: str) -> str:
    """:func:`path_label` for a plain string, to name a result column."""
    return path.split("/")[1]


def render_template(template: str, on_null: str = "error", **slots: Column | str) -> Column:
    """Fill the named slots of ``template``; doubled braces stand for single ones.

    The template is cut up once, on the driver, so braces inside a slot's text stay as they are.
    """
    columns = {
        name: named(slot) if isinstance(slot, str) else slot for name, slot in slots.items()
    }
    parts: list[Column] = []
    for literal, name, spec, conversion in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is None:
            continue
        if name not in columns or spec or conversion:
            raise ValueError(f"template slot {name!r} has no column, or carries a format")
        parts.append(columns[name])
    if not columns:
        return F.concat(*parts) if parts else F.lit("")
    rendered = F.concat(*parts)
    return reject_nulls(rendered, list(columns.values()), on_null, "template slot")


def parse_verdict(column: Column | str) -> Column:
    """The rank a judge's answer ends with: 0, 1, or -1 when it ends with anything else."""
    answer = F.col(column) if isinstance(column, str) else column
    # Both look at the end of the text only; a pattern would walk through all of it.
    last = F.right(F.rtrim(answer, F.lit(BLANKS)), F.lit(1))
    return F.when(last.isin(*VALID_VERDICTS), last.try_cast("int")).otherwise(F.lit(INVALID_RANK))
