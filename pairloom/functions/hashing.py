"""Repeatable chance: decisions by hash of a row key, the same on every retry and every cluster."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Hex digits that a share is compared by: as many as a double holds.
DIGITS = 13


def key_hash(key: Column | str, seed: int | str) -> Column:
    """32 hex digits drawn from ``seed`` and the row key."""
    column = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), column.cast("string")))


def below_fraction(key: Column | str, fraction: float, seed: int | str) -> Column:
    """True for about ``fraction`` of all keys."""
    if not 0 < fraction < 1:
        raise ValueError(f"fraction must lie between 0 and 1, not {fraction}")
    bound = min(ceil(fraction * 16**DIGITS), 16**DIGITS - 1)
    return F.substring(key_hash(key, seed), 1, DIGITS) < F.lit(f"{bound:0{DIGITS}x}")
