"""What a trainer is given."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame

from pairloom.checks import named, need_columns
from pairloom.operators.rows import before, in_stored_order, key_ranges


def training_view(
    df: DataFrame,
    caps: dict[str, int | None],
    order_by: Sequence[str] | None,
    split: str = "split",
    strict: bool = True,
) -> DataFrame:
    """The first rows of each named split, up to its cap (``None``: all of them).

    Rows are counted along ``order_by``, or as they are stored (None).

    Splits without a cap entry are left out. A split shorter than its cap is an error, or with
    ``strict=False`` kept whole. One filter on the table serves all splits.
    """
    need_columns(df, split, *(order_by or ()))
    columns = df.columns
    df, keys = in_stored_order(df) if order_by is None else (df, list(order_by))
    kept = []
    for name, cap in caps.items():
        mine = named(split) == name
        if cap is not None:
            ranges = key_ranges(df.where(mine), keys)
            if strict and ranges.total < cap:
                raise ValueError(f"{cap} {name} rows wanted, there are {ranges.total}")
            if cap == 0:
                continue
            if cap < ranges.total:
                mine = mine & before(df, keys, ranges.cuts([cap])[cap])
        kept.append(mine)
    df = df.where(reduce(or_, kept)) if kept else df.limit(0)
    return df.select(*map(named, columns))
