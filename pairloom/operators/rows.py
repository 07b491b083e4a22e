"""Operators that rest on row position.

A Spark table has no row order, so each takes ``order_by``: columns that together identify a row
and are never null. Positions are counted from 0 along them. A table read from Parquet files also has an
order as stored: by file path, then by row within the file. ``order_by=None`` stands for it. It needs no
key and no sort: Spark tells each row's file and place, and files are counted without reading a column.

Ranges are not cut out by numbering the table. The keys are counted in ranges taken from a sample, by a
balanced tree of comparisons, in the pass that counts the table. The ranges that hold wanted positions are
counted in narrower ones, all of them in one pass, until few enough rows are left to be put in order. The
table is then filtered by the keys found there: nothing else is sorted or shuffled, and the Parquet
scan gets the filters.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime
from math import ceil

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.checks import fresh, named, need_columns
from pairloom.functions.hashing import below_fraction, key_hash
from pairloom.storage import materialize

#: Ranges that the keys are counted in when a position is looked for, and keys sampled per range.
RANGES, SAMPLED = 32, 64

#: Ranges of at most so many rows are put in order.
FEW_ROWS = 32_768

#: Up to so many rows per group, a task sends its first ones of a group to the task that picks them; Spark
#: cuts groups before the shuffle for up to 1000 rows only.
TOP_PER_GROUP = 900

_SLOT = "_slot"  # partition number << 33 | place in the partition
_PLACE_BITS = 33


@dataclass(frozen=True)
class RowOrder:
    """A table written in key order, with the first position of each of its range partitions."""

    table: DataFrame
    keys: list[str]
    parts: list[int]
    starts: list[int]
    total: int

    def _slot_at(self, position: int) -> int:
        if not 0 <= position < self.total:
            raise ValueError(f"no row at {position}; the table has {self.total}")
        at = bisect_right(self.starts, position) - 1
        return (self.parts[at] << _PLACE_BITS) + position - self.starts[at]

    def check_unique(self) -> None:
        """Fail if two rows have equal keys: their places would be arbitrary."""
        keys = list(map(named, self.keys))
        twice = self.table.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
        if twice:
            raise ValueError(f"{self.keys} do not identify a row: {tuple(twice[0])[:-1]} occurs twice")

    def numbered(self, name: str, stop: int | None = None) -> DataFrame:
        """The rows, or those before position ``stop``, with the position of each."""
        spark, table = self.table.sparkSession, self.table
        if stop is not None and stop < self.total:
            table = table.where(F.col(_SLOT) < self._slot_at(stop))
        # One row per range partition: bounded by the number of shuffle partitions.
        starts = spark.createDataFrame(
            list(zip(self.parts, self.starts)), "_part bigint, _start bigint"
        )
        place = F.col(_SLOT).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
        return (
            table.withColumn("_part", F.shiftright(_SLOT, _PLACE_BITS))
            .join(F.broadcast(starts), "_part")
            .withColumn(name, F.col("_start") + place)
            .drop("_part", "_start", _SLOT)
        )


def _without_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    need_columns(df, *keys)
    refused = {
        key: F.raise_error(F.lit(f"null order key {key}")).cast(df.schema[key].dataType)
        for key in keys
    }
    return df.withColumns({key: F.coalesce(named(key), refused[key]) for key in keys})


def row_order(df: DataFrame, order_by: Sequence[str], partitions: int | None = None) -> RowOrder:
    """Range-partition and sort ``df`` by its keys and write it out once."""
    keys = list(order_by)
    spread = _without_null_keys(df, keys)
    if partitions is None:
        spread = spread.repartitionByRange(*keys)
    else:
        spread = spread.repartitionByRange(partitions, *keys)
    table = materialize(
        spread.sortWithinPartitions(*keys).withColumn(_SLOT, F.monotonically_increasing_id()),
        "row-order",
    )
    sizes = (
        table.groupBy(F.shiftright(_SLOT, _PLACE_BITS).alias("part")).count().orderBy("part")
        .collect()
    )
    parts, starts, total = [], [], 0
    for part, size in sizes:
        parts.append(part)
        starts.append(total)
        total += size
    return RowOrder(table, keys, parts, starts, total)


def with_row_index(
    df: DataFrame, order_by: Sequence[str] | None, name: str = "row_index", partitions: int | None = None
) -> DataFrame:
    """Number the rows 0, 1, 2, … along ``order_by``, which must identify a row, or as they are stored (None).

    The key columns alone are put in order; the table is joined with their places once. Whole files
    in stored order need neither: a row's number is its place plus the rows in the files before.
    """
    if order_by is None:
        return _stored_index(df, name)[0]
    need_columns(df, *order_by)
    keys = list(order_by)
    order = row_order(df.select(*map(named, keys)), keys, partitions)
    order.check_unique()
    kept = [named(column) for column in df.columns if column != name]
    return df.join(order.numbered(fresh(df, "_at")), keys).select(
        *kept, named(fresh(df, "_at")).alias(name)
    )


def in_stored_order(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with two more columns, the file and place that each row is stored at, and their names."""
    names = [fresh(df, "_file"), fresh(df, "_place")]
    try:
        stored = df.metadataColumn("_metadata")
        return df.select(
            "*", stored["file_path"].alias(names[0]), stored["row_index"].alias(names[1])
        ), names
    except AnalysisException as error:
        raise ValueError(
            "only a table read from Parquet files, filtered or projected at most, has a stored order; "
            "name the columns to order by"
        ) from error


@dataclass(frozen=True)
class StoredFiles:
    """Files in order of path with the rows that a table takes from each: as many as Spark has listed."""

    paths: list[str]
    starts: list[int]
    total: int
    whole: bool

    def key_at(self, position: int) -> tuple[str, int]:
        """File and place of a row; only for files taken as a whole."""
        at = bisect_right(self.starts, position) - 1
        return self.paths[at], position - self.starts[at]


def stored_files(placed: DataFrame, names: Sequence[str]) -> StoredFiles:
    """Count the rows of each file. A filter leaves some files with fewer rows than places."""
    file, place = names
    rows = placed.groupBy(named(file)).agg(
        F.count("*").alias("n"), (F.max(named(place)) + 1).alias("places")
    ).orderBy(named(file)).collect()
    starts, total = [], 0
    for row in rows:
        starts.append(total)
        total += row["n"]
    return StoredFiles(
        [row[0] for row in rows], starts, total, all(row["n"] == row["places"] for row in rows)
    )


def _stored_index(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df`` with the position of each row as stored, and the number of rows."""
    placed, keys = in_stored_order(df)
    files = stored_files(placed, keys)
    if not files.whole:
        order = row_order(placed.select(*map(named, keys)), keys)
        numbered = placed.join(order.numbered(fresh(placed, "_at")), keys)
        at = named(fresh(placed, "_at"))
    else:
        # One row per file, as many as the driver has listed. Shuffled by file, a file's rows would meet in one task.
        first = fresh(placed, "_first")
        starts = placed.sparkSession.createDataFrame(
            list(zip(files.paths, files.starts)), T.StructType([
                T.StructField(keys[0], T.StringType()), T.StructField(first, T.LongType())
            ])
        )
        numbered, at = placed.join(F.broadcast(starts), keys[0]), named(first) + named(keys[1])
    kept = [named(column) for column in df.columns if column != name]
    return numbered.select(*kept, at.alias(name)), files.total


def _literal(value, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.TimestampType):
        return F.timestamp_micros(F.lit(value))
    if isinstance(value, datetime) and isinstance(dtype, T.TimestampNTZType):
        return F.lit(value.isoformat(sep=" ")).cast(dtype)
    return F.lit(value).cast(dtype)


def _collected(df: DataFrame, keys: Sequence[str]) -> list[tuple]:
    """Keys on the driver. A moment travels as microseconds: Python's local times are not unique."""
    columns = [
        F.unix_micros(named(key)) if isinstance(df.schema[key].dataType, T.TimestampType) else named(key)
        for key in keys
    ]
    return [tuple(row) for row in df.select(*columns).collect()]


def _sql(value, dtype: T.DataType) -> str:
    """A key as SQL text: many bounds at once are parsed far faster than put together call by call."""
    if isinstance(dtype, T.TimestampType):
        return f"timestamp_micros({value})"
    if isinstance(dtype, T.StringType):
        return f"decode(unhex('{value.encode().hex()}'), 'UTF-8')"
    if isinstance(dtype, T.BinaryType):
        return f"unhex('{bytes(value).hex()}')"
    if isinstance(value, datetime):
        value = value.isoformat(sep=" ")
    return f"CAST('{value}' AS {dtype.simpleString()})"


def _range_of(df: DataFrame, keys: Sequence[str], bounds: Sequence[tuple]) -> Column:
    """How many of the ascending bounds a row's key has reached: about log2 of them are compared."""
    names = ["`" + key.replace("`", "``") + "`" for key in keys]
    dtypes = [df.schema[key].dataType for key in keys]

    def below(bound: tuple) -> str:
        values = [_sql(value, dtype) for value, dtype in zip(bound, dtypes)]
        condition = f"{names[-1]} < {values[-1]}"
        for name, value in reversed(list(zip(names[:-1], values[:-1]))):
            condition = f"{name} < {value} OR ({name} = {value} AND ({condition}))"
        return condition

    def between(low: int, high: int) -> str:
        if low == high:
            return str(low)
        middle = (low + high) // 2
        return (
            f"CASE WHEN {below(bounds[middle])} THEN {between(low, middle)} "
            f"ELSE {between(middle + 1, high)} END"
        )

    return F.expr(between(0, len(bounds)))


@dataclass(frozen=True)
class _Stretch:
    """Rows from key ``low`` to before ``high`` (None: no bound): ``size`` of them, from position ``start``."""

    low: tuple | None
    high: tuple | None
    start: int
    size: int

    def holds(self, df: DataFrame, keys: Sequence[str]) -> Column:
        inside = F.lit(True)
        if self.low is not None:
            inside &= at_or_after(df, keys, self.low)
        if self.high is not None:
            inside &= before(df, keys, self.high)
        return inside


def _stretches(
    bounds: Sequence[tuple], sizes: dict[int, int], within: _Stretch, first: int = 0
) -> list[_Stretch]:
    """The ranges that ``bounds`` cut a stretch into; ``first`` is the number of the first in ``sizes``."""
    out, start, edges = [], within.start, [within.low, *bounds, within.high]
    for at, (low, high) in enumerate(zip(edges, edges[1:])):
        size = sizes.get(first + at, 0)
        out.append(_Stretch(low, high, start, size))
        start += size
    return out


def _not_unique(keys: Sequence[str], size: int) -> ValueError:
    return ValueError(f"{list(keys)} do not identify a row: {size} rows cannot be told apart")


@dataclass(frozen=True)
class KeyRanges:
    """A table's keys, counted in ranges."""

    rows: DataFrame
    keys: list[str]
    total: int
    ranges: list[_Stretch]

    def _narrower(self, wide: list[_Stretch]) -> list[_Stretch]:
        """The ranges of several stretches: one pass to sample them all, one to count them all."""
        sampled, number = F.lit(False), F.lit(0)
        for at, stretch in enumerate(wide):
            every = -(-stretch.size // (RANGES * SAMPLED))
            inside = stretch.holds(self.rows, self.keys)
            chosen = F.pmod(F.xxhash64(*map(named, self.keys)), F.lit(every)) == 0
            sampled, number = sampled | (inside & chosen), F.when(inside, at).otherwise(number)
        most = 4 * RANGES * SAMPLED * len(wide)
        mark = fresh(self.rows, "_stretch")
        found = _collected(
            self.rows.where(sampled).withColumn(mark, number).orderBy(*map(named, self.keys)).limit(most),
            [mark, *self.keys],
        )
        cuts = []
        for at in range(len(wide)):
            own = [key for where, *key in found if where == at]
            step = max(1, len(own) // RANGES)
            cuts.append(list(dict.fromkeys(map(tuple, own[step::step]))))
        edges: list[tuple] = []  # of all stretches, ascending; two neighbours share one
        firsts = []
        for stretch, bounds in zip(wide, cuts):
            if stretch.low is not None and stretch.low not in edges:
                edges.append(stretch.low)
            firsts.append(len(edges))
            edges += [*bounds, *([stretch.high] if stretch.high is not None else [])]
        inside = F.lit(False)
        for stretch in wide:
            inside |= stretch.holds(self.rows, self.keys)
        counted = self.rows.where(inside).groupBy(
            _range_of(self.rows, self.keys, edges).alias("range")
        ).count()
        sizes = dict(counted.collect())
        narrow = []
        for stretch, bounds, first in zip(wide, cuts, firsts):
            parts = _stretches(bounds, sizes, stretch, first)
            if any(part.size == stretch.size for part in parts):
                raise _not_unique(self.keys, stretch.size)
            narrow += parts
        return narrow

    def keys_at(self, positions: Sequence[int]) -> dict[int, tuple]:
        """The keys at the given positions."""
        known = self.ranges
        while True:
            hit = [
                part for part in known
                if any(part.start <= position < part.start + part.size for position in positions)
            ]
            wide = [part for part in hit if part.size > FEW_ROWS]
            if not wide:
                break
            narrow = self._narrower(wide)
            known = sorted([part for part in hit if part not in wide] + narrow, key=lambda part: part.start)
        if not hit:
            return {}
        inside = F.lit(False)
        for part in hit:
            inside |= part.holds(self.rows, self.keys)
        few = _collected(self.rows.where(inside).orderBy(*map(named, self.keys)), self.keys)
        found, offset = {}, 0
        for part in hit:
            found |= {
                position: few[offset + position - part.start]
                for position in positions if part.start <= position < part.start + part.size
            }
            offset += part.size
        return found

    def cuts(self, positions: Sequence[int]) -> dict[int, tuple]:
        """The keys at which ranges may be cut: each one's predecessor must differ."""
        found = self.keys_at(sorted({p for at in positions for p in (at - 1, at) if p >= 0}))
        for position in positions:
            if position and found[position - 1] == found[position]:
                raise ValueError(f"{self.keys} do not identify a row: {found[position]} occurs twice")
        return {position: found[position] for position in positions}


def key_ranges(df: DataFrame, order_by: Sequence[str]) -> KeyRanges:
    """Sample the keys of a table, then count them in ranges. A null key is an error."""
    keys = list(order_by)
    rows = df.select(*map(named, keys))
    chance = fresh(rows, "_chance")
    hashed = rows.withColumn(chance, F.xxhash64(*map(named, keys)))
    drawn = hashed.orderBy(chance).limit(RANGES * SAMPLED).drop(chance)
    sample = _collected(drawn.dropna().orderBy(*map(named, keys)), keys)
    step = max(1, len(sample) // RANGES)
    bounds = list(dict.fromkeys(sample[step::step]))
    nulls = [F.count(F.when(named(key).isNull(), 1)).alias(f"_nulls{at}") for at, key in enumerate(keys)]
    counted = rows.groupBy(_range_of(rows, keys, bounds).alias("_range")).agg(
        F.count("*").alias("_size"), *nulls
    ).collect()
    for at, key in enumerate(keys):
        if any(row[f"_nulls{at}"] for row in counted):
            raise ValueError(f"null order key {key}")
    sizes = {row["_range"]: row["_size"] for row in counted}
    total = sum(sizes.values())
    return KeyRanges(rows, keys, total, _stretches(bounds, sizes, _Stretch(None, None, 0, total)))


def _earlier(keys: Sequence[str], bounds: Sequence[Column]) -> Column:
    """Rows whose key comes before the bounds, compared column by column."""
    *front, (last, bound) = zip(map(named, keys), bounds)
    condition = last < bound
    for key, bound in reversed(front):
        condition = (key < bound) | ((key == bound) & condition)
    return condition


def _bounds(df: DataFrame, keys: Sequence[str], values: tuple) -> list[Column]:
    return [_literal(value, df.schema[key].dataType) for key, value in zip(keys, values)]


# The first comparison in each of these follows from the second. It is there for the Parquet scan,
# which can use it to skip row groups.


def before(df: DataFrame, keys: Sequence[str], values: tuple) -> Column:
    """Rows whose key is before the given one, in key order."""
    bounds = _bounds(df, keys, values)
    return (named(keys[0]) <= bounds[0]) & _earlier(keys, bounds)


def at_or_after(df: DataFrame, keys: Sequence[str], values: tuple) -> Column:
    """Rows whose key is the given one or after it, in key order."""
    bounds = _bounds(df, keys, values)
    return (named(keys[0]) >= bounds[0]) & ~_earlier(keys, bounds)


def _too_short(total: int, wanted: int) -> ValueError:
    return ValueError(f"{wanted} rows wanted, the table has {total}")


def head_rows(df: DataFrame, n: int, order_by: Sequence[str] | None, strict: bool = True) -> DataFrame:
    """The first ``n`` rows. A shorter table is an error, or with ``strict=False`` kept whole."""
    return slice_rows(df, 0, n, order_by, strict)


def slice_rows(
    df: DataFrame, start: int, stop: int, order_by: Sequence[str] | None, strict: bool = True
) -> DataFrame:
    """The rows at positions ``start`` to ``stop - 1`` along ``order_by``, or as they are stored (None)."""
    if not 0 <= start <= stop:
        raise ValueError(f"not a row range: [{start}, {stop})")
    if order_by is not None:
        need_columns(df, *order_by)
    if start == stop:
        return df.limit(0)
    placed, keys = in_stored_order(df) if order_by is None else (df, list(order_by))
    total, cuts_at = _positions(placed, keys, order_by is None)
    if strict and total < stop:
        raise _too_short(total, stop)
    if start >= total:
        return df.limit(0)
    cuts = cuts_at([at for at in (start, stop) if 0 < at < total])
    if start in cuts:
        placed = placed.where(at_or_after(placed, keys, cuts[start]))
    if stop in cuts:
        placed = placed.where(before(placed, keys, cuts[stop]))
    return placed.select(*map(named, df.columns))


def _positions(
    df: DataFrame, keys: list[str], stored: bool
) -> tuple[int, Callable[[Sequence[int]], dict[int, tuple]]]:
    """The number of rows, and a function from positions to the keys at which ranges may be cut there."""
    if stored:
        files = stored_files(df, keys)
        if files.whole:
            return files.total, lambda positions: {at: files.key_at(at) for at in positions}
    ranges = key_ranges(df, keys)
    return ranges.total, ranges.cuts


def _spread_edges(narrow: DataFrame, groups: list[str], keys: list[str], limit: Column) -> DataFrame:
    """Of each group that must be cut: the first row left out, and the last one kept."""
    rows = row_order(narrow, [*groups, *keys]).numbered("_at")
    out = F.col("_first") + limit
    edges = (
        rows.groupBy(*map(named, groups))
        .agg(F.min("_at").alias("_first"), F.count("*").alias("_size"))
        .where(F.col("_size") > limit)
        .select(F.explode(F.when(limit > 0, F.array(out - 1, out)).otherwise(F.array(out))).alias("_at"))
    )
    return rows.join(materialize(edges, "edges"), "_at")


def _top_edges(narrow: DataFrame, groups: list[str], keys: list[str], n: int) -> DataFrame:
    """The same for few rows per group: each task keeps its first ``n + 1`` of a group, then they meet."""
    order = Window.partitionBy(*map(named, groups)).orderBy(*map(named, keys))
    ranked = _without_null_keys(narrow, [*groups, *keys]).withColumn("_rank", F.row_number().over(order))
    top = ranked.where(F.col("_rank") <= n + 1).where(F.col("_rank") >= n)
    cut = top.groupBy(*map(named, groups)).agg(F.max("_rank").alias("_most")).where(F.col("_most") > n)
    return top.join(cut, groups, "left_semi")


def head_per_group(
    df: DataFrame, groups: Sequence[str], n: int | Column, order_by: Sequence[str]
) -> DataFrame:
    """The first ``n`` rows of each group; a shorter group is kept whole.

    ``n`` may be an expression on the group columns. Group columns must not be null. A group of
    any size is spread over range partitions, never sorted by one task.
    """
    groups, keys = list(groups), [key for key in order_by if key not in groups]
    need_columns(df, *groups, *keys)
    limit = n if isinstance(n, Column) else F.lit(n)
    narrow = df.select(*map(named, [*groups, *keys]))
    if isinstance(n, int) and n <= TOP_PER_GROUP:
        edges = _top_edges(narrow, groups, keys, n)
    else:
        edges = _spread_edges(narrow, groups, keys, limit)
    key = F.struct(*map(named, keys))
    cut = (
        edges.groupBy(*map(named, groups))
        .agg(F.min(key).alias("_last"), F.max(key).alias("_cut"), F.count("*").alias("_edges"))
        .withColumn("_cut", F.when(
            (F.col("_edges") > 1) & (F.col("_last") == F.col("_cut")),
            F.raise_error(F.lit(f"{keys} do not identify a row in its group")),
        ).otherwise(F.col("_cut")))
        .select(*map(named, groups), *(F.col("_cut")[name].alias(f"_cut_{name}") for name in keys))
    )
    joined = df.join(materialize(cut, "cuts"), groups, "left")
    inside = _earlier(keys, [F.col(f"_cut_{key}") for key in keys])
    short = F.col(f"_cut_{keys[0]}").isNull()
    return joined.where(short | inside).select(*map(named, df.columns))


def trim_curve(
    df: DataFrame, full: str, method: str = "method", n: str = "n", last: str = "n_max"
) -> DataFrame:
    """Drop the last point of every curve but the one named ``full``."""
    need_columns(df, method, n, last)
    return df.where((F.col(n) < F.col(last)) | (F.col(method) == F.lit(full)))


def hash_split(
    df: DataFrame,
    key: str,
    fraction: float = 0.1,
    seed: int | str = 0,
    exact: bool = False,
    names: tuple[str, str] = ("train", "validation"),
    column: str = "split",
) -> DataFrame:
    """Mark about ``fraction`` of the rows as the second split, the rest as the first.

    The choice hangs on the row key alone: it is repeatable, needs no shuffle, and a row keeps its
    split when the table grows. With ``exact`` the second split has exactly
    ``ceil(fraction * rows)`` rows: those with the smallest hashes.
    """
    need_columns(df, key)
    there = F.coalesce(named(key).cast("string"), F.raise_error(F.lit(f"null order key {key}")))
    if not exact:
        chosen = below_fraction(there, fraction, seed)
        return df.withColumn(column, F.when(chosen, names[1]).otherwise(names[0]))
    if not 0 < fraction < 1:
        raise ValueError(f"fraction must lie between 0 and 1, not {fraction}")
    extra = fresh(df, "_hash")
    hashed, keys = df.withColumn(extra, key_hash(there, seed)), [extra, key]
    ranges = key_ranges(hashed, keys)
    wanted = ceil(fraction * ranges.total)
    chosen = F.lit(True)
    if wanted < ranges.total:
        chosen = before(hashed, keys, ranges.cuts([wanted])[wanted])
    return hashed.withColumn(column, F.when(chosen, names[1]).otherwise(names[0])).drop(extra)


def assign_batches(
    df: DataFrame, order_by: Sequence[str] | None, batch_size: int = 100, name: str = "batch_id"
) -> DataFrame:
    """Number consecutive batches of ``batch_size`` rows; the last may be short."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    at = fresh(df, "_at")
    numbered = with_row_index(df, order_by, at)
    return numbered.withColumn(name, F.floor(F.col(at) / batch_size)).drop(at)


def attach_by_position(
    df: DataFrame, order_by: Sequence[str] | None, other: DataFrame, other_order_by: Sequence[str] | None
) -> DataFrame:
    """Put two tables of equal length side by side, row by row. Their keys must identify a row.

    Without keys (None) both are taken as they are stored, and meet in one join by position.
    """
    shared = set(df.columns) & set(other.columns)
    if shared:
        raise ValueError(f"both tables have {sorted(shared)}")
    if order_by is None and other_order_by is None:
        at = fresh(other, fresh(df, "_at"))
        (one, rows), (two, others) = _stored_index(df, at), _stored_index(other, at)
        if rows != others:
            raise ValueError(f"the tables have {rows} and {others} rows")
        return one.join(two, at).drop(at)
    if order_by is None or other_order_by is None:
        raise ValueError("name the columns to order by for both tables, or for neither")
    need_columns(df, *order_by)
    need_columns(other, *other_order_by)
    left = row_order(df.select(*map(named, order_by)), order_by)
    right = row_order(other.select(*map(named, other_order_by)), other_order_by)
    if left.total != right.total:
        raise ValueError(f"the tables have {left.total} and {right.total} rows")
    left.check_unique()
    right.check_unique()
    at = fresh(other, fresh(df, "_at"))
    # Narrow tables of keys meet by position; each wide table is then joined once, by its own key.
    paired = materialize(left.numbered(at).join(right.numbered(at), at).drop(at), "pairs")
    return df.join(paired, list(order_by)).join(other, list(other_order_by)).select(
        *map(named, df.columns), *map(named, other.columns)
    )
