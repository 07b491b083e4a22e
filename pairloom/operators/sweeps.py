"""Sweep analysis: mean per setting, and the best result to expect of n tries."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.checks import fresh, named, need_columns
from pairloom.operators.filters import keep_values
from pairloom.operators.rows import trim_curve, with_row_index
from pairloom.storage import materialize

#: ``u ** n`` is 0.0 in a double once n is over this number divided by -log(u).
UNDERFLOW = 746.0

#: Values times points of a curve that one task is given.
TASK_WORK = 500_000


def _present(df: DataFrame, name: str) -> Column:
    there = F.col(name).isNotNull()
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        there = there & ~F.isnan(name)
    return there


def mean_by(df: DataFrame, keys: Sequence[str], value: str, name: str | None = None) -> DataFrame:
    """The mean per setting. Rows without a key are left out, missing values skipped."""
    need_columns(df, *keys, value)
    for key in keys:
        df = df.where(_present(df, key))
    counted = F.when(_present(df, value), F.col(value))
    return df.groupBy(*keys).agg(F.avg(counted).alias(name or value))


def win_rate(
    df: DataFrame, rank: str = "rank", by: Sequence[str] = ("config", "split")
) -> DataFrame:
    """The share of pairs whose second completion won, among those with a verdict."""
    need_columns(df, rank, *by)
    verdict = F.col(rank)
    valid = F.coalesce(verdict.isin(0, 1), F.lit(False))
    return df.groupBy(*by).agg(
        F.avg(F.when(valid, verdict)).alias("win_rate"),
        F.count(F.when(valid, True)).alias("n"),
        F.count(F.when(~valid, True)).alias("n_invalid"),
    )


def value_range(df: DataFrame, method: str, value: str) -> DataFrame:
    """The smallest and largest value per method."""
    need_columns(df, method, value)
    there = df.where(_present(df, value))
    return there.groupBy(method).agg(F.min(value).alias("min"), F.max(value).alias("max"))


def _partitioned_counts(
    df: DataFrame, method: str, value: str, n_max: int | None
) -> tuple[DataFrame, int]:
    """Per method and distinct value how often it occurs, in range partitions ``part``, and the
    number of tasks the curves deserve.

    Few bytes may mean much work here, as every value meets every n; so the number goes by the
    work and is not left to the size. Partitions are written out: a row must have the same one
    wherever it is used.
    """
    merged = materialize(
        df.where(_present(df, method) & _present(df, value))
        .groupBy(F.col(method), F.col(value).cast("double").alias("v"))
        .agg(F.count("*").alias("c")),
        "sweep-counts",
    )
    points = F.col("total") if n_max is None else F.least(F.col("total"), F.lit(n_max))
    sizes = merged.groupBy(method).agg(F.count("*").alias("values"), F.sum("c").alias("total"))
    # The k-th largest of N values has about UNDERFLOW * N / k terms that are not 0.
    terms = F.least(
        F.col("values") * points.cast("double"),
        UNDERFLOW * F.col("total") * (1 + F.log(F.col("values").cast("double"))) + points,
    )
    work = sizes.agg(F.sum(terms)).first()[0]
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(most, ceil((work or 0) / TASK_WORK))
    if tasks <= 1:
        return merged.withColumn("part", F.lit(0)), 1
    ranged = merged.repartitionByRange(2 * tasks, method, "v")
    return materialize(ranged.withColumn("part", F.spark_partition_id()), "sweep-parts"), tasks


def _empirical_cdf(df: DataFrame, method: str, value: str, n_max: int | None) -> DataFrame:
    """Per method and distinct value: the share of values below it, and up to it.

    Equal values are merged first. The running count is then taken within range partitions and
    shifted by the count of the partitions before, so no method's values meet in one task.
    """
    counts, tasks = _partitioned_counts(df, method, value, n_max)
    # One row per method and range partition that holds it.
    shares = counts.groupBy(method, "part").agg(
        F.sum("c").alias("in_part"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    whole = Window.partitionBy(method)
    earlier = whole.orderBy("part")
    starts = shares.select(
        method, "part",
        (F.sum("in_part").over(earlier) - F.col("in_part")).alias("start"),
        F.sum("in_part").over(whole).alias("total"),
        F.min("low").over(whole).alias("min"), F.max("high").over(whole).alias("max"),
    )
    running = F.sum("c").over(
        Window.partitionBy(method, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    )
    upto = F.col("start") + F.col("running")
    if tasks > 1:
        counts = counts.repartitionByRange(tasks, method, "part")
    return (
        counts.withColumn("running", running)
        .join(materialize(starts, "sweep-starts"), [method, "part"])
        .select(
            method, "v", "total", "min", "max",
            ((upto - F.col("c")) / F.col("total")).alias("below"),
            (upto / F.col("total")).alias("upto"),
        )
    )


def expected_max(
    df: DataFrame, method: str, value: str, n_max: int | None = None
) -> DataFrame:
    """Per method and n: mean and standard deviation of the largest of n values drawn with
    replacement, beside the method's smallest and largest value.

    n runs to the number of values, or to ``n_max`` if that is smaller. Missing values are left
    out. A value far below the largest has no chance to be the largest of many: its terms are only made
    up to the n where they are 0.0 as doubles, so a whole curve takes about N log N of them.

    Both moments are taken in one pass, about the largest value M. That loses no accuracy to
    speak of: M itself is drawn with a chance of at least 1/N, so (M - mean)^2 is at most N times
    the variance, and the variance keeps all but log10(N) of its sixteen digits.
    """
    need_columns(df, method, value)
    cdf = _empirical_cdf(df, method, value, n_max)
    longest = F.col("total") if n_max is None else F.least(F.col("total"), F.lit(n_max))
    # The probability that the largest of n draws is this value.
    chance = F.pow("upto", F.col("n")) - F.pow("below", F.col("n"))
    shift = F.col("v") - F.col("max")
    moments = (
        cdf.withColumn("n_max", longest.cast("int"))
        .withColumn("last", F.when(
            F.col("upto") >= 1, F.col("n_max")
        ).otherwise(F.least(F.col("n_max"), F.ceil(-UNDERFLOW / F.log("upto")).cast("int"))))
        .select("*", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("n"))
        .groupBy(method, "n")
        .agg(
            F.sum(shift * chance).alias("_first"), F.sum(shift * shift * chance).alias("_second"),
            F.first("n_max").alias("n_max"), F.first("min").alias("min"),
            F.first("max").alias("max"),
        )
    )
    variance = F.col("_second") - F.col("_first") * F.col("_first")
    return moments.select(
        method, "n", (F.col("max") + F.col("_first")).alias("mean"),
        F.sqrt(F.greatest(variance, F.lit(0.0))).alias("std"), "n_max", "min", "max",
    )


def with_band(df: DataFrame, mean: str = "mean", std: str = "std") -> DataFrame:
    """Add the band of one standard deviation about the mean: ``lo`` and ``hi``."""
    need_columns(df, mean, std)
    return df.withColumns({
        "lo": F.col(mean) - F.col(std),
        "hi": F.col(mean) + F.col(std),
    })


def method_names(df: DataFrame, method: str) -> DataFrame:
    """The method column as text: numbers as doubles, so that 1 and 1.0 are one method."""
    need_columns(df, method)
    column = named(method)
    if isinstance(df.schema[method].dataType, T.NumericType):
        column = column.cast("double")
    return df.withColumn(method, column.cast("string"))


def order_methods(df: DataFrame, method: str = "method", n: str = "n") -> DataFrame:
    """Methods in falling order of their number, methods with a name before all of them."""
    need_columns(df, method, n)
    number = F.coalesce(F.col(method).try_cast("double"), F.lit(1e9))
    return df.orderBy(number.desc(), F.col(method), F.col(n))


def rank_methods(df: DataFrame, method: str = "method", name: str = "rank") -> DataFrame:
    """Add each method's place, from 0, in the order of `order_methods`: an order that tables keep."""
    need_columns(df, method)
    number = F.coalesce(named(method).try_cast("double"), F.lit(1e9))
    falling = fresh(df, "_falling")
    methods = df.select(named(method)).distinct().withColumn(falling, -number)
    ranked = with_row_index(methods, [falling, method], name).drop(falling)
    return df.join(ranked, method).select(*map(named, [*df.columns, name]))


def legend_names(df: DataFrame, names: dict[str, str], method: str = "method") -> DataFrame:
    """Add ``label``: the method's name in a legend, or the method itself."""
    need_columns(df, method)
    label = F.col(method)
    for key, text in names.items():
        label = F.when(F.col(method) == key, F.lit(text)).otherwise(label)
    return df.withColumn("label", label)


def sweep_curves(
    df: DataFrame,
    method: str,
    settings: Sequence[str],
    value: str,
    n_max: int | None = None,
    keep: Sequence[str] | None = None,
    legend: dict[str, str] | None = None,
    full: str | None = None,
) -> DataFrame:
    """All methods of a sweep: mean per setting, curve of the expected maximum, band, label.

    ``settings`` are the keys that tell apart the runs to be averaged; the method is one of them
    by nature. ``keep`` limits the methods, ``full`` names the one method whose curve keeps its
    last point (none is trimmed without it).
    """
    rows = method_names(df, method)
    if keep is not None:
        rows = keep_values(rows, method, list(keep))
    keys = [method, *(key for key in settings if key != method)]
    curves = with_band(expected_max(mean_by(rows, keys, value), method, value, n_max))
    if full is not None:
        curves = trim_curve(curves, full, method)
    return legend_names(curves, legend or {}, method)
