import datetime as dt
from decimal import Decimal
from hashlib import md5
from math import ceil

import pytest
from pyspark.sql import functions as F

from pairloom import operators as op
from pairloom.operators import rows as rows_module
from pairloom.operators.rows import at_or_after, before, row_order


def numbers(spark, n, parts=5):
    """Keys in no order at all, with a wide second column."""
    return spark.range(n, numPartitions=parts).select(
        F.pmod(F.col("id") * 7919, F.lit(n)).alias("k") if n else F.col("id").alias("k"),
        F.md5(F.col("id").cast("string")).alias("s"),
    )


@pytest.mark.parametrize("n", [0, 1, 7, 1000, 20000])
def test_row_index_is_the_place_in_key_order(spark, n):
    rows = op.with_row_index(numbers(spark, n), ["k"], partitions=6).collect()
    assert sorted((r.k, r.row_index) for r in rows) == [(i, i) for i in range(n)]


def test_row_index_on_several_keys_of_mixed_type(spark):
    table = numbers(spark, 3000).select(
        (F.col("k") % 3).cast("string").alias("a"),
        F.timestamp_seconds(F.col("k") % 50).alias("b"), F.col("s").alias("c"),
    )
    rows = op.with_row_index(table, ["a", "b", "c"], partitions=9).collect()
    wanted = sorted(rows, key=lambda r: (r.a, r.b, r.c))
    assert [r.row_index for r in wanted] == list(range(3000))


def test_a_heavy_first_key_is_spread(spark):
    """A third of the rows share the first key; no range partition may hold them all."""
    table = spark.range(30000, numPartitions=4).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("a"), F.col("id").alias("b")
    )
    order = row_order(table, ["a", "b"], partitions=16)
    sizes = [stop - start for start, stop in zip(order.starts, [*order.starts[1:], order.total])]
    assert order.total == 30000 and max(sizes) < 30000 / 5


def test_null_keys_are_refused(spark):
    table = spark.createDataFrame([(1,), (None,)], "k int")
    for cut in (lambda: op.with_row_index(table, ["k"]), lambda: op.head_rows(table, 1, ["k"])):
        with pytest.raises(Exception, match="null order key"):
            cut()


@pytest.mark.parametrize("start, stop", [(0, 10), (0, 5000), (10, 10), (17, 3000), (4999, 5000), (0, 0)])
def test_ranges(spark, start, stop):
    table = numbers(spark, 5000)
    assert sorted(r.k for r in op.slice_rows(table, start, stop, ["k"]).collect()) == list(
        range(start, stop)
    )


def test_strict_and_lenient(spark):
    table = numbers(spark, 50)
    with pytest.raises(ValueError, match="51 rows wanted"):
        op.head_rows(table, 51, ["k"])
    assert op.head_rows(table, 51, ["k"], strict=False).count() == 50
    with pytest.raises(ValueError):
        op.slice_rows(table, 40, 60, ["k"])
    assert op.slice_rows(table, 40, 60, ["k"], strict=False).count() == 10
    assert op.slice_rows(table, 60, 70, ["k"], strict=False).count() == 0
    with pytest.raises(ValueError):
        op.slice_rows(table, 5, 4, ["k"])


@pytest.mark.parametrize("few", [5000, 7])
@pytest.mark.parametrize("n", [0, 1, 50, 200])
def test_head(spark, n, few, monkeypatch):
    monkeypatch.setattr(rows_module, "FEW_ROWS", few)
    monkeypatch.setattr(rows_module, "RANGES", 4)
    table = numbers(spark, 200)
    head = op.head_rows(table, n, ["s", "k"])
    wanted = sorted(tuple(r)[::-1] for r in table.collect())[:n]
    assert sorted(tuple(r)[::-1] for r in head.collect()) == wanted


def test_neighbouring_ranges_share_no_row_and_lose_none(spark):
    table = numbers(spark, 4000)
    a = op.slice_rows(table, 0, 1672, ["s", "k"])
    b = op.slice_rows(table, 1672, 4000, ["s", "k"])
    assert a.count() == 1672 and b.count() == 2328
    assert a.join(b, "k", "left_semi").count() == 0


def test_a_range_is_a_filter_in_the_scan(spark, plan_of):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    plan = plan_of(op.slice_rows(lines, 100, 3000, keys))
    assert "Exchange" not in plan and "GreaterThanOrEqual(l_orderkey," in plan


VALUES = [
    ("d date", [dt.date(2024, 1, d) for d in range(1, 20)]),
    ("d timestamp", [dt.datetime(2024, 1, 1, 0, 0, s, 7) for s in range(20)]),
    ("d timestamp_ntz", [dt.datetime(2024, 1, 1, 0, 0, s, 7) for s in range(20)]),
    ("d double", [x / 7 for x in range(-5, 15)] + [float("nan")]),
    ("d string", ["", " ", "a", "A", "é", "z", "\U0001f600", "￿"]),
    ("d boolean", [True, False]),
    ("d decimal(20,3)", [Decimal(x) / 8 for x in range(-9, 9)]),
    ("d float", [x / 3 for x in range(-5, 15)] + [float("inf")]),
    ("d binary", [b"", b"\x00", b"'", b"\xff\x01"]),
]


@pytest.mark.parametrize("schema, values", VALUES)
def test_key_bounds_of_every_type(spark, schema, values):
    table = spark.createDataFrame([(v,) for v in reversed(values)], schema)
    keys = dict(enumerate(rows_module._collected(table.orderBy("d"), ["d"])))
    counts = table.agg(*(
        F.count(F.when(condition(table, ["d"], keys[at]), 1)).alias(f"{name}{at}")
        for name, condition in (("before", before), ("after", at_or_after)) for at in keys
    )).first()
    for at in keys:
        assert (counts[f"before{at}"], counts[f"after{at}"]) == (at, len(keys) - at)
    bounds = list(keys.values())[1:]
    ranges = table.orderBy("d").select(rows_module._range_of(table, ["d"], bounds).alias("range"))
    assert [row.range for row in ranges.collect()] == list(range(len(keys)))


def test_positions_outside_are_refused(spark):
    with pytest.raises(ValueError):
        row_order(numbers(spark, 5), ["k"])._slot_at(5)


def test_head_per_group_with_one_heavy_group(spark):
    table = numbers(spark, 6000).withColumn(
        "g", F.when(F.col("k") % 3 == 0, "hot").otherwise((F.col("k") % 40).cast("string"))
    )
    cap = F.when(F.col("g") == "hot", 1500).otherwise(20)
    got = op.head_per_group(table, ["g"], cap, ["s", "k"]).collect()
    groups = {}
    for row in sorted(table.collect(), key=lambda r: (r.s, r.k)):
        groups.setdefault(row.g, []).append(row.k)
    wanted = [(g, k) for g, ks in groups.items() for k in ks[: 1500 if g == "hot" else 20]]
    assert sorted((r.g, r.k) for r in got) == sorted(wanted)


def test_keys_that_do_not_identify_a_row_are_refused(spark):
    table = spark.range(100).select((F.col("id") / 2).cast("int").alias("k"), F.lit("g").alias("g"))
    for cut in (
        lambda: op.head_rows(table, 5, ["k"]),
        lambda: op.slice_rows(table, 3, 8, ["k"]), lambda: op.slice_rows(table, 2, 9, ["k"]),
        lambda: op.head_per_group(table, ["g"], 5, ["k"]).collect(),
    ):
        with pytest.raises(Exception, match="do not identify a row"):
            cut()
    assert op.head_rows(table, 6, ["k"]).count() == 6
    assert op.head_per_group(table, ["g"], 6, ["k"]).count() == 6


def test_head_per_group_keeps_short_groups(spark):
    table = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "g string, k int")
    assert op.head_per_group(table, ["g"], 2, ["k"]).count() == 3
    assert op.head_per_group(table, ["g"], 1, ["k"]).count() == 2
    assert op.head_per_group(table, ["g"], 0, ["k"]).count() == 0


def test_head_per_group_without_broadcast(spark):
    table = numbers(spark, 500).withColumn("g", F.col("k") % 60)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert op.head_per_group(table, ["g"], 3, ["k"]).count() == 180
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hash_split_covers_and_repeats(spark):
    table = numbers(spark, 20000)
    split = op.hash_split(table, "k", 0.1, seed=3)
    counts = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert sum(counts.values()) == 20000 and 1800 < counts["validation"] < 2200
    other = op.hash_split(table.repartition(13), "k", 0.1, seed=3)
    assert split.exceptAll(other).count() == 0
    assert op.hash_split(table, "k", 0.1, seed=4).exceptAll(split).count() > 0


def test_a_row_keeps_its_split_when_the_table_grows(spark):
    small = op.hash_split(spark.range(500), "id")
    large = op.hash_split(spark.range(5000), "id").where("id < 500")
    assert small.exceptAll(large).count() == 0


SIZES = [(1, 0.1), (10, 0.1), (11, 0.1), (1003, 0.25), (30000, 0.1), (30000, 0.995), (30000, 0.003)]


@pytest.mark.parametrize("n, fraction", SIZES)
def test_exact_split_takes_the_smallest_hashes(spark, n, fraction):
    split = op.hash_split(numbers(spark, n), "k", fraction, seed=5, exact=True).collect()
    by_hash = sorted(range(n), key=lambda k: (md5(f"5:{k}".encode()).hexdigest(), k))
    chosen = sorted(r.k for r in split if r.split == "validation")
    assert len(split) == n and chosen == sorted(by_hash[: ceil(fraction * n)])


def test_batches(spark):
    sizes = op.assign_batches(numbers(spark, 1050), ["k"], 100).groupBy("batch_id").count()
    assert sorted(map(tuple, sizes.collect())) == [*((i, 100) for i in range(10)), (10, 50)]
    with pytest.raises(ValueError):
        op.assign_batches(numbers(spark, 5), ["k"], 0)


def test_tables_side_by_side(spark):
    left, right = numbers(spark, 300), numbers(spark, 300).toDF("k2", "s2")
    both = op.attach_by_position(left, ["k"], right, ["k2"])
    assert both.where("k = k2").count() == 300
    with pytest.raises(ValueError):
        op.attach_by_position(left, ["k"], right.limit(299), ["k2"])
    with pytest.raises(ValueError):
        op.attach_by_position(left, ["k"], left, ["k"])


def test_no_range_operator_sorts_in_one_task(spark, plan_of):
    table = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    for df in (
        op.with_row_index(table, ["o_orderkey"]), op.assign_batches(table, ["o_orderkey"]),
        op.slice_rows(table, 5, 50, ["o_orderkey"]),
    ):
        assert "SinglePartition" not in plan_of(df) and "Window" not in plan_of(df)


def test_ranges_are_narrowed_until_few_rows_are_left(spark, monkeypatch):
    monkeypatch.setattr(rows_module, "FEW_ROWS", 20)
    monkeypatch.setattr(rows_module, "RANGES", 5)
    monkeypatch.setattr(rows_module, "SAMPLED", 4)
    table = numbers(spark, 3000)
    wanted = sorted((r.s, r.k) for r in table.collect())
    for start, stop in ((0, 1), (1, 2999), (1499, 1502), (2990, 3000)):
        got = sorted((r.s, r.k) for r in op.slice_rows(table, start, stop, ["s", "k"]).collect())
        assert got == wanted[start:stop]


def test_all_cuts_are_narrowed_together(spark, monkeypatch):
    """Two passes a level, however many cuts are wanted."""
    monkeypatch.setattr(rows_module, "FEW_ROWS", 30)
    monkeypatch.setattr(rows_module, "RANGES", 6)
    levels = []
    narrower = rows_module.KeyRanges._narrower
    monkeypatch.setattr(
        rows_module.KeyRanges, "_narrower", lambda self, wide: levels.append(len(wide)) or narrower(self, wide)
    )
    table = numbers(spark, 4000)
    wanted = sorted((r.s, r.k) for r in table.collect())
    asked = [0, 1, 500, 501, 1999, 2600, 3333, 3999]
    found = rows_module.key_ranges(table, ["s", "k"]).cuts(asked)
    assert found == {at: wanted[at] for at in asked}
    assert len(levels) <= 4 and levels[0] > 1


def test_unlike_keys_beyond_a_range_of_equal_ones(spark, monkeypatch):
    monkeypatch.setattr(rows_module, "FEW_ROWS", 10)
    monkeypatch.setattr(rows_module, "RANGES", 4)
    table = spark.range(600).select(F.when(F.col("id") < 300, -1).otherwise(F.col("id")).alias("k"))
    assert op.slice_rows(table, 400, 450, ["k"]).count() == 50
    with pytest.raises(ValueError, match="do not identify a row"):
        op.slice_rows(table, 100, 450, ["k"])


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date"])
def test_moments_of_a_repeated_hour(spark, kind, monkeypatch):
    """The driver's local time repeats an hour here; no row may be lost to it."""
    import time

    monkeypatch.setenv("TZ", "America/New_York")
    time.tzset()
    try:
        moment = F.timestamp_seconds(F.lit(1730609400) + F.col("id") * 60)
        if kind == "date":
            moment = F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int"))
        table = spark.range(300).select(F.col("id"), moment.cast(kind).alias("t"))
        for n in (30, 90, 120, 299):
            assert [r.id for r in op.head_rows(table, n, ["t"]).orderBy("id").collect()] == list(range(n))
        assert op.slice_rows(table, 60, 140, ["t"]).count() == 80
    finally:
        monkeypatch.undo()
        time.tzset()


@pytest.mark.parametrize("n", [20, 30_000])
@pytest.mark.parametrize("exact", [True, False])
def test_a_null_key_is_refused_at_every_size(spark, n, exact):
    table = numbers(spark, n).withColumn("k", F.when(F.col("k") > 0, F.col("k")))
    with pytest.raises(Exception, match="null order key k"):
        op.hash_split(table, "k", exact=exact).collect()


def test_small_and_large_fractions(spark):
    table = spark.range(400_000)
    few = op.hash_split(table, "id", 1e-5).where("split = 'validation'").count()
    most = op.hash_split(table, "id", 0.99999).where("split = 'train'").count()
    assert few < 20 and most < 20


def test_helper_columns_leave_the_users_own_alone(spark):
    table = numbers(spark, 50).withColumns({"_hash": F.lit(1), "_at": F.lit(2)})
    assert op.hash_split(table, "k", 0.5, exact=True).columns == ["k", "s", "_hash", "_at", "split"]
    assert set(op.assign_batches(table, ["k"], 7).columns) == {"k", "s", "_hash", "_at", "batch_id"}


def test_equal_keys_have_no_place(spark):
    table = spark.range(40).select((F.col("id") / 2).cast("int").alias("k"), F.col("id").alias("v"))
    other = spark.range(40).toDF("w")
    for number in (
        lambda: op.with_row_index(table, ["k"]), lambda: op.assign_batches(table, ["k"], 3),
        lambda: op.attach_by_position(table, ["k"], other, ["w"]),
    ):
        with pytest.raises(ValueError, match="do not identify a row"):
            number()
