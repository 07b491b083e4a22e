import pytest
from pyspark.sql import functions as F

from pairloom import operators as op
from pairloom.operators import rows as rows_module


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Files of unlike size, with clashing column names, and the rows as they lie in them."""
    folder = tmp_path_factory.mktemp("stored")
    table = spark.range(4000).select(
        F.pmod(F.col("id") * 7919, F.lit(4000)).alias("k"), F.md5(F.col("id").cast("string")).alias("s"),
        F.lit(1).alias("_file"), F.lit(2).alias("_place"), F.lit(3).alias("_metadata"),
    )
    for number, (low, high) in enumerate([(0, 1), (1, 900), (900, 900), (900, 3100), (3100, 4000)]):
        part = spark.range(low, high).toDF("id").select(
            F.pmod(F.col("id") * 7919, F.lit(4000)).alias("k"), F.md5(F.col("id").cast("string")).alias("s"),
            F.lit(1).alias("_file"), F.lit(2).alias("_place"), F.lit(3).alias("_metadata"),
        )
        part.coalesce(1).write.parquet(f"{folder}/part={number}")
    order = [row.k for row in table.collect()]
    return spark.read.parquet(str(folder)), order


@pytest.fixture(params=["few", "many"])
def narrow(request, monkeypatch):
    if request.param == "many":
        monkeypatch.setattr(rows_module, "FEW_ROWS", 20)
        monkeypatch.setattr(rows_module, "RANGES", 5)


@pytest.mark.parametrize("start, stop", [(0, 1), (0, 4000), (899, 901), (3000, 3999), (7, 7)])
def test_slices_follow_the_files(stored, start, stop):
    table, order = stored
    got = op.slice_rows(table, start, stop, None)
    assert sorted(r.k for r in got.collect()) == sorted(order[start:stop])
    assert got.columns == table.columns


def test_a_slice_neither_sorts_nor_shuffles(stored, plan_of):
    plan = plan_of(op.slice_rows(stored[0], 100, 3500, None))
    assert "Exchange" not in plan and "Sort" not in plan


@pytest.mark.parametrize("start, stop", [(0, 5), (400, 1200), (1300, 1333)])
def test_rows_that_a_filter_leaves(stored, narrow, start, stop):
    table, order = stored
    left = [k for k in order if k % 3 == 1]
    got = op.slice_rows(table.where("k % 3 = 1").select("k"), start, stop, None)
    assert sorted(r.k for r in got.collect()) == sorted(left[start:stop])


def test_lengths_are_checked(stored):
    with pytest.raises(ValueError, match="4001 rows wanted"):
        op.head_rows(stored[0], 4001, None)
    assert op.head_rows(stored[0], 4001, None, strict=False).count() == 4000
    assert op.slice_rows(stored[0], 5000, 6000, None, strict=False).count() == 0


def test_numbers_need_no_shuffle_by_file(stored, plan_of):
    plan = plan_of(op.with_row_index(stored[0], None))
    assert "BroadcastHashJoin" in plan
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


@pytest.mark.parametrize("condition", ["true", "k % 7 <> 2"])
def test_numbers(stored, condition):
    table, order = stored
    kept = [k for k in order if condition == "true" or k % 7 != 2]
    rows = op.with_row_index(table.where(condition), None).collect()
    assert sorted((r.row_index, r.k) for r in rows) == list(enumerate(kept))
    batches = op.assign_batches(table.where(condition).select("k"), None, 64).collect()
    assert sorted((r.batch_id, r.k) for r in batches) == sorted((at // 64, k) for at, k in enumerate(kept))


def test_side_by_side(spark, stored, tmp_path, plan_of):
    table, order = stored
    spark.createDataFrame([(i, -k) for i, k in enumerate(order)], "i int, negative long").coalesce(
        1
    ).write.parquet(str(tmp_path / "other"))
    other = spark.read.parquet(str(tmp_path / "other"))
    both = op.attach_by_position(table.select("k", "s"), None, other, None)
    assert both.columns == ["k", "s", "i", "negative"]
    assert both.where("k = -negative").count() == 4000
    with pytest.raises(ValueError, match="4000 and 3999 rows"):
        op.attach_by_position(table.select("k"), None, other.where("i > 0"), None)
    with pytest.raises(ValueError, match="for neither"):
        op.attach_by_position(table.select("k"), ["k"], other, None)


def test_capped_splits(stored):
    table, order = stored
    marked = table.withColumn("split", F.when(F.col("k") % 2 == 0, "train").otherwise("test"))
    got = op.training_view(marked, {"train": 300, "test": None}, None).collect()
    wanted = [k for k in order if k % 2 == 0][:300] + [k for k in order if k % 2]
    assert sorted(r.k for r in got) == sorted(wanted)


def test_other_tables_have_no_stored_order(spark, stored, tmp_path):
    with pytest.raises(ValueError, match="stored order"):
        op.head_rows(spark.range(5), 2, None)
    with pytest.raises(ValueError, match="stored order"):
        op.with_row_index(stored[0].groupBy("k").count(), None)
    spark.range(5).write.csv(str(tmp_path / "csv"))
    with pytest.raises(ValueError, match="stored order"):
        op.head_rows(spark.read.csv(str(tmp_path / "csv")), 2, None)


def test_empty(spark, tmp_path):
    spark.range(0).write.parquet(str(tmp_path / "none"))
    none = spark.read.parquet(str(tmp_path / "none"))
    assert op.with_row_index(none, None).collect() == []
    assert op.head_rows(none, 3, None, strict=False).collect() == []
