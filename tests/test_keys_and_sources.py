import pytest
from pyspark.sql import functions as F

from pairloom import operators as op
from pairloom import storage
from pairloom.sources import (
    clean_name, list_configs, list_splits, publish, published_configs, published_splits, read_dataset,
    read_sweep,
)

ROWS = [
    (1, "a", "train"), (2, "a", "validation"), (3, "b", "train"), (4, "c", "validation"),
    (5, None, "train"), (6, "a", "test"),
]


@pytest.fixture
def table(spark):
    return spark.createDataFrame(ROWS, "id int, topic string, split string")


def test_subsets_come_from_train_only(table):
    rows = op.fan_out(op.fold_splits(table, {"test": "validation"}), "topic").collect()
    assert sorted((r.id, r.config, r.split) for r in rows) == [
        (1, "a", "train"), (2, "a", "validation"), (3, "b", "train"), (6, "a", "validation"),
    ]


def test_fan_out_reads_rows_once_and_ships_a_checked_side(table, plan_of):
    plan = plan_of(op.fan_out(table, "topic"))
    assert plan.count("LeftSemi") == 1 and "BroadcastHashJoin" in plan


def test_many_keys_are_not_broadcast(spark, plan_of):
    table = spark.range(5000).select(
        F.md5(F.col("id").cast("string")).alias("topic"), F.lit("train").alias("split")
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10KB")
    try:
        subsets = op.fan_out(table, "topic")
        assert "BroadcastHashJoin" not in plan_of(subsets) and subsets.count() == 5000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_an_intermediate_table_is_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    side = storage.materialize(spark.range(30).mapInPandas(count, "id bigint"))
    assert spark.range(50).join(side, "id").count() == side.count() == 30 and seen.value == 30
    assert storage.materialize(spark.range(0)).count() == 0


def test_publish_replaces_one_part_only(spark, table, tmp_path):
    root = str(tmp_path / "set")
    rows = table.where("topic is not null").withColumnRenamed("topic", "config")
    publish(rows, root)
    publish(spark.createDataFrame([(9, "a", "train")], rows.schema), root, scope="parts")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(read_dataset(spark, root)) == [2, 3, 4, 6, 9]
    assert ids(read_dataset(spark, root, config="a")) == [2, 6, 9]
    assert ids(read_dataset(spark, root, "a", "train")) == [9]
    publish(rows.where("config = 'b'"), root)
    assert ids(read_dataset(spark, root)) == [3]


def test_reading_a_part_prunes_directories(spark, table, tmp_path, plan_of):
    root = str(tmp_path / "set")
    publish(table.where("topic is not null").withColumnRenamed("topic", "config"), root)
    plan = plan_of(read_dataset(spark, root, "a", "train"))
    assert "PartitionFilters: [isnotnull(config" in plan
    everything = read_dataset(spark, root)
    assert sorted(r.config for r in list_configs(everything).collect()) == ["a", "b", "c"]
    assert [r.split for r in list_splits(everything, "b").collect()] == ["train"]


def test_keys_that_look_like_numbers_stay_text(spark, tmp_path):
    root = str(tmp_path / "set")
    rows = spark.createDataFrame([(1, "01", "1"), (2, "1", "2")], "id int, config string, split string")
    publish(rows, root)
    back = read_dataset(spark, root)
    assert sorted(tuple(r) for r in back.collect()) == [(1, "01", "1"), (2, "1", "2")]


@pytest.mark.parametrize("key", [None, ""])
def test_rows_without_a_key_are_not_published(spark, tmp_path, key):
    rows = spark.createDataFrame([(1, key, "train")], "id int, config string, split string")
    with pytest.raises(Exception, match="rows without a config"):
        publish(rows, str(tmp_path / "set"))


def test_odd_keys_survive(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "c++/c#", "a=b"), (2, "é x%", "t:1")], "id int, config string, split string"
    )
    publish(rows, str(tmp_path / "set"))
    assert sorted(map(tuple, read_dataset(spark, str(tmp_path / "set")).collect())) == sorted(
        map(tuple, rows.collect())
    )


def test_sweep_file_names_and_types(spark, tmp_path):
    path = tmp_path / "sweep.csv"
    path.write_text(
        '"Name","a.b.kl_coeff","every_n","local-winrate"\n'
        '"run ""1"", [\'x\']","0.03","7","0.5"\n"run 2","1.0","1","0"'
    )
    df = read_sweep(spark, str(path))
    assert df.dtypes == [
        ("Name", "string"), ("a_b_kl_coeff", "double"), ("every_n", "int"),
        ("local_winrate", "double"),
    ]
    assert [tuple(r) for r in df.collect()] == [
        ('run "1", [\'x\']', 0.03, 7, 0.5), ("run 2", 1.0, 1, 0.0),
    ]
    assert clean_name("a.b-c") == "a_b_c"


def test_work_tables_are_released(spark):
    table = storage.materialize(spark.range(10))
    path = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("//", "/")
    from pathlib import Path

    assert table.count() == 10 and Path(path).exists()
    storage.release(spark)
    assert not Path(path).exists()


def test_a_config_is_replaced_as_a_whole(spark, tmp_path):
    root = str(tmp_path / "set")
    rows = spark.createDataFrame(
        [(1, "en", "train"), (2, "en", "validation"), (3, "d/e", "train"), (4, "d/e", "x y")],
        "id int, config string, split string",
    )
    publish(rows, root)
    publish(rows.where("id = 1"), root, scope="configs", parts=[("en", "empty")])
    assert sorted(r.id for r in read_dataset(spark, root).collect()) == [1, 3, 4]
    assert sorted(r.config for r in published_configs(spark, root).collect()) == ["d/e", "en"]
    assert sorted(r.split for r in published_splits(spark, root, "en").collect()) == ["empty", "train"]
    assert sorted(r.split for r in published_splits(spark, root, "d/e").collect()) == ["train", "x y"]
    assert read_dataset(spark, root, "en", "empty").count() == 0
    publish(rows.where("id = 4"), root, scope="configs")
    assert sorted(r.id for r in read_dataset(spark, root).collect()) == [1, 4]


def test_what_is_not_there_is_an_error(spark, tmp_path):
    root = str(tmp_path / "set")
    publish(spark.createDataFrame([(1, "en", "train")], "id int, config string, split string"), root)
    for config, split in (("zz", None), ("en", "tset"), (None, "tset")):
        with pytest.raises(ValueError, match="there are"):
            read_dataset(spark, root, config, split)
    with pytest.raises(ValueError, match="no config"):
        published_splits(spark, root, "zz")


def test_sweep_files_that_do_not_fit(spark, tmp_path):
    path = tmp_path / "lines.csv"
    path.write_text('"a.b","c"\n"one\ntwo","1"\n')
    assert [tuple(r) for r in read_sweep(spark, str(path), multi_line=True).collect()] == [("one\ntwo", 1)]
    path = tmp_path / "names.csv"
    path.write_text('"a.b","a-b"\n"1","2"\n')
    with pytest.raises(ValueError, match="a_b"):
        read_sweep(spark, str(path))


def test_rows_of_one_topic(spark):
    rows = spark.createDataFrame([("SUBREDDIT: r/aww\nx",), ("SUBREDDIT: r/b\ny",)], "p string")
    assert [r.p for r in op.keep_key(rows, "p", "aww").collect()] == ["SUBREDDIT: r/aww\nx"]


def test_names_with_dots(spark):
    rows = spark.createDataFrame([("a", "b")], ["m.1", "m.2"])
    joined = op.cat_columns(rows, ["m.1"], ["m.2"], ["m.3"])
    assert [tuple(r) for r in op.keep_equal(joined, "m.3", "ab").collect()] == [("a", "b", "ab")]


def test_a_scope_deletes_what_was_written_in_it(spark):
    outside = storage.materialize(spark.range(3))
    with storage.work(spark):
        inside = storage.materialize(spark.range(4))
        assert inside.count() == 4
    assert outside.count() == 3
    with pytest.raises(Exception):
        inside.count()
