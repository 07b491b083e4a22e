import pytest

from pairloom.sources import datasets
from pairloom.sources import contents, prune, publish, published_configs, published_splits, read_dataset

SCHEMA = "id int, config string, split string"


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(
        [(1, "en", "train"), (2, "en", "test"), (3, "de", "train"), (4, "x/y=%", "a b")], SCHEMA
    )


def ids(df):
    return sorted(row.id for row in df.collect())


@pytest.fixture(params=["rows", "empty part", "list"])
def breaking(request, monkeypatch):
    """A publication that dies in one of its steps; called with its arguments."""

    def run(*args, **options):
        with monkeypatch.context() as patch:
            if request.param == "rows":
                import pyspark.sql.functions as F

                args = (args[0].withColumn("id", F.when(args[0].id > 0, F.raise_error(F.lit("lost"))).cast("int")), *args[1:])
            elif request.param == "empty part":
                options["parts"] = [("zz", "train"), ("zz", None)]
            else:
                def lost(*_):
                    raise RuntimeError("lost")

                patch.setattr(datasets, "_add_list", lost)
            with pytest.raises(Exception):
                publish(*args, **options)

    return run


@pytest.mark.parametrize("scope", ["dataset", "configs", "parts"])
def test_a_failure_leaves_the_dataset_as_it_was(spark, rows, tmp_path, breaking, scope):
    root = str(tmp_path / "set")
    publish(rows, root)
    breaking(spark.createDataFrame([(9, "en", "train")], SCHEMA), root, scope=scope)
    assert ids(read_dataset(spark, root)) == [1, 2, 3, 4]
    assert sorted(r.config for r in published_configs(spark, root).collect()) == ["de", "en", "x/y=%"]
    assert publish(spark.createDataFrame([(9, "en", "train")], SCHEMA), root, scope=scope) == 2
    wanted = {"dataset": [9], "configs": [3, 4, 9], "parts": [2, 3, 4, 9]}[scope]
    assert ids(read_dataset(spark, root)) == wanted


def test_a_first_publication_that_fails_is_nothing(spark, rows, tmp_path, breaking):
    root = str(tmp_path / "set")
    breaking(rows, root)
    assert contents(spark, root) is None
    assert published_configs(spark, root).collect() == []
    publish(rows, root)
    assert ids(read_dataset(spark, root)) == [1, 2, 3, 4]


def test_a_reader_keeps_what_it_has_resolved(spark, rows, tmp_path):
    root = str(tmp_path / "set")
    publish(rows, root)
    before = read_dataset(spark, root)
    publish(rows.where("id = 3"), root)
    assert ids(before) == [1, 2, 3, 4] and ids(read_dataset(spark, root)) == [3]
    assert ids(read_dataset(spark, root, version=1)) == [1, 2, 3, 4]
    with pytest.raises(ValueError, match="no version 7"):
        read_dataset(spark, root, version=7)


def test_a_dataset_may_be_made_from_itself(spark, rows, tmp_path):
    root = str(tmp_path / "set")
    publish(rows, root)
    publish(read_dataset(spark, root).where("id <> 2"), root)
    publish(read_dataset(spark, root, "en").selectExpr("id + 10 AS id", "config", "split"), root, scope="configs")
    assert ids(read_dataset(spark, root)) == [3, 4, 11]


def test_kept_parts_are_not_copied(spark, rows, tmp_path):
    root = str(tmp_path / "set")
    publish(rows, root)
    first = contents(spark, root)
    publish(rows.where("id = 1"), root, scope="parts")
    second = contents(spark, root)
    moved = {part for part in first.holders if first.holders[part] != second.holders[part]}
    assert moved == {"config=en/split=train"} and second.version == 2


def test_publications_at_once_both_stay_whole(spark, rows, tmp_path, monkeypatch):
    """Both saw the same version before: one of them is the newest to all readers."""
    root = str(tmp_path / "set")
    publish(rows, root)
    seen = contents(spark, root)
    monkeypatch.setattr(datasets, "contents", lambda *_: seen)
    publish(rows.where("id = 1"), root)
    publish(rows.where("id in (2, 3)"), root)
    monkeypatch.undo()
    assert ids(read_dataset(spark, root)) in ([1], [2, 3])


def test_new_columns_beside_kept_parts(spark, rows, tmp_path):
    root = str(tmp_path / "set")
    publish(rows, root)
    publish(rows.where("id = 1").selectExpr("*", "'new' AS note"), root, scope="parts")
    back = read_dataset(spark, root)
    assert {(r.id, r.note) for r in back.collect()} == {(1, "new"), (2, None), (3, None), (4, None)}
    assert read_dataset(spark, root, "de").columns == ["id", "config", "split"]


def test_prune_deletes_what_no_kept_version_names(spark, rows, tmp_path):
    root = str(tmp_path / "set")
    for wanted in ("true", "id = 1", "id > 2"):
        publish(rows.where(wanted), root, scope="dataset" if wanted == "true" else "parts")
    assert prune(spark, root, keep=2) == []
    publish(rows.where("id = 2"), root)
    gone = prune(spark, root)
    assert len(gone) == 3 and ids(read_dataset(spark, root)) == [2]
    with pytest.raises(ValueError):
        prune(spark, root, keep=0)


def test_empty_tables_and_no_keys(spark, rows, tmp_path):
    root = str(tmp_path / "none")
    publish(rows.limit(0), root, parts=[("en", "train")])
    assert [r.split for r in published_splits(spark, root, "en").collect()] == ["train"]
    assert read_dataset(spark, root).columns == ["id", "config", "split"] and ids(read_dataset(spark, root)) == []
    publish(rows.limit(0), root)
    assert published_configs(spark, root).collect() == []
    with pytest.raises(ValueError, match="give a schema"):
        read_dataset(spark, root)
    assert ids(read_dataset(spark, root, schema=rows.schema)) == []
    plain = str(tmp_path / "plain")
    publish(rows, plain, keys=())
    assert ids(read_dataset(spark, plain, keys=())) == [1, 2, 3, 4]


def test_folders_without_a_manifest(spark, rows, tmp_path):
    root = str(tmp_path / "other")
    rows.write.partitionBy("config", "split").parquet(root)
    assert ids(read_dataset(spark, root)) == [1, 2, 3, 4] and ids(read_dataset(spark, root, "en")) == [1, 2]
    assert ids(read_dataset(spark, root, "x/y=%", "a b")) == [4]
    assert sorted(r.split for r in published_splits(spark, root, "en").collect()) == ["test", "train"]
    with pytest.raises(ValueError, match="no config 'zz'"):
        read_dataset(spark, root, "zz")
    with pytest.raises(ValueError, match="as a whole first"):
        publish(rows, root, scope="parts")


def test_a_store_that_only_spark_reads(spark, rows, tmp_path):
    """Reading and listing work through a mount that no path of this machine has."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.sets.link./in", f"file://{tmp_path}")
    root = "viewfs://sets/in/set"
    publish(rows, root)
    publish(rows.where("id = 1").selectExpr("id + 4 AS id", "config", "split"), root, scope="parts")
    assert ids(read_dataset(spark, root)) == [2, 3, 4, 5]
    assert ids(read_dataset(spark, root, "x/y=%", "a b")) == [4]
    assert sorted(r.config for r in published_configs(spark, root).collect()) == ["de", "en", "x/y=%"]
