import pytest

from pairloom import operators as op


@pytest.fixture
def pairs(spark):
    return spark.createDataFrame(
        [("p", "c", "r"), ("", "x", "y")], "prompt string, chosen string, rejected string"
    )


def test_drop_needs_the_column(pairs):
    assert op.drop_columns(pairs, "chosen").columns == ["prompt", "rejected"]
    with pytest.raises(ValueError):
        op.drop_columns(pairs, "chosen", "nothing")


def test_target_may_be_the_right_side(pairs):
    out = op.cat_columns(pairs, ["prompt", "prompt"], ["chosen", "rejected"], ["chosen", "rejected"])
    assert [tuple(row) for row in out.collect()] == [("p", "pc", "pr"), ("", "x", "y")]


def test_pairs_run_in_order_and_surplus_names_are_ignored(pairs):
    out = op.cat_columns(
        pairs, ["prompt", "chosen", "rejected"], ["chosen", "rejected"], ["chosen", "all", "x"]
    )
    assert out.columns == ["prompt", "chosen", "rejected", "all"]
    assert out.first().all == "pcr"


def test_arrays_are_joined_too(spark):
    lists = spark.createDataFrame([([1], [2, 3])], "a array<int>, b array<int>")
    assert op.cat_columns(lists, ["a"], ["b"], ["c"]).first().c == [1, 2, 3]


def test_null_fails_unless_told_otherwise(spark):
    table = spark.createDataFrame([("a", None)], "x string, y string")
    with pytest.raises(Exception, match="null input"):
        op.cat_columns(table, ["x"], ["y"], ["z"]).collect()
    assert op.cat_columns(table, ["x"], ["y"], ["z"], "propagate").first().z is None
    with pytest.raises(Exception, match="null input"):
        op.append_suffix(table, "y").collect()
    with pytest.raises(ValueError):
        op.append_suffix(table, "x", on_null="ignore")


def test_suffix(pairs):
    assert op.append_suffix(pairs, "prompt").first().prompt == "p\n\nTL;DR: "
    assert op.append_suffix(pairs, "prompt", "!").first().prompt == "p!"


def test_renames(pairs):
    assert op.select_as(pairs, {"chosen": "a", "prompt": "b"}).columns == ["a", "b"]
    assert op.rename_columns(pairs, {"chosen": "a"}).columns == ["prompt", "a", "rejected"]
    with pytest.raises(ValueError):
        op.rename_columns(pairs, {"nothing": "a"})


def test_filters_and_missing_values(spark):
    table = spark.createDataFrame([(1.0,), (0.2,), (None,), (float("nan"),)], "v double")
    single, rest = op.single_vs_rest(table, "v", 1.0)
    assert (single.count(), rest.count()) == (1, 3)
    assert op.drop_values(table, "v", [1.0]).count() == 3
    assert op.keep_values(table, "v", [1.0, 0.2]).count() == 2
    assert op.keep_equal(table, "v", 0.2).count() == 1


def test_filters_reach_the_scan(spark, plan_of):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = plan_of(op.keep_equal(docs, "lang", "de").select("doc_id"))
    assert "EqualTo(lang,de)" in plan and "ReadSchema: struct<doc_id:bigint,lang:string>" in plan


def test_tables_are_put_together_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([("y", 2)], "s string, n int")
    assert [tuple(r) for r in op.concat_tables(a, b, a).collect()] == [(1, "x"), (2, "y"), (1, "x")]
    with pytest.raises(ValueError):
        op.concat_tables(a, b.withColumnRenamed("s", "t"))
    with pytest.raises(ValueError):
        op.concat_tables(a, b.selectExpr("s", "cast(n as bigint) n"))
    with pytest.raises(ValueError):
        op.concat_tables()
    wide = op.concat_tables(a, b.drop("s"), allow_missing=True)
    assert [tuple(r) for r in wide.collect()] == [(1, "x"), (2, None)]


def test_splits(spark):
    a = spark.createDataFrame([(1,)], "n int")
    both = op.bundle_splits({"train": a, "test": a})
    assert sorted(tuple(r) for r in both.collect()) == [(1, "test"), (1, "train")]
    folded = op.fold_splits(both, {"test": "validation"})
    assert sorted(r.split for r in folded.collect()) == ["train", "validation"]
