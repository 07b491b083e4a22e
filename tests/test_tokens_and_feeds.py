import pytest
from pyspark.sql import functions as F

from pairloom import operators as op
from pairloom.operators import tokens
from pairloom.operators.tokens import BOS_ID, EOS_ID, FIRST_ID, UNKNOWN_ID
from pairloom.plans import recipes


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(
        [(1, "b a  a\n", "c"), (2, "", "a"), (3, "zz \t b", " ")], "id int, x string, y string"
    )


def test_vocabulary_counts_all_columns_and_breaks_ties_by_word(texts):
    rows = op.build_vocab(texts, ["x", "y"], 3).orderBy("id").collect()
    assert [(r.token, r.n, r.id) for r in rows] == [
        ("a", 3, FIRST_ID), ("b", 2, FIRST_ID + 1), ("c", 1, FIRST_ID + 2),
    ]
    with pytest.raises(ValueError):
        op.build_vocab(texts, ["x"], 0)


def test_ids_and_masks(texts):
    vocab = op.build_vocab(texts, ["x", "y"], 2)
    rows = op.encode_tokens(texts, ["x", "y"], vocab, ["xi", "yi"], ["xm", "ym"]).collect()
    a, b = FIRST_ID, FIRST_ID + 1
    wanted = {1: [b, a, a], 2: [], 3: [UNKNOWN_ID, b]}
    for row in rows:
        assert row.xi == [BOS_ID, *wanted[row.id], EOS_ID] and row.xm == [1] * len(row.xi)
        assert row.ym == [1] * len(row.yi)
        assert len(row.yi) == len(row.ym)
    plain = op.encode_tokens(texts, ["x"], vocab, ["i"], ["m"], add_special_tokens=False)
    assert {r.id: r.i for r in plain.collect()} == wanted


def test_words_are_looked_up_once_and_without_a_shuffle(texts, plan_of):
    vocab = op.build_vocab(texts, ["x"], 9)
    rows = op.encode_tokens(texts, ["x"], vocab, ["i"], ["m"])
    plan = plan_of(op.limit_length(rows, ["i"], 4, "drop"))
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_null_text(spark, texts):
    vocab = op.build_vocab(texts, ["x"], 9)
    rows = spark.createDataFrame([(None,), ("a",)], "x string")
    with pytest.raises(Exception, match="null input"):
        op.encode_tokens(rows, ["x"], vocab, ["i"], ["m"]).collect()
    kept = op.encode_tokens(rows, ["x"], vocab, ["i"], ["m"], on_null="propagate")
    assert {r.x: (r.i, r.m) for r in kept.collect()}[None] == (None, None)
    own = op.tokenize_with(
        rows, ["x"], lambda: lambda texts: [[7] for _ in texts], ["i"], ["m"], on_null="propagate"
    )
    assert {r.x: (r.i, r.m) for r in own.collect()} == {None: (None, None), "a": ([7], [1])}


def test_encoding_equals_a_plain_lookup_on_whole_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    vocab = op.build_vocab(docs, ["text"], 300)
    known = {r.token: r.id for r in vocab.collect()}
    assert len(known) == 300
    rows = op.encode_tokens(docs, ["text"], vocab, ["i"], ["m"], add_special_tokens=False).collect()
    for row in rows:
        words = row.text.replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ")
        assert row.i == [known.get(w, UNKNOWN_ID) for w in words if w]


def test_own_tokenizer(spark):
    def make():
        return lambda texts: [[ord(c) for c in text] for text in texts]

    rows = spark.createDataFrame([("ab",), ("",)], "x string")
    got = op.tokenize_with(rows, ["x"], make, ["i"], ["m"])
    ended = op.with_special_ids(got, "i", "m", eos=9).collect()
    assert [(r.i, r.m) for r in ended] == [([97, 98, 9], [1, 1, 1]), ([9], [1])]


def test_subword_tokenizer(spark):
    pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path
    file = path("byte_bpe_50k.json")

    def make():
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(file)
        return lambda texts: [e.ids for e in tokenizer.encode_batch(texts)]

    docs = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = op.tokenize_with(docs, ["text"], make, ["i"], ["m"]).collect()
    encode = make()
    assert all(r.i == encode([r.text])[0] and len(r.m) == len(r.i) for r in got)


def test_special_ids_on_both_ends(spark):
    row = spark.createDataFrame([([5, 6], [1, 1])], "i array<int>, m array<int>")
    both = op.with_special_ids(row, "i", "m", bos=1, eos=2).first()
    assert (both.i, both.m) == ([1, 5, 6, 2], [1, 1, 1, 1])
    assert op.with_special_ids(row, "i", "m").first().i == [5, 6]


def test_length_limits(spark):
    rows = spark.createDataFrame([([1, 2, 3], [1]), ([1], [1, 2])], "a array<int>, b array<int>")
    cut = op.limit_length(rows, ["a", "b"], 2)
    assert sorted((r.a, r.b) for r in cut.collect()) == [([1], [1, 2]), ([1, 2], [1])]
    assert [r.a for r in op.limit_length(rows, ["a", "b"], 2, "drop").collect()] == [[1]]
    with pytest.raises(ValueError):
        op.limit_length(rows, ["a"], 2, "wrap")


def test_training_view(spark):
    rows = spark.range(100).select(
        "id", F.when(F.col("id") % 4 == 0, "validation").when(F.col("id") % 4 == 1, "test")
        .otherwise("train").alias("split"),
    )
    view = op.training_view(rows, {"train": 20, "validation": 5}, ["id"]).collect()
    train = [i for i in range(100) if i % 4 > 1][:20]
    assert sorted(r.id for r in view) == sorted([*train, 0, 4, 8, 12, 16])
    with pytest.raises(ValueError, match="51 train rows"):
        op.training_view(rows, {"train": 51}, ["id"])
    assert op.training_view(rows, {"train": 51}, ["id"], strict=False).count() == 50
    assert op.training_view(rows, {"train": 0, "test": None}, ["id"]).count() == 25
    assert op.training_view(rows, {}, ["id"]).count() == 0


def test_sft_and_ppo_rows_do_not_overlap(spark):
    rows = spark.range(200).select("id", F.when(F.col("id") < 150, "train").when(
        F.col("id") < 180, "validation").otherwise("test").alias("split"))
    sft = recipes.sft_rows(rows, ["id"], 60, 10)
    ppo = recipes.ppo_rows(rows, ["id"], (60, 150))
    part = lambda df: df.where("split = 'train'")
    assert part(sft).count() == 60 and part(ppo).count() == 90
    assert part(sft).join(part(ppo), "id").count() == 0
    assert sft.where("split = 'test'").count() == ppo.where("split = 'test'").count() == 20
    assert sft.where("split = 'validation'").count() == 10
    assert recipes.SFT_TRAIN_ROWS == recipes.PPO_TRAIN_RANGE[0]


def test_feeds_cap_rows_and_lengths(spark):
    rows = spark.range(30).select(
        "id", F.when(F.col("id") < 20, "train").otherwise("validation").alias("split"),
        F.sequence(F.lit(0), F.col("id")).alias("a"), F.array(F.lit(1)).alias("b"),
    )
    caps = {"train": 10, "validation": 5}
    cut = recipes.sft_feed(rows, ["id"], ["a"], caps, tokens=4).collect()
    assert sorted(r.id for r in cut) == [*range(10), *range(20, 25)]
    assert max(len(r.a) for r in cut) == 4
    kept = recipes.reward_feed(rows, ["id"], ["a", "b"], caps, tokens=4).collect()
    assert sorted(r.id for r in kept) == [0, 1, 2, 3]
    assert recipes.sft_feed(rows, ["id"], caps=caps).count() == 15
    with pytest.raises(ValueError, match="70000 train rows"):
        recipes.multilingual_reward_feed(rows, ["id"])


@pytest.mark.parametrize("options", [
    {}, {"max_words": 5}, {"max_words": 40, "on_long": "drop"}, {"on_null": "propagate"},
])
def test_a_vocabulary_too_large_to_ship_is_joined_with_the_same_result(spark, options, monkeypatch):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select(
        "item_id", "text", F.concat("text", F.lit(" tail unknown")).alias("other")
    )
    if options.get("on_null"):
        docs = docs.withColumn("text", F.when(F.col("item_id") > 3, F.col("text")))
    docs = docs.unionByName(spark.createDataFrame([(900, "", " ")], docs.schema))
    vocab = op.build_vocab(docs, ["text"], 50)

    def encoded():
        rows = op.encode_tokens(docs, ["text", "other"], vocab, ["a", "b"], ["am", "bm"], **options)
        return sorted(map(tuple, rows.select("item_id", "a", "am", "b", "bm").collect()), key=repr)

    shipped = encoded()
    monkeypatch.setattr(tokens, "SHIPPED", 20)
    assert encoded() == shipped and shipped


def test_a_vocabulary_ranked_in_one_task_or_in_many(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    one = sorted(map(tuple, op.build_vocab(docs, ["text"], 80).collect()))
    monkeypatch.setattr(tokens, "RANKED", 10)
    assert sorted(map(tuple, op.build_vocab(docs, ["text"], 80).collect())) == one and len(one) == 80
