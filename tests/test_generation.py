import pytest
from pyspark.sql import functions as F

from pairloom import operators as op
from pairloom.plans import recipes, stand_ins


@pytest.fixture
def prompts(spark):
    return spark.range(0, 57, numPartitions=3).select(
        F.col("id"), F.concat(F.lit("p"), "id").alias("prompt"), F.lit("x").alias("completion"),
        F.lit("test").alias("split"),
    )


def counting(loads, calls, sizes):
    def make():
        loads.add(1)

        def answer(batch):
            calls.add(len(batch))
            sizes.add(1 if len(batch) > 8 else 0)
            return [text + "!" for text in batch]

        return answer

    return make


def test_one_call_per_row_one_model_per_task_and_bounded_batches(spark, prompts):
    loads, calls, sizes = (spark.sparkContext.accumulator(0) for _ in range(3))
    df = op.map_generate(prompts, "prompt", "answer", counting(loads, calls, sizes), batch_size=8)
    # The answer is used twice and filtered on; it must still be asked for once.
    used = df.where(F.col("answer") != "p3!").select(
        "id", F.upper("answer").alias("up"), F.concat("answer", "answer").alias("twice")
    )
    rows = {r.id: (r.up, r.twice) for r in used.collect()}
    assert len(rows) == 56 and rows[5] == ("P5!", "p5!p5!")
    assert (loads.value, calls.value, sizes.value) == (3, 57, 0)


def test_chat_mode_wraps_the_prompt_and_keeps_the_last_message(prompts):
    def make():
        def answer(chats):
            return [
                [*chat, {"role": "assistant", "content": "/".join(m["content"] for m in chat)}]
                for chat in chats
            ]

        return answer

    df = op.map_generate(prompts, "prompt", "answer", make, chat=True, system="s")
    assert df.where("id = 4").first().answer == "s/p4"


def test_a_model_that_loses_answers_fails(prompts):
    with pytest.raises(Exception, match="answers"):
        op.map_generate(prompts, "prompt", "a", lambda: lambda batch: batch[1:]).collect()
    with pytest.raises(ValueError):
        op.map_generate(prompts, "prompt", "a", lambda: list, batch_size=0)


def test_null_prompts(spark):
    rows = spark.createDataFrame([("a",), (None,)], "prompt string")
    with pytest.raises(Exception, match="null input"):
        op.map_generate(rows, "prompt", "a", lambda: list).collect()
    kept = op.map_generate(
        rows, "prompt", "a", lambda: lambda batch: [text + "!" for text in batch],
        on_null="propagate",
    )
    assert {r.prompt: r.a for r in kept.collect()} == {"a": "a!", None: None}


def test_two_settings_in_one_pass(spark, prompts, plan_of):
    pairs = op.candidate_pairs(
        prompts, "prompt", stand_ins.digest_model("a"), stand_ins.digest_model("b")
    )
    assert plan_of(pairs).count("ArrowEvalPython") == 1
    row = pairs.first()
    assert row.summary_a != row.summary_b


def test_answers_may_replace_a_column(prompts):
    df = op.map_generate(prompts, "prompt", "completion", lambda: lambda b: [t[::-1] for t in b])
    assert df.where("id = 12").first().completion == "21p"
    assert df.columns.count("completion") == 1


def test_comparison_columns_keep_their_order_and_dots(prompts):
    table = op.comparison_table(prompts, "prompt", {
        "Model-3.1": stand_ins.digest_model("l"), "human": F.col("completion"),
        "other": stand_ins.digest_model("r"),
    })
    assert table.columns == ["prompt", "Model-3.1", "human", "other"]
    assert table.count() == 57


def test_comparison_recipes(prompts):
    both = recipes.model_comparison(
        prompts, ["id"], {"x/left": stand_ins.digest_model("l"), "y/right": stand_ins.digest_model("r")},
        rows=10,
    )
    assert both.columns == ["prompt", "left", "right"] and both.count() == 10
    human = recipes.human_comparison(
        prompts, ["id"], "x/model.v1", stand_ins.digest_model("m", echo=True), rows=10
    )
    row = human.where("id = 7").first()
    assert row.human == "p7x" and row["model.v1"].startswith("p7")
    with pytest.raises(ValueError):
        recipes.model_comparison(prompts, ["id"], {"x/left": stand_ins.digest_model("l")})


def test_one_model_for_both_settings_kept_by_the_worker(spark, tmp_path):
    import os

    folder = str(tmp_path)

    def make_both():
        import tempfile

        tempfile.mkstemp(prefix=f"{os.getpid()}-", dir=folder)
        return [lambda texts: [t + "0" for t in texts], lambda texts: [t + "1" for t in texts]]

    rows = spark.range(40, numPartitions=20).selectExpr("cast(id as string) AS text")
    got = op.candidate_pairs(rows, "text", make_both=make_both, partitions=16).collect()
    assert sorted((r.summary_a, r.summary_b) for r in got) == sorted((f"{i}0", f"{i}1") for i in range(40))
    loads = [name.split("-")[0] for name in os.listdir(folder)]
    assert len(loads) == len(set(loads))


def test_an_empty_answer_is_no_verdict(spark):
    rows = spark.createDataFrame([("t", "a", "b")], "text string, response0 string, response1 string")
    echo = lambda: (lambda prompts: list(prompts))
    template = "{text} {response0} {response1} 0 or 1"
    assert [r.rank for r in op.map_judge(rows, template, echo).collect()] == [-1]

    def chat_judge():
        return lambda chats: [
            [*c, {"role": "assistant", "content": "1" if c[0]["role"] == "system" else "0"}] for c in chats
        ]

    assert [r.rank for r in op.map_judge(rows, template, chat_judge, chat=True, system="s").collect()] == [1]
    assert [r.rank for r in op.map_judge(rows, template, chat_judge, chat=True).collect()] == [0]


def test_prompts_are_spread_as_wide_as_other_shuffles(spark):
    prompts = spark.range(4000).select(F.md5(F.col("id").cast("string")).alias("prompt"))
    at = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for partitions, tasks in ((1, 1), (2, at), (at + 5, at + 5)):
        got = op.map_generate(prompts, "prompt", "answer", lambda: list, partitions=partitions)
        assert got.select(F.spark_partition_id()).distinct().count() == tasks
        assert got.where("answer = prompt").count() == 4000
