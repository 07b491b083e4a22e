import pytest
from pyspark.sql import functions as F

from pairloom import operators as op
from pairloom.operators.answers import AnswerStore


@pytest.fixture
def prompts(spark):
    return spark.range(0, 90, numPartitions=3).select(
        F.col("id"), F.concat(F.lit("p"), (F.col("id") % 60).cast("string")).alias("prompt"),
        F.lit("own").alias("_prompt_hash"), F.lit("own").alias("part"),
    )


def recording(path, suffix="!", fails=None):
    """Answers and notes each prompt in a file; fails on a prompt if told to."""

    def make():
        def answer(batch):
            if fails is not None and fails in batch:
                raise RuntimeError("the model is gone")
            with open(path, "a") as file:
                file.writelines(text + suffix + "\n" for text in batch)
            return [text + suffix for text in batch]

        return answer

    return make


def asked(path):
    return path.read_text().split("\n")[:-1] if path.exists() else []


def test_a_prompt_is_asked_once_over_all_runs(spark, prompts, tmp_path):
    store = AnswerStore(str(tmp_path / "store"), {"answer": {"model": "m", "temperature": 0.7}}, parts=3)
    log = tmp_path / "log"
    first = op.map_generate(prompts.where("id < 40"), "prompt", "answer", recording(log), store=store)
    assert {r.id: r.answer for r in first.collect()} == {i: f"p{i}!" for i in range(40)}
    assert sorted(asked(log)) == sorted(f"p{i}!" for i in range(40))
    whole = op.map_generate(prompts, "prompt", "answer", recording(log), store=store)
    assert whole.columns == [*prompts.columns, "answer"]
    assert {r.id: r.answer for r in whole.collect()} == {i: f"p{i % 60}!" for i in range(90)}
    assert sorted(asked(log)) == sorted(f"p{i}!" for i in range(60))
    whole.collect()
    op.map_generate(prompts, "prompt", "answer", recording(log), store=store).collect()
    assert len(asked(log)) == 60


def test_a_run_that_dies_keeps_its_finished_parts(spark, prompts, tmp_path):
    """Prompts of the part in which the model failed are asked again, no others."""
    store = AnswerStore(str(tmp_path / "store"), {"answer": {"model": "m"}}, parts=8)
    log = tmp_path / "log"
    parts = {r.prompt: r.part for r in prompts.select(
        "prompt", F.pmod(F.xxhash64(F.sha2("prompt", 256)), F.lit(8)).alias("part")
    ).distinct().collect()}
    lost = next(prompt for prompt, part in parts.items() if part == 4)
    with pytest.raises(Exception, match="the model is gone"):
        op.map_generate(prompts, "prompt", "answer", recording(log, fails=lost), batch_size=1000, store=store)
    before = set(asked(log))
    kept = {row.prompt_hash for row in store.read(spark, store.about("answer", False, None)).collect()}
    assert {f"{p}!" for p, part in parts.items() if part < 4} <= before
    assert len(kept) == sum(part < 4 for part in parts.values())
    found = op.map_generate(prompts, "prompt", "answer", recording(log), store=store)
    assert {r.id: r.answer for r in found.collect()} == {i: f"p{i % 60}!" for i in range(90)}
    again = asked(log)[len(before):]
    assert sorted(again) == sorted(f"{p}!" for p, part in parts.items() if part >= 4)


def test_other_settings_are_other_answers(spark, prompts, tmp_path):
    log = tmp_path / "log"

    def run(settings, suffix, **options):
        store = AnswerStore(str(tmp_path / "store"), {"answer": settings}, parts=1)
        rows = prompts.where("id < 5")
        return {r.answer for r in op.map_generate(
            rows, "prompt", "answer", recording(log, suffix), store=store, **options
        ).collect()}

    assert run({"model": "m"}, "1") == {f"p{i}1" for i in range(5)}
    assert run({"model": "n"}, "2") == {f"p{i}2" for i in range(5)}
    assert run({"model": "m"}, "3") == {f"p{i}1" for i in range(5)}
    assert len(asked(log)) == 10


def test_several_models_share_a_pass_where_they_can(spark, prompts, tmp_path):
    store = AnswerStore(str(tmp_path / "store"), {"a": {"model": "a"}, "b": {"model": "b"}}, parts=2)
    log = tmp_path / "log"
    op.map_generate(prompts.where("id < 10"), "prompt", "a", recording(log, "A"), store=store)

    def both():
        return [recording(log, "A")(), recording(log, "B")()]

    found = op.candidate_pairs(
        prompts.where("id < 30"), "prompt", make_both=both, out=("a", "b"), store=store
    )
    assert {(r.id, r.a, r.b) for r in found.collect()} == {(i, f"p{i}A", f"p{i}B") for i in range(30)}
    assert sorted(asked(log)) == sorted([f"p{i}A" for i in range(30)] + [f"p{i}B" for i in range(30)])


def test_verdicts_are_kept(spark, tmp_path):
    pairs = spark.createDataFrame([("t", "x", "y"), ("t", "x", "y"), ("u", "x", "y")],
                                  "text string, response0 string, response1 string")
    store, log = AnswerStore(str(tmp_path / "store"), {"rank": {"model": "judge"}}), tmp_path / "log"
    for _ in range(2):
        found = op.map_judge(pairs, "{text} {response0} {response1}", recording(log, " 1"), store=store)
        assert found.columns == [*pairs.columns, "rank"]
        assert [r["rank"] for r in found.collect()] == [1, 1, 1]
    assert len(asked(log)) == 2


def test_nulls_and_empty_tables(spark, prompts, tmp_path):
    store, log = AnswerStore(str(tmp_path / "store"), {"answer": {"model": "m"}}), tmp_path / "log"
    none = spark.createDataFrame([(1, None), (2, "q")], "id int, prompt string")
    with pytest.raises(Exception, match="null input"):
        op.map_generate(none, "prompt", "answer", recording(log), store=store).collect()
    loose = op.map_generate(none, "prompt", "answer", recording(log), on_null="propagate", store=store)
    assert {(r.id, r.answer) for r in loose.collect()} == {(1, None), (2, "q!")}
    assert op.map_generate(none.limit(0), "prompt", "answer", recording(log), store=store).collect() == []
    with pytest.raises(ValueError, match="no settings for 'other'"):
        op.map_generate(none, "prompt", "other", recording(log), store=store)
