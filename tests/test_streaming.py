import time

import pytest
from pyspark.sql import functions as F

from pairloom import operators as op
from pairloom.streaming import run_in_batches, write_batches


def shout():
    return lambda prompts: [prompt.upper() for prompt in prompts]


def answer(rows):
    return op.map_generate(rows, "prompt", "answer", shout)


@pytest.fixture
def batches(spark, tmp_path):
    table = spark.range(0, 57, numPartitions=4).select("id", F.concat(F.lit("p"), "id").alias("prompt"))
    folder = str(tmp_path / "batches")
    schema = write_batches(table, folder, ["id"], 10)
    return {"folder": folder, "schema": schema, "out": str(tmp_path / "out"), "checkpoint": str(tmp_path / "check")}


def test_a_file_per_batch(spark, batches):
    rows = spark.read.schema(batches["schema"]).parquet(batches["folder"])
    found = rows.select("id", "batch_id", F.input_file_name().alias("file")).collect()
    assert {(r.id, r.batch_id) for r in found} == {(i, i // 10) for i in range(57)}
    assert len({r.file for r in found}) == 6
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_batches(rows, batches["folder"], ["id"], 10)


def test_all_batches_one_per_trigger(spark, batches):
    query = run_in_batches(spark, work=answer, **batches)
    query.awaitTermination(120)
    assert query.exception() is None
    done = spark.read.parquet(batches["out"]).collect()
    assert {(r.id, r.answer) for r in done} == {(i, f"P{i}") for i in range(57)}
    rows = [progress["numInputRows"] for progress in query.recentProgress if progress["numInputRows"]]
    assert max(rows) <= 10 and sum(rows) == 57 and len(rows) == 6


def test_a_run_that_fails_goes_on_at_the_next_batch(spark, batches, tmp_path):
    """The third batch fails at first; the two before it are not worked off again."""
    log, gone = tmp_path / "log", tmp_path / "gone"
    gone.write_text("")

    def flaky(rows):
        def make(log=str(log), gone=str(gone)):
            import os

            def reply(prompts):
                with open(log) as file:
                    done = len(set(file.read().split()))
                if os.path.exists(gone) and done >= 20:
                    raise RuntimeError("over the limit")
                with open(log, "a") as file:
                    file.writelines(prompt + "\n" for prompt in prompts)
                return prompts

            return reply

        return op.map_generate(rows, "prompt", "answer", make, batch_size=100, partitions=1)

    log.write_text("")
    query = run_in_batches(spark, work=flaky, **batches)
    with pytest.raises(Exception, match="over the limit"):
        query.awaitTermination(120)
    assert spark.read.parquet(batches["out"]).count() == 20
    gone.unlink()
    run_in_batches(spark, work=flaky, **batches).awaitTermination(120)
    done = spark.read.parquet(batches["out"])
    assert done.count() == 57 and done.select("id").distinct().count() == 57
    assert len(log.read_text().split()) == 57


def test_batches_keep_their_distance(spark, batches):
    query = run_in_batches(spark, work=lambda rows: rows, every="3 seconds", **batches)
    try:
        started = time.time()
        while len([p for p in query.recentProgress if p["numInputRows"]]) < 3 and time.time() - started < 60:
            time.sleep(0.1)
        took = time.time() - started
    finally:
        query.stop()
    assert took >= 5
    assert spark.read.parquet(batches["out"]).count() <= 40


def test_triggers_take_several_batches(spark, batches):
    query = run_in_batches(spark, work=lambda rows: rows, per_trigger=2, **batches)
    query.awaitTermination(120)
    rows = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert len(rows) == 3 and max(rows) == 20 and sum(rows) == 57
    done = spark.read.parquet(batches["out"])
    assert done.count() == 57 and done.select("id").distinct().count() == 57
    with pytest.raises(ValueError, match="per_trigger"):
        run_in_batches(spark, work=lambda rows: rows, per_trigger=0, **batches)
