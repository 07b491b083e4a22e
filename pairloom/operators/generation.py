"""A model called from a Spark job: once per row, in batches, one model per task.

No model is shipped. The caller passes ``make_fn``, a function without arguments that runs inside
the task (so the model is loaded there) and returns a function from a list of prompts to a list of
answers. Only the prompt column crosses into Python; the other columns stay in the JVM.

The column is marked non-deterministic: Spark then neither moves nor repeats the call within a
plan. Two plans still mean two calls; :func:`pairloom.storage.materialize` the result between, or pass an
:class:`~pairloom.operators.answers.AnswerStore`: with it no prompt is asked twice, in this run or a later one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.checks import fresh, named, need_columns, reject_nulls
from pairloom.functions.text import parse_verdict, render_template
from pairloom.operators.answers import AnswerStore, answer_once

TextFn = Callable[[list], list]
MakeFn = Callable[[], TextFn]


def _generator(
    spark: SparkSession, names: list[str], load: Callable[[], dict[str, TextFn]], batch_size: int,
    chat: bool, system: str | None,
) -> Callable[[Column], Column]:
    """One call over the prompt column that fills a struct with a field per model.

    What runs in a task is nested here, so that it travels with the job. A worker keeps a broadcast value
    from task to task, and with it the models that were loaded into it.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    schema = ", ".join(f"`{name}` string" for name in names)
    held = spark.sparkContext.broadcast({})
    head = [] if system is None else [{"role": "system", "content": system}]

    def answers(fn, prompts):
        """Answers to prompts, none of them null, in batches."""
        for at in range(0, len(prompts), batch_size):
            batch = prompts[at : at + batch_size]
            if chat:
                batch = [[*head, {"role": "user", "content": prompt}] for prompt in batch]
            replies = list(fn(batch))
            if len(replies) != len(batch):
                raise ValueError(f"{len(batch)} prompts gave {len(replies)} answers")
            yield from (reply[-1]["content"] if chat else reply for reply in replies)

    def generate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if not held.value:
            held.value.update(load())
        for batch in batches:
            there = batch.notna()
            prompts = batch[there].tolist()
            frame = pd.DataFrame(index=batch.index, columns=names, dtype="object")
            for name in names:
                frame.loc[there, name] = list(answers(held.value[name], prompts))
            yield frame.where(frame.notna(), None)

    return F.pandas_udf(generate, schema).asNondeterministic()


def _tasks(spark: SparkSession, least: int) -> int:
    """Tasks to spread prompts over: a set number alone would let each one's share grow with the table."""
    return least if least == 1 else max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def map_generate_many(
    df: DataFrame,
    prompt: Column | str,
    make_fns: dict[str, MakeFn] | tuple[Sequence[str], Callable[[], Sequence[TextFn]]],
    batch_size: int = 8,
    chat: bool = False,
    system: str | None = None,
    on_null: str = "error",
    partitions: int | None = None,
    store: AnswerStore | None = None,
) -> DataFrame:
    """Add one column of answers per model, in a single pass over the prompts.

    ``make_fns`` has a loader per column, or is the columns' names and one loader that returns a function
    for each: several settings of a model that is loaded once. A Python worker loads once, however
    many tasks it runs. ``partitions`` spreads the prompts over at least so many tasks by their hash, as many as
    other shuffles have if that is more; 1 leaves them in one. With a ``store`` only prompts are asked that
    it has no answer to, at once, not when the result is read.
    """
    text = named(prompt) if isinstance(prompt, str) else prompt
    if isinstance(make_fns, dict):
        names, loaders = list(make_fns), dict(make_fns)
        load = lambda: {name: make() for name, make in loaders.items()}
    else:
        names, make_all = list(make_fns[0]), make_fns[1]
        load = lambda: dict(zip(names, make_all(), strict=True))

    def ask(rows: DataFrame, column: Column, own: Sequence[str]) -> DataFrame:
        generate = _generator(df.sparkSession, list(own), load, batch_size, chat, system)
        if partitions is not None:
            rows = rows.repartition(_tasks(rows.sparkSession, partitions), F.xxhash64(column))
        held = fresh(rows, "_answers")
        answered = rows.withColumn(held, generate(column))
        return answered.select(
            *(named(name) for name in rows.columns if name not in own),
            *(F.col(held).getField(name).alias(name) for name in own),
        )

    checked = reject_nulls(text, [text], on_null, "prompt")
    if store is None:
        return ask(df, checked, names)
    return answer_once(
        df, checked, names, lambda rows, own: ask(rows, F.col("prompt"), own), store, chat, system
    )


def map_generate(
    df: DataFrame,
    prompt: Column | str,
    out: str,
    make_fn: MakeFn,
    batch_size: int = 8,
    chat: bool = False,
    system: str | None = None,
    on_null: str = "error",
    partitions: int | None = None,
    store: AnswerStore | None = None,
) -> DataFrame:
    """Add a column of answers to the prompts.

    With ``chat`` the function gets message lists (the prompt as user message, after ``system`` if
    given) and returns message lists; the last message's content is kept. Without it the function
    goes from text to text, and by convention its answer starts with the prompt.
    """
    return map_generate_many(
        df, prompt, {out: make_fn}, batch_size, chat, system, on_null, partitions, store
    )


def candidate_pairs(
    df: DataFrame,
    text: str,
    make_a: MakeFn | None = None,
    make_b: MakeFn | None = None,
    out: tuple[str, str] = ("summary_a", "summary_b"),
    batch_size: int = 8,
    chat: bool = False,
    system: str | None = None,
    make_both: Callable[[], Sequence[TextFn]] | None = None,
    partitions: int | None = None,
    store: AnswerStore | None = None,
) -> DataFrame:
    """Two answers to every text, under two settings of a model, in one pass.

    ``make_both`` loads one model and returns the functions of both settings; ``make_a`` and ``make_b``
    load one each.
    """
    need_columns(df, text)
    if (make_both is None) == (make_a is None or make_b is None):
        raise ValueError("give make_both, or make_a and make_b")
    loaders = (out, make_both) if make_both is not None else {out[0]: make_a, out[1]: make_b}
    return map_generate_many(
        df, text, loaders, batch_size, chat, system, partitions=partitions, store=store
    )


def map_judge(
    df: DataFrame,
    template: str,
    make_fn: MakeFn,
    text: str = "text",
    response0: str = "response0",
    response1: str = "response1",
    out: str = "rank",
    batch_size: int = 8,
    chat: bool = False,
    system: str | None = None,
    partitions: int | None = None,
    store: AnswerStore | None = None,
) -> DataFrame:
    """Ask a model which response is better: 0, 1, or -1 if its answer names neither.

    With ``chat`` the question is a user message. Without it the answer may start with the question,
    which is cut off first: its own last character is no verdict. A ``store`` has the settings under ``out``.
    """
    need_columns(df, text, response0, response1)
    question = render_template(template, text=text, response0=response0, response1=response1)
    asked, verdict = fresh(df, "_question"), fresh(df, "_verdict")
    if store is not None and out in store.settings:
        store = replace(store, settings={verdict: store.settings[out]})
    answered = map_generate(
        df.withColumn(asked, question), asked, verdict, make_fn, batch_size, chat, system,
        partitions=partitions, store=store,
    )
    echoed = ~F.lit(chat) & F.startswith(verdict, asked)
    answer = F.when(echoed, F.substr(verdict, F.length(asked) + 1)).otherwise(F.col(verdict))
    return answered.withColumn(out, parse_verdict(answer)).drop(asked, verdict)


def comparison_table(
    df: DataFrame,
    prompt: str,
    answers: dict[str, MakeFn | Column],
    batch_size: int = 32,
    store: AnswerStore | None = None,
) -> DataFrame:
    """The prompt beside one column per contender: a model, or a column already at hand."""
    need_columns(df, prompt)
    ready = {name: answer for name, answer in answers.items() if isinstance(answer, Column)}
    models = {name: answer for name, answer in answers.items() if name not in ready}
    table = df.select(F.col(prompt), *(answer.alias(name) for name, answer in ready.items()))
    if models:
        table = map_generate_many(table, prompt, models, batch_size, store=store)
    return table.select(F.col(prompt), *map(named, answers))
