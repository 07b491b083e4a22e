"""Token ids and attention masks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.checks import fresh, named, need_choice, need_columns, reject_nulls
from pairloom.operators.rows import row_order
from pairloom.storage import materialize

# Fixed ids, ahead of the vocabulary.
UNKNOWN_ID, BOS_ID, EOS_ID = 0, 1, 2
FIRST_ID = 3

LENGTH_MODES = ("truncate", "drop")

#: Most words of a vocabulary that travels to the tasks, some 10 MB; a larger one is joined.
SHIPPED = 200_000

#: Most words that are ranked in one task, after every other task has sent as many; more are spread.
RANKED = 100_000


def words(column: Column | str) -> Column:
    """The words of a text, cut at blanks, tabs and line ends."""
    text = F.col(column) if isinstance(column, str) else column
    return F.regexp_extract_all(text, F.lit(r"[^ \t\r\n]+"), 0)


def build_vocab(df: DataFrame, columns: list[str], size: int) -> DataFrame:
    """The ``size`` most frequent words of the columns with their ids: ``token, n, id``.

    Frequent words are counted before the shuffle; ties are broken by the word. Up to `RANKED` words each
    task picks its own top ones, which meet in one; the ranking of more is spread over range partitions.
    """
    if size < 1:
        raise ValueError("size must be positive")
    need_columns(df, *columns)
    none = F.array().cast("array<string>")
    every = F.concat(*(F.coalesce(words(column), none) for column in columns))
    found = df.select(F.explode(every).alias("token"))
    counts = found.groupBy("token").agg(F.count("*").alias("n"))
    if size <= RANKED:
        top = materialize(counts.orderBy(F.desc("n"), "token").limit(size), "top-words")
        rank = F.row_number().over(Window.orderBy(F.desc("n"), "token"))
        return top.select("token", "n", (rank - 1 + FIRST_ID).cast("int").alias("id"))
    order = row_order(counts.withColumn("_rarity", -F.col("n")), ["_rarity", "token"])
    return order.numbered("_rank", size).select(
        "token", "n", (F.col("_rank") + FIRST_ID).cast("int").alias("id")
    )


def _vocab_lookup(vocab: DataFrame) -> Callable[[Column], Column]:
    """Ids of word lists by a vocabulary of at most `SHIPPED` words."""
    rows = vocab.select("token", "id").collect()
    # A worker keeps the broadcast value from task to task, and with it the index built here.
    held = vocab.sparkSession.sparkContext.broadcast(
        {"rows": [(row["token"], row["id"]) for row in rows], "index": None}
    )

    def lookup(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if held.value["index"] is None:
            held.value["index"] = dict(held.value["rows"])
        index = held.value["index"]
        for batch in batches:
            flat = batch.flatten().cast(pa.string()).dictionary_encode()
            ids = pa.array([index.get(word, UNKNOWN_ID) for word in flat.dictionary.to_pylist()], pa.int32())
            lengths = pc.fill_null(pc.list_value_length(batch), 0).to_numpy().cumsum()
            offsets = pa.concat_arrays([
                pa.array([0], pa.int32()), pa.array(lengths, pa.int32())
            ])
            yield pa.ListArray.from_arrays(offsets, ids.take(flat.indices), mask=batch.is_null())

    # Non-deterministic in name only: a filter on the ids must not look every word up twice.
    return F.arrow_udf(lookup, "array<int>").asNondeterministic()


def _join_ids(df: DataFrame, lists: dict[str, Column], vocab: DataFrame) -> DataFrame:
    """Add the id list of each word list by a join on the word, for a vocabulary of any size.

    A word is looked up once per row and list; its places come back with its id.
    """

    def word_of(number: int):
        return lambda word, at: F.struct(
            F.lit(number).alias("_list"), at.alias("_at"), word.alias("_token")
        )

    def belongs_to(number: int):
        return lambda place: place["_list"] == number

    row = fresh(df, "_row")
    numbered = df.withColumns(lists).withColumn(row, F.monotonically_increasing_id())
    numbered = materialize(numbered, "rows")
    known = vocab.select(F.col("token").alias("_token"), F.col("id").alias("_id"))
    placed = numbered.select(
        row,
        F.explode(F.concat(*(
            F.transform(
                F.coalesce(named(name), F.array().cast("array<string>")),
                word_of(number),
            )
            for number, name in enumerate(lists)
        ))).alias("_word"),
    ).select(row, "_word.*").groupBy(row, "_token").agg(
        F.collect_list(F.struct("_list", "_at")).alias("_places")
    )
    found = placed.join(known, "_token", "left").select(
        row, F.coalesce("_id", F.lit(UNKNOWN_ID)).alias("_id"), F.explode("_places").alias("_place")
    )
    gathered = found.groupBy(row).agg(
        F.array_sort(F.collect_list(F.struct("_place._list", "_place._at", "_id"))).alias("_ids")
    )
    joined = numbered.join(gathered, row, "left")
    ids = {
        name: F.when(named(name).isNotNull(), F.transform(
            F.filter(
                F.coalesce("_ids", F.array().cast("array<struct<_list:int,_at:int,_id:int>>")),
                belongs_to(number),
            ),
            lambda x: x["_id"],
        ))
        for number, name in enumerate(lists)
    }
    return joined.withColumns(ids).drop(row, "_ids")


def ones_like(ids: Column | str) -> Column:
    """The attention mask of an id list: a 1 for every id."""
    column = F.col(ids) if isinstance(ids, str) else ids
    return F.array_repeat(F.lit(1), F.size(column))


def encode_tokens(
    df: DataFrame,
    columns: list[str],
    vocab: DataFrame,
    id_columns: list[str],
    mask_columns: list[str],
    add_special_tokens: bool = True,
    on_null: str = "error",
    max_words: int | None = None,
    on_long: str = "truncate",
) -> DataFrame:
    """Add ids and attention mask for each text column; unknown words get the unknown id.

    A vocabulary of up to `SHIPPED` words is looked up where the row is: whole Arrow batches, no
    shuffle of words and none of rows. A larger one is joined on the word, with the same result. Filter
    the rows first: Spark moves no filter below the lookup.

    ``max_words`` is for feeds that limit the length anyway: with ``on_long="truncate"`` a text's words
    beyond that many are not looked up, with ``"drop"`` neither is any word of a row that has more.
    """
    need_choice(on_long, LENGTH_MODES, "on_long")
    need_columns(df, *columns)
    lists = {
        ids: reject_nulls(words(named(column)), [named(column)], on_null, column)
        for column, ids in zip(columns, id_columns)
    }
    if max_words is not None and on_long == "drop":
        for column in columns:
            df = df.where(F.coalesce(F.size(words(named(column))) <= max_words, F.lit(True)))
    elif max_words is not None:
        lists = {ids: F.slice(found, 1, max_words) for ids, found in lists.items()}
    vocab = materialize(vocab.select("token", "id"), "vocabulary")
    if vocab.count() <= SHIPPED:
        lookup = _vocab_lookup(vocab)
        df = df.withColumns({ids: lookup(found) for ids, found in lists.items()})
    else:
        df = _join_ids(df, lists, vocab)
    for ids, mask in zip(id_columns, mask_columns):
        df = df.withColumn(mask, ones_like(ids))
        if add_special_tokens:
            df = with_special_ids(df, ids, mask, BOS_ID, EOS_ID)
    return df


def tokenize_with(
    df: DataFrame,
    columns: list[str],
    make_tokenizer: Callable[[], Callable[[list[str]], list[list[int]]]],
    id_columns: list[str],
    mask_columns: list[str],
    on_null: str = "error",
) -> DataFrame:
    """Ids and masks from the caller's own tokenizer, loaded once per task."""

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = make_tokenizer()
        for batch in batches:
            texts = batch.tolist()
            ids = iter(tokenizer([text for text in texts if text is not None]))
            yield pd.Series([None if text is None else next(ids) for text in texts], dtype="object")

    encoder = F.pandas_udf(encode, "array<int>").asNondeterministic()
    for column, ids, mask in zip(columns, id_columns, mask_columns):
        need_columns(df, column)
        text = reject_nulls(F.col(column), [F.col(column)], on_null, column)
        df = df.withColumn(ids, encoder(text)).withColumn(mask, ones_like(ids))
    return df


def with_special_ids(
    df: DataFrame, ids: str, mask: str, bos: int | None = None, eos: int | None = None
) -> DataFrame:
    """Put ids before and after an id list, and lengthen its mask to match."""
    need_columns(df, ids, mask)

    def around(column: str, first: int | None, last: int | None) -> Column:
        parts = [F.col(column)]
        if first is not None:
            parts.insert(0, F.array(F.lit(first)))
        if last is not None:
            parts.append(F.array(F.lit(last)))
        return F.concat(*parts)

    one = lambda edge: None if edge is None else 1
    return df.withColumns({ids: around(ids, bos, eos), mask: around(mask, one(bos), one(eos))})


def limit_length(
    df: DataFrame, id_columns: list[str], n: int, mode: str = "truncate"
) -> DataFrame:
    """Cut lists to ``n`` entries, or drop the rows in which any list is longer."""
    need_choice(mode, LENGTH_MODES, "mode")
    need_columns(df, *id_columns)
    if mode == "truncate":
        return df.withColumns({name: F.slice(name, 1, n) for name in id_columns})
    for name in id_columns:
        df = df.where(F.size(name) <= n)
    return df
