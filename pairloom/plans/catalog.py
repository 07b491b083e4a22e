"""Registered queries, and for each one that SQL can express its DuckDB twin.

Every query runs over the whole of its tables. Doubles are rounded to six digits on both sides:
their sums differ in the last bits with the partitioning.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom import functions as fn
from pairloom import operators as op
from pairloom import sources
from pairloom.functions.messages import message
from pairloom.plans import inputs, recipes, stand_ins
from pairloom.storage import new_path
from pairloom.streaming import run_in_batches, write_batches


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None):
    """Register a function of session and folder under its own name."""

    def add(run):
        QUERIES[run.__name__] = Query(run, sql)
        return run

    return add


def _six(column: str) -> Column:
    return F.round(column, 6).alias(column)


CHAT = fn.ChatTemplate(
    bos="<s>", role_open="<|", role_close="|>\n", end="</s>\n", generation_prompt="<|assistant|>\n"
)

# ---------------------------------------------------------------- keyed subsets

TOPIC_ROWS_SQL = f"""
SELECT doc_id, prompt, completion, topic AS config,
       CASE WHEN split = 'test' THEN 'validation' ELSE split END AS split
FROM (SELECT *, regexp_extract(prompt, '^SUBREDDIT:\\s*r/(\\w+)', 1) AS topic
      FROM ({inputs.POSTS_SQL}))
WHERE topic IN (SELECT regexp_extract(prompt, '^SUBREDDIT:\\s*r/(\\w+)', 1)
                FROM ({inputs.POSTS_SQL}) WHERE split = 'train')
"""


@query(f"SELECT config, split, count(*) AS n FROM ({TOPIC_ROWS_SQL}) GROUP BY config, split")
def topic_counts(spark, folder):
    rows = recipes.topic_subsets(inputs.posts(spark, folder))
    return rows.groupBy("config", "split").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, prompt, completion, config, split FROM ({TOPIC_ROWS_SQL})")
def topic_subsets(spark, folder):
    return recipes.topic_subsets(inputs.posts(spark, folder))


@query(f"""SELECT doc_id, regexp_extract(prompt, '^SUBREDDIT:\\s*r/(\\w+)', 1) AS topic
           FROM ({inputs.POSTS_SQL})""")
def extract_key(spark, folder):
    return op.with_key(inputs.posts(spark, folder), "prompt", "topic").select("doc_id", "topic")


@query(f"""SELECT doc_id, config, source, split FROM ({inputs.ARTICLES_SQL})
           WHERE source IN (SELECT source FROM ({inputs.ARTICLES_SQL}) WHERE split = 'train')""")
def fan_out(spark, folder):
    kept = op.fan_out(inputs.articles(spark, folder), "source", config="subset")
    return kept.select("doc_id", "config", F.col("subset").alias("source"), "split")


@query(f"""SELECT doc_id, CASE WHEN split = 'test' THEN 'validation' ELSE split END AS split
           FROM ({inputs.ARTICLES_SQL})""")
def fold_splits(spark, folder):
    folded = op.fold_splits(inputs.articles(spark, folder), {"test": "validation"})
    return folded.select("doc_id", "split")


@query("SELECT DISTINCT source FROM documents")
def distinct_keys(spark, folder):
    return op.distinct_keys(inputs.table(spark, folder, "documents"), "source")


@query("SELECT DISTINCT lang AS config FROM documents")
def list_configs(spark, folder):
    return sources.list_configs(inputs.articles(spark, folder))


@query(f"SELECT DISTINCT split FROM ({inputs.ARTICLES_SQL}) WHERE config = 'en'")
def list_splits(spark, folder):
    return sources.list_splits(inputs.articles(spark, folder), "en")


# ---------------------------------------------------------------- sources and sinks


@query(f"""SELECT doc_id, CASE WHEN config = 'en' THEN 'rewritten: ' || text ELSE text END AS text,
                  config, split FROM ({inputs.ARTICLES_SQL})""")
def publish_roundtrip(spark, folder):
    rows = inputs.articles(spark, folder).select("doc_id", "text", "config", "split")
    root = new_path(spark, "published")
    sources.publish(rows, root)
    again = rows.where(F.col("config") == "en").withColumn(
        "text", F.concat(F.lit("rewritten: "), "text")
    )
    sources.publish(again, root, scope="parts")
    return sources.read_dataset(spark, root, schema=rows.schema)


@query(f"""SELECT 1 AS version, config, count(*) AS n FROM ({inputs.ARTICLES_SQL}) GROUP BY config
           UNION ALL SELECT 2, config, count(*) FROM ({inputs.ARTICLES_SQL})
           WHERE config <> 'en' OR split = 'train' GROUP BY config""")
def dataset_versions(spark, folder):
    """A dataset made anew from itself, and what it was before."""
    root = new_path(spark, "published")
    sources.publish(inputs.articles(spark, folder).select("doc_id", "config", "split"), root)
    sources.publish(sources.read_dataset(spark, root).where("config <> 'en' OR split = 'train'"), root)
    counts = [
        sources.read_dataset(spark, root, version=version).groupBy("config").agg(F.count("*").alias("n"))
        .select(F.lit(version).alias("version"), "config", "n")
        for version in (1, 2)
    ]
    return counts[0].unionByName(counts[1])


@query(f"SELECT doc_id, text FROM ({inputs.ARTICLES_SQL}) WHERE config = 'fr' AND split = 'train'")
def read_part(spark, folder):
    rows = inputs.articles(spark, folder).select("doc_id", "text", "config", "split")
    root = new_path(spark, "published")
    sources.publish(rows, root)
    return sources.read_dataset(spark, root, "fr", "train").select("doc_id", "text")


@query(f"""SELECT CAST(event_id AS BIGINT) AS run_id, method AS self_preference,
                  round(winrate, 6) AS global_winrate FROM ({inputs.SWEEP_RUNS_SQL})""")
def read_sweep(spark, folder):
    path = new_path(spark, "sweep-csv")
    runs = inputs.sweep_runs(spark, folder).select(
        F.col("event_id").alias("run.id"), F.col("method").alias("self-preference"),
        F.col("winrate").alias("global-winrate"),
    )
    runs.write.option("header", True).option("quoteAll", True).csv(path)
    schema = "`run.id` bigint, `self-preference` string, `global-winrate` double"
    return sources.read_sweep(spark, path, schema).select("run_id", "self_preference", _six("global_winrate"))


@query("""SELECT event_id, event_type AS method,
                 CASE WHEN event_type IN ('click', 'view') THEN CAST(user_id % 50 AS INTEGER) END AS local_kl,
                 CASE WHEN event_type NOT IN ('click', 'view') THEN user_id % 7 = 0 END AS early_stop,
                 round(value, 6) AS winrate FROM events""")
def read_sweeps(spark, folder):
    """Exports of two shapes in one folder: the names of their columns differ, and so does the order."""
    runs = inputs.table(spark, folder, "events").select(
        "event_id", F.col("event_type").alias("method"), (F.col("user_id") % 50).alias("local.kl"),
        (F.col("user_id") % 7 == 0).alias("early-stop"), F.col("value").alias("winrate"),
    )
    path = new_path(spark, "exports")
    local = F.col("method").isin("click", "view")
    runs.where(local).drop("early-stop").write.csv(path, header=True, mode="append")
    runs.where(~local).select("winrate", "early-stop", "method", "event_id").write.csv(path, header=True, mode="append")
    found = sources.read_sweeps(spark, path, label=None)
    return found.select(F.col("event_id").cast("bigint"), "method", "local_kl", "early_stop", _six("winrate"))


# ---------------------------------------------------------------- projections


@query("SELECT doc_id, text, source FROM documents")
def drop_columns(spark, folder):
    return op.drop_columns(inputs.table(spark, folder, "documents"), "lang", "n_chars")


@query("SELECT doc_id, lang AS language, 'FedAvg' AS method FROM documents")
def constant_column(spark, folder):
    docs = inputs.table(spark, folder, "documents").select("doc_id", "lang")
    named = op.constant_column(docs, "language", F.col("lang"))
    return op.constant_column(named, "method", "FedAvg").drop("lang")


@query("SELECT doc_id, text AS summary, lang AS config, source, n_chars FROM documents")
def rename_columns(spark, folder):
    docs = inputs.table(spark, folder, "documents")
    return op.rename_columns(docs, {"text": "summary", "lang": "config"})


@query("SELECT text, source AS summary FROM documents")
def select_as(spark, folder):
    docs = inputs.table(spark, folder, "documents")
    return op.select_as(docs, {"text": "text", "source": "summary"})


@query("SELECT page_id, split_part(url, '/', 2) AS label, split_part(url, '/', 3) AS host FROM pages")
def label_from_path(spark, folder):
    pages = inputs.table(spark, folder, "pages")
    without_scheme = F.regexp_replace("url", "^[a-z]+:/", "")
    return pages.select(
        "page_id", fn.path_label("url").alias("label"),
        fn.path_label(without_scheme).alias("host"),
    )


@query(f"""SELECT pair_id, prompt || completion AS text,
                  prompt || completion || completion AS text_twice FROM ({inputs.EXCHANGES_SQL})""")
def cat_columns(spark, folder):
    # The second pair reads what the first one wrote.
    joined = op.cat_columns(
        inputs.exchanges(spark, folder), ["prompt", "text"], ["completion", "completion"],
        ["text", "text_twice"],
    )
    return joined.select("pair_id", "text", "text_twice")


@query("SELECT doc_id, text || chr(10) || chr(10) || 'TL;DR: ' AS text FROM documents")
def append_suffix(spark, folder):
    docs = inputs.table(spark, folder, "documents").select("doc_id", "text")
    return op.append_suffix(docs, "text")


@query("""
WITH a AS (SELECT row_number() OVER (ORDER BY doc_id) AS pos, doc_id, text FROM documents),
     b AS (SELECT row_number() OVER (ORDER BY n_chars, doc_id) AS pos, doc_id AS other_id, n_chars
           FROM documents)
SELECT doc_id, text, other_id, n_chars FROM a JOIN b USING (pos)
""")
def attach_by_position(spark, folder):
    docs = inputs.table(spark, folder, "documents")
    other = docs.select(F.col("doc_id").alias("other_id"), "n_chars")
    return op.attach_by_position(
        docs.select("doc_id", "text"), ["doc_id"], other, ["n_chars", "other_id"]
    )


# ---------------------------------------------------------------- filters


@query("SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'de'")
def filter_equals(spark, folder):
    docs = inputs.table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    return op.keep_equal(docs, "lang", "de")


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN 'single' ELSE 'federated' END AS method,
                 value FROM events""")
def single_vs_rest(spark, folder):
    events = inputs.table(spark, folder, "events").select("event_id", "event_type", "value")
    single, rest = op.single_vs_rest(events, "event_type", "view")
    return op.concat_tables(
        op.constant_column(single, "method", "single"),
        op.constant_column(rest, "method", "federated"),
    ).drop("event_type")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'click' AND user_id NOT IN (1, 3, 10)")
def filter_not_in(spark, folder):
    events = inputs.table(spark, folder, "events").select("event_id", "user_id", "event_type")
    clicks = op.keep_equal(events, "event_type", "click")
    return op.drop_values(clicks, "user_id", [1, 3, 10]).drop("event_type")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'click', 'signup')")
def keep_methods(spark, folder):
    events = inputs.table(spark, folder, "events").select("event_id", "event_type")
    return op.keep_values(events, "event_type", ["view", "click", "signup"])


# ---------------------------------------------------------------- whole tables


@query("""SELECT conv_id, turn, text, 'train' AS split FROM conversations WHERE role = 'user'
          UNION ALL
          SELECT conv_id, turn, text, 'validation' FROM conversations WHERE role = 'assistant'""")
def bundle_splits(spark, folder):
    turns = inputs.table(spark, folder, "conversations")
    part = lambda role: turns.where(F.col("role") == role).drop("role")
    return op.bundle_splits({"train": part("user"), "validation": part("assistant")})


@query("""SELECT doc_id, text FROM documents UNION ALL
          SELECT page_id, html FROM pages UNION ALL SELECT doc_id, text FROM documents""")
def concat_tables(spark, folder):
    docs = inputs.table(spark, folder, "documents").select("doc_id", "text")
    pages = inputs.table(spark, folder, "pages").select(
        F.col("page_id").alias("doc_id"), F.col("html").alias("text")
    )
    return op.concat_tables(docs, pages, docs)


@query("""SELECT doc_id, lang, n_chars, CAST(NULL AS INTEGER) AS quality, CAST(NULL AS INTEGER) AS toxic
          FROM documents
          UNION ALL SELECT doc_id, NULL, NULL, quality, toxic FROM labels""")
def concat_tables_missing(spark, folder):
    docs = inputs.table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    return op.concat_tables(docs, inputs.table(spark, folder, "labels"), allow_missing=True)


# ---------------------------------------------------------------- row ranges and splits

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_SQL = "SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS pos FROM lineitem"


@query("""SELECT o_orderkey, o_totalprice,
                 row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_index FROM orders""")
def row_index(spark, folder):
    orders = inputs.table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return op.with_row_index(orders, ["o_totalprice", "o_orderkey"])


@query("SELECT * FROM documents ORDER BY doc_id LIMIT 150")
def head_rows(spark, folder):
    return op.head_rows(inputs.table(spark, folder, "documents"), 150, ["doc_id"])


@query(f"SELECT * EXCLUDE (pos) FROM ({LINE_SQL}) WHERE pos < 16722")
def head_rows_large(spark, folder):
    lines = inputs.table(spark, folder, "lineitem")
    return op.head_rows(lines, 16722, LINE_KEY, strict=False)


# DuckDB numbers rows in the order of the file where no order is named.


@query("SELECT o_orderkey, o_totalprice, row_number() OVER () - 1 AS row_index FROM orders")
def row_index_stored(spark, folder):
    orders = inputs.table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return op.with_row_index(orders, None)


@query("""SELECT * EXCLUDE (pos) FROM (SELECT *, row_number() OVER () - 1 AS pos FROM lineitem)
          WHERE pos >= 16722 AND pos < 116722""")
def slice_rows_stored(spark, folder):
    return op.slice_rows(inputs.table(spark, folder, "lineitem"), 16722, 116722, None, strict=False)


@query("""SELECT * EXCLUDE (pos) FROM (
            SELECT *, row_number() OVER () - 1 AS pos FROM lineitem WHERE l_returnflag <> 'N')
          WHERE pos >= 500 AND pos < 9000""")
def slice_filtered_stored(spark, folder):
    lines = inputs.table(spark, folder, "lineitem").where("l_returnflag <> 'N'")
    return op.slice_rows(lines, 500, 9000, None, strict=False)


@query("""SELECT a.* EXCLUDE (pos), b.* EXCLUDE (pos)
          FROM (SELECT l_orderkey, l_linenumber, row_number() OVER () AS pos FROM lineitem) a
          JOIN (SELECT l_quantity, l_shipdate, row_number() OVER () AS pos FROM lineitem) b USING (pos)""")
def attach_stored(spark, folder):
    lines = inputs.table(spark, folder, "lineitem")
    return op.attach_by_position(
        lines.select("l_orderkey", "l_linenumber"), None, lines.select("l_quantity", "l_shipdate"), None
    )


@query(f"SELECT * EXCLUDE (pos) FROM ({LINE_SQL}) WHERE pos >= 16722 AND pos < 116722")
def slice_rows(spark, folder):
    lines = inputs.table(spark, folder, "lineitem")
    return op.slice_rows(lines, 16722, 116722, LINE_KEY, strict=False)


@query(f"""SELECT * EXCLUDE (pos) FROM
           (SELECT *, row_number() OVER (PARTITION BY config, split ORDER BY doc_id) AS pos
            FROM ({inputs.ARTICLES_SQL}))
           WHERE pos <= CASE WHEN split = 'train' THEN 100 ELSE 10 END""")
def head_rows_per_split(spark, folder):
    cap = F.when(F.col("split") == "train", 100).otherwise(10)
    return op.head_per_group(inputs.articles(spark, folder), ["config", "split"], cap, ["doc_id"])


@query("""SELECT doc_id, text, CASE WHEN substr(md5('7:' || doc_id), 1, 13) < '199999999999a'
                                    THEN 'validation' ELSE 'train' END AS split FROM documents""")
def hash_split(spark, folder):
    docs = inputs.table(spark, folder, "documents").select("doc_id", "text")
    return op.hash_split(docs, "doc_id", 0.1, seed=7)


@query("""
SELECT doc_id, text,
       CASE WHEN row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id)
                 <= ceil(0.1 * (SELECT count(*) FROM documents))
            THEN 'validation' ELSE 'train' END AS split
FROM documents
""")
def hash_split_exact(spark, folder):
    docs = inputs.table(spark, folder, "documents").select("doc_id", "text")
    return recipes.instruction_splits(docs, "doc_id")


@query("""SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 100 AS batch_id
          FROM events""")
def assign_batches(spark, folder):
    events = inputs.table(spark, folder, "events").select("event_id")
    return op.assign_batches(events, ["event_id"], 100)


FEED_SQL = f"""
SELECT doc_id, prompt, completion, split FROM
  (SELECT *, row_number() OVER (PARTITION BY split ORDER BY doc_id) AS pos FROM ({inputs.POSTS_SQL}))
"""


@query(f"{FEED_SQL} WHERE (split = 'train' AND pos <= 100) OR (split = 'validation' AND pos <= 10)")
def training_view(spark, folder):
    rows = inputs.posts(spark, folder)
    return op.training_view(rows, {"train": 100, "validation": 10}, ["doc_id"])


@query(f"{FEED_SQL} WHERE split = 'test' OR (split = 'train' AND pos <= 100) OR pos <= 10")
def sft_rows(spark, folder):
    return recipes.sft_rows(inputs.posts(spark, folder), ["doc_id"], 100, 10)


@query(f"{FEED_SQL} WHERE split <> 'train' OR (pos > 50 AND pos <= 120)")
def ppo_rows(spark, folder):
    return recipes.ppo_rows(inputs.posts(spark, folder), ["doc_id"], (50, 120))


# ---------------------------------------------------------------- sweeps


@query(f"""SELECT method, kl, update_every, round(avg(winrate), 6) AS winrate
           FROM ({inputs.SWEEP_RUNS_SQL}) GROUP BY method, kl, update_every""")
def mean_by(spark, folder):
    runs = inputs.sweep_runs(spark, folder)
    means = op.mean_by(runs, ["method", "kl", "update_every"], "winrate")
    return means.withColumn("winrate", F.round("winrate", 6))


@query("SELECT event_type AS method, min(value) AS min, max(value) AS max FROM events GROUP BY 1")
def min_max(spark, folder):
    return op.value_range(inputs.sweep_runs(spark, folder), "method", "winrate")


def _curve_sql(values: str, n_max: int) -> str:
    return f"""
WITH vals AS ({values}),
ranked AS (SELECT method, v, row_number() OVER (PARTITION BY method ORDER BY v) AS i,
                  count(*) OVER (PARTITION BY method) AS total FROM vals),
p AS (SELECT method, v, n, total,
             pow(i / CAST(total AS DOUBLE), n) - pow((i - 1) / CAST(total AS DOUBLE), n) AS p
      FROM ranked, range(1, {n_max + 1}) r(n) WHERE n <= total),
m AS (SELECT method, n, sum(v * p) AS mean FROM p GROUP BY method, n),
s AS (SELECT p.method, p.n, any_value(mean) AS mean, sqrt(sum(pow(v - mean, 2) * p)) AS std,
             min(v) AS min, max(v) AS max
      FROM p JOIN m ON m.method = p.method AND m.n = p.n GROUP BY p.method, p.n),
curves AS (SELECT *, max(n) OVER (PARTITION BY method) AS n_max FROM s)
"""


CURVE_COLUMNS = ["mean", "std", "min", "max"]


@query(_curve_sql("SELECT event_type AS method, value AS v FROM events", 10) + """
SELECT method, CAST(n AS INTEGER) AS n, round(mean, 6) AS mean, round(std, 6) AS std,
       round(min, 6) AS min, round(max, 6) AS max FROM curves""")
def expected_max(spark, folder):
    curves = op.expected_max(inputs.sweep_runs(spark, folder), "method", "winrate", n_max=10)
    return curves.select("method", "n", *map(_six, CURVE_COLUMNS))


@query(_curve_sql(f"""SELECT method, avg(winrate) AS v FROM ({inputs.SWEEP_RUNS_SQL})
                      WHERE method IN ('view', 'click') GROUP BY method, kl, update_every""", 20) + """
SELECT method, CAST(n AS INTEGER) AS n, round(mean, 6) AS mean, round(std, 6) AS std,
       round(min, 6) AS min, round(max, 6) AS max, round(mean - std, 6) AS lo,
       round(mean + std, 6) AS hi,
       CASE method WHEN 'view' THEN 'Seen' ELSE method END AS label
FROM curves WHERE n < n_max OR method = 'view'""")
def sweep_curves(spark, folder):
    curves = op.sweep_curves(
        inputs.sweep_runs(spark, folder), "method", ["kl", "update_every"], "winrate", n_max=20,
        keep=["view", "click"], legend={"view": "Seen"}, full="view",
    )
    return curves.select("method", "n", "label", *map(_six, [*CURVE_COLUMNS, "lo", "hi"]))


@query(_curve_sql(f"""SELECT CASE WHEN method = 'error' THEN 'FedAvg'
                                  ELSE CAST(CAST(kl AS DOUBLE) AS VARCHAR) END AS method,
                             avg(winrate) AS v
                      FROM ({inputs.SWEEP_RUNS_SQL}) WHERE method = 'error' OR kl IN (1, 2)
                      GROUP BY 1, kl, update_every""", 2000) + """
SELECT method, CAST(n AS INTEGER) AS n, round(mean, 6) AS mean, round(std, 6) AS std,
       CASE method WHEN '1.0' THEN 'Isolated' ELSE method END AS label
FROM curves""")
def federated_sweep(spark, folder):
    runs = inputs.sweep_runs(spark, folder)
    own = runs.where(F.col("method") != "error").withColumn("sp", F.col("kl").cast("double"))
    federated = runs.where(F.col("method") == "error").select(
        "kl", "update_every", F.col("winrate").alias("global_winrate"),
        F.lit(0.5).alias("self_preference"),
    )
    curves = recipes.sweep_with_federated(
        own.drop("method"), federated, "kl", "winrate", "sp", "update_every",
        keep=["1.0", "2.0", "FedAvg"],
    )
    return op.order_methods(curves).select("method", "n", "label", _six("mean"), _six("std"))


@query(_curve_sql("SELECT event_type AS method, value AS v FROM events", 10) + """
SELECT method, CAST(n AS INTEGER) AS n, round(mean, 6) AS mean FROM curves
WHERE n < n_max OR method = 'click'""")
def curve_trim(spark, folder):
    curves = op.expected_max(inputs.sweep_runs(spark, folder), "method", "winrate", n_max=10)
    return op.trim_curve(curves, "click").select("method", "n", _six("mean"))


# ---------------------------------------------------------------- text and messages

ASKED = "Text <{text}> with {{braces}}: {response0} or {response1}?"


@query(f"""SELECT doc_id, 'Text <' || response1 || '> with {{braces}}: ' || language || ' or '
                  || domain || '?' AS question FROM ({inputs.RATED_SQL})""")
def render_template(spark, folder):
    question = fn.render_template(ASKED, text="response1", response0="language", response1="domain")
    return inputs.rated(spark, folder).select("doc_id", question.alias("question"))


@query("""SELECT doc_id, CASE right(rtrim(text || md5(text) || ' ' || chr(10), ' ' || chr(10)), 1)
                         WHEN '0' THEN 0 WHEN '1' THEN 1 ELSE -1 END AS rank FROM documents""")
def parse_verdict(spark, folder):
    docs = inputs.table(spark, folder, "documents")
    answer = F.concat("text", F.md5("text"), F.lit(" \n"))
    return docs.select("doc_id", fn.parse_verdict(answer).alias("rank"))


@query(f"""SELECT pair_id, 'system' AS role0, 'Be brief.' AS content0, 'user' AS role1,
                  prompt AS content1, CAST(2 AS INTEGER) AS n FROM ({inputs.EXCHANGES_SQL})""")
def to_messages(spark, folder):
    rows = inputs.exchanges(spark, folder).withColumn("m", fn.to_messages("prompt", "Be brief."))
    return rows.select(
        "pair_id", F.col("m")[0]["role"].alias("role0"), F.col("m")[0]["content"].alias("content0"),
        F.col("m")[1]["role"].alias("role1"), F.col("m")[1]["content"].alias("content1"),
        F.size("m").alias("n"),
    )


@query("""SELECT conv_id, turn, '<s><|system|>' || chr(10) || 'Be brief.</s>' || chr(10) || '<|user|>'
                 || chr(10) || text || '</s>' || chr(10) || '<|assistant|>' || chr(10) AS prompt
          FROM conversations""")
def apply_chat_template(spark, folder):
    turns = inputs.table(spark, folder, "conversations").drop("role")
    written = op.apply_chat_template(
        turns, ["text"], CHAT, add_generation_prompt=True, new_columns=["prompt"],
        system_prompt="Be brief.",
    )
    return written.drop("text")


@query(f"""SELECT pair_id, '<s><|user|>' || chr(10) || prompt || '</s>' || chr(10) || '<|assistant|>'
                  || chr(10) || completion || '</s>' || chr(10) AS chat FROM ({inputs.EXCHANGES_SQL})""")
def apply_chat_template_to_chats(spark, folder):
    rows = inputs.exchanges(spark, folder).select(
        "pair_id",
        F.array(message("user", F.col("prompt")), message("assistant", F.col("completion")))
        .alias("chat"),
    )
    return op.apply_chat_template(rows, ["chat"], CHAT, "conversational", system_prompt="unused")


@query(f"""SELECT conv_id, turn, pair_id, completion, '<s><|user|>' || chr(10) || prompt || '</s>'
                  || chr(10) || '<|assistant|>' || chr(10) AS prompt FROM ({inputs.EXCHANGES_SQL})""")
def chat_prompts(spark, folder):
    rows = inputs.exchanges(spark, folder).withColumns({
        "prompt_id": F.md5("prompt"), "messages": fn.to_messages("prompt"),
    })
    return recipes.chat_prompts(rows, CHAT)


@query(f"SELECT doc_id, config, split, source, text AS target FROM ({inputs.ARTICLES_SQL}) WHERE config IN ('en', 'es', 'fr')")
def article_subsets(spark, folder):
    rows = inputs.articles(spark, folder).select(
        "doc_id", "config", "split", "source", F.col("text").alias("target"),
        F.col("config").alias("source_language"), F.lit("en").alias("target_language"),
        F.array("text").alias("references"),
    )
    return recipes.article_subsets(rows, ["en", "es", "fr"])


@query(f"""SELECT config, split, text || chr(10) || chr(10) || 'TL;DR: ' AS text, source AS summary
           FROM ({inputs.ARTICLES_SQL}) WHERE config IN ('en', 'ru', 'de', 'fr', 'es', 'it', 'nl')""")
def article_prompts(spark, folder):
    rows = inputs.articles(spark, folder).select(
        "config", "split", F.col("text").alias("source"), F.col("source").alias("target")
    )
    return recipes.article_prompts(rows)


# ---------------------------------------------------------------- tokens

VOCAB = 2000
WORDS_SQL = "SELECT doc_id, unnest(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS token FROM documents"
VOCAB_SQL = f"""
SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) + 2 AS INTEGER) AS id
FROM (SELECT token, count(*) AS n FROM ({WORDS_SQL}) GROUP BY token ORDER BY n DESC, token LIMIT {VOCAB})
"""
IDS_SQL = f"""
SELECT doc_id, string_agg(CAST(coalesce(id, 0) AS VARCHAR), ' ' ORDER BY pos) AS ids,
       count(pos) AS n
FROM (SELECT doc_id, unnest(words) AS token, generate_subscripts(words, 1) AS pos
      FROM (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\r\\n]+') AS words FROM documents)) w
LEFT JOIN ({VOCAB_SQL}) v USING (token) GROUP BY doc_id
"""


def _vocab(spark: SparkSession, folder: str) -> DataFrame:
    return op.build_vocab(inputs.table(spark, folder, "documents"), ["text"], VOCAB)


def _ids_sql(table: str, key: str, column: str, most: int = 1_000_000_000) -> str:
    """Ids of one text column as text, at most so many, per key."""
    return f"""
SELECT {key}, coalesce(string_agg(CAST(coalesce(id, 0) AS VARCHAR), ' ' ORDER BY pos)
                       FILTER (WHERE pos IS NOT NULL), '') AS ids
FROM (SELECT {key} FROM ({table})) LEFT JOIN
  (SELECT {key}, unnest(words) AS token, generate_subscripts(words, 1) AS pos FROM
     (SELECT {key}, regexp_extract_all({column}, '[^ \\t\\r\\n]+')[1:{most}] AS words FROM ({table})))
  USING ({key}) LEFT JOIN ({VOCAB_SQL}) USING (token) GROUP BY {key}"""


def _id_text(column: str) -> Column:
    return F.array_join(F.col(column).cast("array<string>"), " ").alias(column)


def _encoded(spark: SparkSession, folder: str, special: bool) -> DataFrame:
    docs = inputs.table(spark, folder, "documents").select("doc_id", "text")
    return op.encode_tokens(docs, ["text"], _vocab(spark, folder), ["ids"], ["mask"], special)


@query(VOCAB_SQL)
def build_vocab(spark, folder):
    return _vocab(spark, folder)


@query(f"""SELECT doc_id, coalesce(ids, '') AS ids, CAST(n AS BIGINT) AS n FROM ({IDS_SQL})
           UNION ALL SELECT doc_id, '', 0 FROM documents
           WHERE NOT regexp_matches(text, '[^ \\t\\r\\n]')""")
def encode_tokens(spark, folder):
    rows = _encoded(spark, folder, special=False)
    return rows.select("doc_id", _id_text("ids"), F.size("mask").cast("bigint").alias("n"))


@query(f"""SELECT doc_id, '1 ' || coalesce(ids || ' ', '') || '2' AS ids, CAST(coalesce(n, 0) + 2 AS BIGINT) AS n
           FROM documents LEFT JOIN ({IDS_SQL}) USING (doc_id)""")
def with_special_ids(spark, folder):
    rows = _encoded(spark, folder, special=True)
    return rows.select("doc_id", _id_text("ids"), F.size("mask").cast("bigint").alias("n"))


@query(f"""SELECT doc_id, coalesce(string_agg(CAST(coalesce(id, 0) AS VARCHAR), ' ' ORDER BY pos), '') AS ids
           FROM documents LEFT JOIN
             (SELECT doc_id, unnest(words) AS token, generate_subscripts(words, 1) AS pos
              FROM (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\r\\n]+') AS words FROM documents)) w
             USING (doc_id) LEFT JOIN ({VOCAB_SQL}) v USING (token)
           WHERE pos IS NULL OR pos <= 64 GROUP BY doc_id""")
def limit_length_cut(spark, folder):
    docs = inputs.table(spark, folder, "documents").select("doc_id", "text")
    rows = op.encode_tokens(
        docs, ["text"], _vocab(spark, folder), ["ids"], ["mask"], add_special_tokens=False, max_words=64
    )
    return op.limit_length(rows, ["ids"], 64).select("doc_id", _id_text("ids"))


SHORT_SQL = f"""
SELECT * FROM ({inputs.EXCHANGES_SQL})
WHERE len(regexp_extract_all(prompt, '[^ \\t\\r\\n]+')) <= 30
  AND len(regexp_extract_all(completion, '[^ \\t\\r\\n]+')) <= 30
"""


@query(f"""SELECT pair_id, a.ids AS up, b.ids AS down FROM ({_ids_sql(SHORT_SQL, "pair_id", "prompt")}) a
           JOIN ({_ids_sql(SHORT_SQL, "pair_id", "completion")}) b USING (pair_id)""")
def limit_length_drop(spark, folder):
    rows = op.encode_tokens(
        inputs.exchanges(spark, folder), ["prompt", "completion"], _vocab(spark, folder),
        ["up", "down"], ["a_mask", "b_mask"], add_special_tokens=False, max_words=30, on_long="drop",
    )
    short = op.limit_length(rows, ["up", "down"], 30, "drop")
    return short.select("pair_id", _id_text("up"), _id_text("down"))


SHORT_FEED_SQL = f"""
SELECT *, prompt || chr(10) || split AS longer FROM
  (SELECT * FROM ({FEED_SQL} WHERE (split = 'train' AND pos <= 100) OR (split = 'validation' AND pos <= 10)))
WHERE len(regexp_extract_all(prompt, '[^ \\t\\r\\n]+')) + 1 <= 200
"""


@query(f"""SELECT doc_id, split, a.ids AS up, b.ids AS down FROM ({SHORT_FEED_SQL})
           JOIN ({_ids_sql(SHORT_FEED_SQL, "doc_id", "prompt")}) a USING (doc_id)
           JOIN ({_ids_sql(SHORT_FEED_SQL, "doc_id", "longer")}) b USING (doc_id)""")
def reward_feed(spark, folder):
    pairs = inputs.posts(spark, folder).select(
        "doc_id", "split", F.col("prompt").alias("chosen"),
        F.concat("prompt", F.lit("\n"), "split").alias("rejected"),
    )
    vocab = _vocab(spark, folder)
    encode = lambda rows: op.encode_tokens(
        rows, ["chosen", "rejected"], vocab, ["up", "down"], ["a_mask", "b_mask"],
        add_special_tokens=False, max_words=200, on_long="drop",
    )
    caps = {"train": 100, "validation": 10}
    fed = recipes.reward_feed(pairs, ["doc_id"], ["up", "down"], caps, 200, encode)
    return fed.select("doc_id", "split", _id_text("up"), _id_text("down"))


# ---------------------------------------------------------------- preferences


@query(f"""SELECT doc_id, CASE WHEN overall_preference <= 0 THEN response1 ELSE response2 END
                          AS best_response FROM ({inputs.RATED_SQL})""")
def choose_best(spark, folder):
    return op.choose_best(inputs.rated(spark, folder)).select("doc_id", "best_response")


@query(f"""SELECT doc_id, language AS config, split,
                  CASE WHEN overall_preference <= 0 THEN response1 ELSE response2 END AS best_response
           FROM ({inputs.RATED_SQL}) WHERE domain = 'src1' AND language IN
             (SELECT language FROM ({inputs.RATED_SQL}) WHERE domain = 'src1' AND split = 'train')""")
def best_responses(spark, folder):
    best = recipes.best_responses(inputs.rated(spark, folder), "src1")
    return best.select("doc_id", "config", "split", "best_response")


FLIPPED_SQL = f"""
SELECT *, substr(md5('0:' || doc_id), 1, 1) < '8' AS flip,
       CASE WHEN flip THEN summary_b ELSE summary_a END AS response0,
       CASE WHEN flip THEN summary_a ELSE summary_b END AS response1
FROM ({inputs.SUMMARY_PAIRS_SQL})
"""
UNFLIPPED = "CASE WHEN flip AND raw >= 0 THEN 1 - raw ELSE raw END"
RULED_SQL = f"""
SELECT *, {UNFLIPPED} AS rank FROM
  (SELECT *, CASE WHEN substr(response0, 1, 1) = substr(response1, 1, 1) THEN -1
                  WHEN response0 < response1 THEN 1 ELSE 0 END AS raw FROM ({FLIPPED_SQL}))
"""
CHOSEN = "CASE rank WHEN 0 THEN summary_a ELSE summary_b END"
REJECTED = "CASE rank WHEN 0 THEN summary_b ELSE summary_a END"
JUDGED_TABLE_SQL = f"""
SELECT config, split, doc_id, text, summary_a AS completion_a, summary_b AS completion_b,
       {CHOSEN} AS chosen, {REJECTED} AS rejected, rank FROM ({RULED_SQL}) WHERE rank >= 0
"""


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.summary_pairs(spark, folder)


def _ruled(spark: SparkSession, folder: str) -> DataFrame:
    judge = op.rule_judge(inputs.prefers())
    return op.judge_pairs(_pairs(spark, folder), judge, "doc_id", "summary_a", "summary_b")


@query(f"SELECT doc_id, flip, response0, response1 FROM ({FLIPPED_SQL})")
def flip_pairs(spark, folder):
    flipped = op.flip_pairs(_pairs(spark, folder), "doc_id", "summary_a", "summary_b")
    return flipped.select("doc_id", "flip", "response0", "response1")


@query(f"SELECT doc_id, CAST(rank AS INTEGER) AS rank FROM ({RULED_SQL})")
def judge_rule(spark, folder):
    return _ruled(spark, folder).select("doc_id", "rank")


@query(f"SELECT doc_id, {CHOSEN} AS chosen, {REJECTED} AS rejected FROM ({RULED_SQL}) WHERE rank >= 0")
def to_preference(spark, folder):
    kept, _ = op.to_preference(
        _ruled(spark, folder), a="summary_a", b="summary_b", on_invalid="drop"
    )
    return kept.select("doc_id", "chosen", "rejected")


@query(f"SELECT doc_id, CAST(rank AS INTEGER) AS rank, summary_a, summary_b FROM ({RULED_SQL}) WHERE rank < 0")
def quarantine(spark, folder):
    _, invalid = op.to_preference(
        _ruled(spark, folder), a="summary_a", b="summary_b", on_invalid="quarantine"
    )
    return invalid.select("doc_id", "rank", "summary_a", "summary_b")


@query(f"""SELECT config, split, round(avg(CASE WHEN rank >= 0 THEN rank END), 6) AS win_rate,
                  count(CASE WHEN rank >= 0 THEN 1 END) AS n,
                  count(CASE WHEN rank < 0 THEN 1 END) AS n_invalid
           FROM ({RULED_SQL}) GROUP BY config, split""")
def win_rate(spark, folder):
    rates = op.win_rate(_ruled(spark, folder))
    return rates.withColumn("win_rate", F.round("win_rate", 6))


@query(f"SELECT * REPLACE (CAST(rank AS INTEGER) AS rank) FROM ({JUDGED_TABLE_SQL})")
def build_preference(spark, folder):
    judge = op.rule_judge(inputs.prefers())
    return op.build_preference(_pairs(spark, folder), judge, "doc_id", on_invalid="drop").table


@query(f"""SELECT doc_id, config, split, config AS language,
                  text || chr(10) || chr(10) || 'TL;DR: ' AS text,
                  text || chr(10) || chr(10) || 'TL;DR: ' || chosen AS chosen,
                  text || chr(10) || chr(10) || 'TL;DR: ' || rejected AS rejected
           FROM ({JUDGED_TABLE_SQL})""")
def build_reward_pairs(spark, folder):
    judge = op.rule_judge(inputs.prefers())
    built = op.build_preference(_pairs(spark, folder), judge, "doc_id", on_invalid="drop")
    return recipes.summary_rewards(built.table).drop("completion_a", "completion_b", "rank")


@query(f"""SELECT pair_id, prompt, prompt || completion AS chosen, prompt || pair_id AS rejected
           FROM ({inputs.EXCHANGES_SQL})""")
def prompted_pairs(spark, folder):
    rows = inputs.exchanges(spark, folder).select(
        "pair_id", "prompt", F.col("completion").alias("chosen"), F.col("pair_id").alias("rejected")
    )
    return recipes.prompted_pairs(rows)


# ---------------------------------------------------------------- models


@query("""SELECT doc_id, md5('a:' || text) AS summary_a, md5('b:' || text) AS summary_b
          FROM documents""")
def candidate_pairs(spark, folder):
    docs = inputs.table(spark, folder, "documents").select("doc_id", "text")
    pairs = op.candidate_pairs(
        docs, "text", stand_ins.digest_model("a:"), stand_ins.digest_model("b:")
    )
    return pairs.drop("text")


@query("SELECT conv_id, turn, text || md5('m:' || text) AS answer FROM conversations")
def map_generate(spark, folder):
    turns = inputs.table(spark, folder, "conversations").drop("role")
    model = stand_ins.digest_model("m:", echo=True)
    return op.map_generate(turns, "text", "answer", model).drop("text")


@query("SELECT conv_id, turn, md5('s:' || text) AS answer FROM conversations")
def stored_answers(spark, folder):
    turns = inputs.table(spark, folder, "conversations").drop("role")
    store = op.AnswerStore(new_path(spark, "answers"), {"answer": {"model": "digest"}}, parts=4)
    model = stand_ins.digest_model("s:")
    op.map_generate(turns.where("turn = 0"), "text", "answer", model, store=store)  # an earlier run
    return op.map_generate(turns, "text", "answer", model, store=store).drop("text")


@query("""SELECT conv_id, turn, md5('p:' || text) AS answer,
                 (row_number() OVER (ORDER BY conv_id, turn) - 1) // 1000 AS batch_id FROM conversations""")
def paced_answers(spark, folder):
    turns = inputs.table(spark, folder, "conversations").drop("role")
    batches, out = new_path(spark, "batches"), new_path(spark, "paced")
    schema = write_batches(turns, batches, ["conv_id", "turn"], 1000)
    model = stand_ins.digest_model("p:")
    run_in_batches(
        spark, batches, schema, lambda rows: op.map_generate(rows, "text", "answer", model).drop("text"),
        out, new_path(spark, "paced-checkpoint"), per_trigger=16,
    ).awaitTermination()
    return spark.read.parquet(out)


@query("SELECT conv_id, turn, md5('c:' || text) AS answer FROM conversations")
def map_generate_chat(spark, folder):
    turns = inputs.table(spark, folder, "conversations").drop("role")
    model = stand_ins.digest_chat_model("c:")
    return op.map_generate(turns, "text", "answer", model, chat=True).drop("text")


@query(f"""SELECT doc_id, config, split, text, md5('a:' || text) AS summary_a,
                  md5('b:' || text) AS summary_b FROM
             (SELECT *, row_number() OVER (PARTITION BY config, split ORDER BY doc_id) AS pos
              FROM ({inputs.ARTICLES_SQL}) WHERE config IN ('en', 'ru', 'de', 'fr', 'es', 'it', 'nl'))
           WHERE (split = 'train' AND pos <= 10000) OR (split = 'validation' AND pos <= 1000)""")
def paired_summaries(spark, folder):
    rows = inputs.articles(spark, folder).select(
        "doc_id", "config", "split", F.col("text").alias("source")
    )
    return recipes.paired_summaries(
        rows, ["doc_id"], stand_ins.digest_chat_model("a:"), stand_ins.digest_chat_model("b:")
    )


JUDGE_SQL = f"""
SELECT *, {UNFLIPPED} AS rank FROM
  (SELECT *, CASE WHEN last < '8' THEN 0 WHEN last < 'f' THEN 1 ELSE -1 END AS raw FROM
    (SELECT *, right(md5('Text <' || text || '> with {{braces}}: ' || response0 || ' or '
                         || response1 || '?'), 1) AS last FROM ({FLIPPED_SQL})))
"""


@query(f"""SELECT config, split, doc_id, text, summary_a AS completion_a, summary_b AS completion_b,
                  {CHOSEN} AS chosen, {REJECTED} AS rejected, CAST(rank AS INTEGER) AS rank
           FROM ({JUDGE_SQL}) WHERE rank >= 0""")
def judged_summaries(spark, folder):
    return recipes.judged_summaries(
        _pairs(spark, folder), "doc_id", stand_ins.digest_judge(), ASKED, on_invalid="drop"
    ).table


@query(f"""SELECT doc_id, CAST(CASE WHEN last < '8' THEN 0 WHEN last < 'f' THEN 1 ELSE -1 END
                               AS INTEGER) AS rank
           FROM (SELECT *, right(md5('Text <' || text || '> with {{braces}}: ' || response0 || ' or '
                         || response1 || '?'), 1) AS last FROM ({FLIPPED_SQL}))""")
def map_judge(spark, folder):
    flipped = op.flip_pairs(_pairs(spark, folder), "doc_id", "summary_a", "summary_b")
    return op.map_judge(flipped, ASKED, stand_ins.digest_judge()).select("doc_id", "rank")


@query(f"""SELECT prompt, completion AS human, prompt || md5('l:' || prompt) AS left_model,
                  prompt || md5('r:' || prompt) AS right_model FROM ({inputs.EXCHANGES_SQL})""")
def comparison_table(spark, folder):
    return op.comparison_table(inputs.exchanges(spark, folder), "prompt", {
        "human": F.col("completion"),
        "left_model": stand_ins.digest_model("l:", echo=True),
        "right_model": stand_ins.digest_model("r:", echo=True),
    })


FIRST_TESTS_SQL = f"SELECT * FROM ({inputs.POSTS_SQL}) WHERE split = 'test' ORDER BY doc_id LIMIT 50"


@query(f"""SELECT prompt, prompt || md5('l:' || prompt) AS left_model,
                  prompt || md5('r:' || prompt) AS right_model FROM ({FIRST_TESTS_SQL})""")
def model_comparison(spark, folder):
    return recipes.model_comparison(inputs.posts(spark, folder), ["doc_id"], {
        "lab/left_model": stand_ins.digest_model("l:", echo=True),
        "lab/right_model": stand_ins.digest_model("r:", echo=True),
    }, rows=50)


@query(f"""SELECT doc_id, prompt, split, prompt || completion AS human,
                  prompt || md5('m:' || prompt) AS model FROM ({FIRST_TESTS_SQL})""")
def human_comparison(spark, folder):
    return recipes.human_comparison(
        inputs.posts(spark, folder), ["doc_id"], "lab/model",
        stand_ins.digest_model("m:", echo=True), rows=50,
    )


@query(f"""SELECT count(*) AS pairs, CAST(1 AS DOUBLE) AS accuracy FROM ({inputs.EXCHANGES_SQL})
           WHERE substr(md5('0:' || pair_id), 1, 13) < '3333333333334'""")
def fit_pairwise_reward(spark, folder):
    """Chosen texts are marked by a word: every held-out pair must come out right."""
    rows = inputs.exchanges(spark, folder).select(
        "pair_id", F.concat("completion", F.lit(" better")).alias("chosen"),
        F.concat("completion", F.lit(" worse")).alias("rejected"),
    )
    split = op.hash_split(rows, "pair_id", 0.2)
    fitted = op.fit_pairwise_reward(op.keep_equal(split, "split", "train"), features=1 << 12)
    return fitted.pair_accuracy(op.keep_equal(split, "split", "validation"))


@query(f"""
WITH terms AS (
  SELECT pair, unnest(regexp_extract_all(coalesce(chosen, ''), '[^ \t\r\n]+')) AS word, 1 AS sign
  FROM ({inputs.QUALITY_PAIRS_SQL})
  UNION ALL
  SELECT pair, unnest(regexp_extract_all(coalesce(rejected, ''), '[^ \t\r\n]+')), -1
  FROM ({inputs.QUALITY_PAIRS_SQL}))
SELECT pair, word, CAST(sum(sign) AS BIGINT) AS difference FROM terms GROUP BY pair, word HAVING sum(sign) <> 0
""")
def word_differences(spark, folder):
    return op.word_differences(inputs.quality_pairs(spark, folder), "pair")


@query(None)
def reward_on_quality(spark, folder):
    """Fitted on pairs of labelled texts; the loss on pairs that the fit has not seen."""
    split = op.hash_split(inputs.quality_pairs(spark, folder), "pair", 0.2)
    fitted = op.fit_pairwise_reward(op.keep_equal(split, "split", "train"), reg=0.1)
    return fitted.evaluate(op.keep_equal(split, "split", "validation"))


# ---------------------------------------------------------------- derived keys, moments, listings


@query(f"""SELECT doc_id, split FROM ({inputs.POSTS_SQL})
           WHERE regexp_extract(prompt, '^SUBREDDIT:\\s*r/(\\w+)', 1) = 'src3'""")
def filter_by_topic(spark, folder):
    return op.keep_key(inputs.posts(spark, folder), "prompt", "src3").select("doc_id", "split")


@query("""SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS place FROM events)
          WHERE place > 777 AND place <= 4321""")
def slice_rows_by_time(spark, folder):
    events = inputs.table(spark, folder, "events")
    return op.slice_rows(events, 777, 4321, ["ts", "event_id"], strict=False).select("event_id")


def _published(spark: SparkSession, folder: str) -> tuple[DataFrame, str]:
    rows = inputs.articles(spark, folder).select("doc_id", "config", "split")
    root = new_path(spark, "published")
    sources.publish(rows, root)
    return rows, root


@query(f"SELECT DISTINCT config FROM ({inputs.ARTICLES_SQL})")
def published_configs(spark, folder):
    return sources.published_configs(spark, _published(spark, folder)[1])


@query(f"""SELECT DISTINCT split FROM ({inputs.ARTICLES_SQL}) WHERE config = 'de'
           UNION ALL SELECT 'held'""")
def published_splits(spark, folder):
    rows, root = _published(spark, folder)
    sources.publish(rows.where("config = 'de'"), root, scope="configs", parts=[("de", "held")])
    return sources.published_splits(spark, root, "de")


@query(f"""SELECT doc_id, config, split FROM ({inputs.ARTICLES_SQL}) WHERE config <> 'en' OR split = 'train'""")
def publish_config(spark, folder):
    rows, root = _published(spark, folder)
    sources.publish(rows.where("config = 'en' AND split = 'train'"), root, scope="configs")
    return sources.read_dataset(spark, root, schema=rows.schema)


@query(f"""SELECT doc_id, CAST(CASE WHEN last < '8' THEN 0 WHEN last < 'f' THEN 1 ELSE -1 END
                               AS INTEGER) AS rank
           FROM (SELECT *, right(md5('Text <' || text || '> with {{braces}}: ' || response0 || ' or '
                         || response1 || '?'), 1) AS last FROM ({FLIPPED_SQL}))""")
def map_judge_chat(spark, folder):
    flipped = op.flip_pairs(_pairs(spark, folder), "doc_id", "summary_a", "summary_b")
    judged = op.map_judge(
        flipped, ASKED, stand_ins.digest_chat_judge(), chat=True, system="Be brief.", partitions=4
    )
    return judged.select("doc_id", "rank")


FIRST_POSTS_SQL = f"""
SELECT * FROM ({FEED_SQL} WHERE (split = 'train' AND pos <= 100) OR (split = 'validation' AND pos <= 10))
"""


@query(f"""SELECT doc_id, split, ids FROM ({FIRST_POSTS_SQL})
           JOIN ({_ids_sql(FIRST_POSTS_SQL, "doc_id", "prompt", 64)}) USING (doc_id)""")
def sft_feed(spark, folder):
    vocab = _vocab(spark, folder)
    encode = lambda rows: op.encode_tokens(
        rows, ["prompt"], vocab, ["ids"], ["mask"], add_special_tokens=False, max_words=64
    )
    caps = {"train": 100, "validation": 10}
    fed = recipes.sft_feed(inputs.posts(spark, folder), ["doc_id"], ["ids"], caps, 64, encode)
    return fed.select("doc_id", "split", _id_text("ids"))


def _dialogues(spark: SparkSession, folder: str) -> DataFrame:
    """Each conversation as one message list: ``conv_id, chat``."""
    turns = inputs.table(spark, folder, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("turns")
    )
    return turns.select("conv_id", F.transform(
        "turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))
    ).alias("chat"))


@query("""SELECT conv_id, '<s>' || string_agg('<|' || role || '|>' || chr(10) || text || '</s>' || chr(10), ''
                                               ORDER BY turn) AS chat
          FROM conversations GROUP BY conv_id""")
def dialogue_chats(spark, folder):
    return op.apply_chat_template(_dialogues(spark, folder), ["chat"], CHAT, "conversational")


# A template in the notation that models ship: a system turn is set apart or made up, questions and answers
# are written differently, the last turn has a rule of its own.
MODEL_TEMPLATE = """{{ bos_token }}
{%- if messages[0]['role'] == 'system' %}
    {%- set system = messages[0]['content'] | trim %}
    {%- set turns = messages[1:] %}
{%- else %}
    {%- set system = false %}
    {%- set turns = messages %}
{%- endif %}
{%- if tools is defined and tools %}{{ tools | tojson }}{% endif %}
{{- '[' ~ (system if system else 'none given') ~ ']\n' }}
{%- for message in turns %}
    {%- if message.role == 'user' %}
        {{- loop.index ~ '? ' + message['content'].strip() + '\n' }}
    {%- elif message['role'] in ('assistant', 'tool') %}
        {{- '! ' ~ message.content }}{% if not loop.last %}{{ eos_token }}{% endif %}
    {%- endif %}
{%- endfor %}
{%- if add_generation_prompt and (messages | last).role != 'assistant' %}{{ '! ' }}{% endif %}"""


@query(r"""
WITH turns AS (
  SELECT conv_id, turn, role, text, first_value(role) OVER w = 'system' AS opened,
         row_number() OVER w - CASE WHEN first_value(role) OVER w = 'system' THEN 1 ELSE 0 END AS place,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AS final
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
written AS (
  SELECT *, CASE WHEN place = 0 THEN ''
      WHEN role = 'user' THEN place || '? ' || regexp_replace(text, '^\s+|\s+$', '', 'g') || chr(10)
      WHEN role = 'assistant' THEN '! ' || text || CASE WHEN final THEN '' ELSE '</s>' END
      ELSE '' END AS line
  FROM turns)
SELECT conv_id, '<s>[' || coalesce(max(nullif(regexp_replace(text, '^\s+|\s+$', '', 'g'), ''))
                                     FILTER (WHERE place = 0), 'none given') || ']' || chr(10)
       || string_agg(line, '' ORDER BY turn)
       || CASE WHEN max(role) FILTER (WHERE final) <> 'assistant' THEN '! ' ELSE '' END AS chat
FROM written GROUP BY conv_id
""")
def model_template_chats(spark, folder):
    template = fn.compile_template(MODEL_TEMPLATE, bos_token="<s>", eos_token="</s>")
    return op.apply_chat_template(
        _dialogues(spark, folder), ["chat"], template, "conversational", add_generation_prompt=True
    )


@query(_curve_sql(f"""SELECT CAST(CAST(kl AS DOUBLE) AS VARCHAR) AS method, avg(winrate) AS v
                      FROM ({inputs.SWEEP_RUNS_SQL}) WHERE kl IN (1, 2) GROUP BY kl, update_every""", 30) + """
SELECT method, CAST(n AS INTEGER) AS n, round(mean, 6) AS mean, round(std, 6) AS std FROM curves
WHERE n < n_max OR method = '2.0'""")
def single_sweep(spark, folder):
    runs = inputs.sweep_runs(spark, folder).drop("method").withColumn("strength", F.lit(0.1))
    curves = recipes.single_sweep(
        runs, "strength", "winrate", "kl", "update_every", keep=["1.0", "2.0"], full="2.0"
    )
    return curves.select("method", "n", _six("mean"), _six("std"))


@query(f"""SELECT method, row_number() OVER (ORDER BY number DESC, method) - 1 AS rank FROM
             (SELECT DISTINCT CAST(CAST(kl AS DOUBLE) AS VARCHAR) AS method, CAST(kl AS DOUBLE) AS number
              FROM ({inputs.SWEEP_RUNS_SQL}) UNION ALL SELECT 'FedAvg', 1e9)""")
def rank_methods(spark, folder):
    runs = inputs.sweep_runs(spark, folder).select(F.col("kl").cast("double").cast("string").alias("method"))
    named = runs.unionByName(spark.createDataFrame([("FedAvg",)], "method string"))
    return op.rank_methods(named.distinct())
