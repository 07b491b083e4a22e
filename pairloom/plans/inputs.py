"""The given tables in the shapes the operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.hashing import key_hash
from pairloom.operators.rows import with_row_index


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _split_of(key: str, source: str | None = None):
    """Train, validation or test by hash; one source never is in train."""
    place = F.substring(key_hash(key, "split"), 1, 2)
    split = F.when(place < "1a", "validation").when(place < "34", "test").otherwise("train")
    return split if source is None else F.when(F.col(source) == "src19", "test").otherwise(split)


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by language and split: ``doc_id, config, split, text, source``."""
    docs = table(spark, folder, "documents")
    return docs.select(
        "doc_id", F.col("lang").alias("config"), _split_of("doc_id", "source").alias("split"),
        "text", "source",
    )


ARTICLES_SQL = """
SELECT doc_id, lang AS config,
       CASE WHEN source = 'src19' THEN 'test'
            WHEN substr(md5('split:' || doc_id), 1, 2) < '1a' THEN 'validation'
            WHEN substr(md5('split:' || doc_id), 1, 2) < '34' THEN 'test'
            ELSE 'train' END AS split,
       text, source
FROM documents
"""


def posts(spark: SparkSession, folder: str) -> DataFrame:
    """Articles as prompts that name their topic: ``doc_id, prompt, completion, split``."""
    return articles(spark, folder).select(
        "doc_id",
        F.concat(F.lit("SUBREDDIT: r/"), "source", F.lit("\nPOST: "), "text").alias("prompt"),
        F.concat(F.lit(" about "), "source").alias("completion"),
        "split",
    )


POSTS_SQL = f"""
SELECT doc_id, 'SUBREDDIT: r/' || source || chr(10) || 'POST: ' || text AS prompt,
       ' about ' || source AS completion, split
FROM ({ARTICLES_SQL})
"""


def exchanges(spark: SparkSession, folder: str) -> DataFrame:
    """A user's turn and the answer to it: ``conv_id, turn, pair_id, prompt, completion``."""
    turns = table(spark, folder, "conversations")
    asked = turns.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("prompt")
    )
    answered = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("completion")
    )
    return asked.join(answered, ["conv_id", "turn"]).select(
        "conv_id", "turn",
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
        .alias("pair_id"),
        "prompt", "completion",
    )


EXCHANGES_SQL = """
SELECT q.conv_id, q.turn, q.conv_id || '-' || q.turn AS pair_id,
       q.text AS prompt, a.text AS completion
FROM conversations q JOIN conversations a
  ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
WHERE q.role = 'user' AND a.role = 'assistant'
"""


def rated(spark: SparkSession, folder: str) -> DataFrame:
    """Two responses and which is preferred: negative the first, positive the second."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return docs.join(labels, "doc_id").select(
        "doc_id", F.col("source").alias("domain"), F.col("lang").alias("language"),
        _split_of("doc_id").alias("split"),
        F.col("text").alias("response1"),
        F.concat("lang", F.lit(": "), "text").alias("response2"),
        (F.col("toxic") - F.col("quality")).alias("overall_preference"),
    )


RATED_SQL = """
SELECT doc_id, source AS domain, lang AS language,
       CASE WHEN substr(md5('split:' || doc_id), 1, 2) < '1a' THEN 'validation'
            WHEN substr(md5('split:' || doc_id), 1, 2) < '34' THEN 'test'
            ELSE 'train' END AS split,
       text AS response1, lang || ': ' || text AS response2,
       toxic - quality AS overall_preference
FROM documents JOIN labels USING (doc_id)
"""


def summary_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Articles with two stand-in summaries drawn from the whole text."""
    return articles(spark, folder).select(
        "doc_id", "config", "split", "text",
        F.md5(F.concat(F.lit("a:"), "text")).alias("summary_a"),
        F.md5(F.concat(F.lit("b:"), "text")).alias("summary_b"),
    )


SUMMARY_PAIRS_SQL = f"""
SELECT doc_id, config, split, text,
       md5('a:' || text) AS summary_a, md5('b:' || text) AS summary_b
FROM ({ARTICLES_SQL})
"""


def prefers():
    """A rule in a judge's place: the later text in dictionary order wins, and a pair that
    starts alike is not decided."""
    first, second = F.col("response0"), F.col("response1")
    return (
        F.when(F.substring(first, 1, 1) == F.substring(second, 1, 1), -1)
        .when(first < second, 1).otherwise(0)
    )


def sweep_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Events as runs of a sweep: a method, two settings, and a result for each run."""
    return table(spark, folder, "events").select(
        "event_id", F.col("event_type").alias("method"), (F.col("user_id") % 50).alias("kl"),
        F.hour("ts").alias("update_every"), F.col("value").alias("winrate"),
    )


SWEEP_RUNS_SQL = """
SELECT event_id, event_type AS method, user_id % 50 AS kl,
       CAST(hour(ts) AS INTEGER) AS update_every, value AS winrate
FROM events
"""


def quality_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """A text of good quality beside one of bad, in order of id: ``pair, chosen, rejected``."""
    rated = table(spark, folder, "documents").select("doc_id", "text").join(
        table(spark, folder, "labels").select("doc_id", "quality"), "doc_id"
    )
    good, bad = (
        with_row_index(rated.where(F.col("quality") == quality).drop("quality"), ["doc_id"], "pair")
        for quality in (1, 0)
    )
    return good.select("pair", F.col("text").alias("chosen")).join(
        bad.select("pair", F.col("text").alias("rejected")), "pair"
    )


QUALITY_PAIRS_SQL = """
SELECT good.pos - 1 AS pair, good.text AS chosen, bad.text AS rejected
FROM (SELECT text, row_number() OVER (ORDER BY doc_id) AS pos
      FROM documents JOIN labels USING (doc_id) WHERE quality = 1) good
JOIN (SELECT text, row_number() OVER (ORDER BY doc_id) AS pos
      FROM documents JOIN labels USING (doc_id) WHERE quality = 0) bad USING (pos)
"""
