import random
from collections import defaultdict

import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, size):
    return [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice(['', 'an', 'or', 'el'])}"
            for _ in range(size)]


def corpus():
    rng = random.Random(21)
    texts = {i: prose(rng, rng.randint(90, 300)) for i in range(150)}
    passage = prose(rng, 90)
    for i in (10, 20, 30):  # a passage that three documents share
        texts[i][40:40] = passage
    for i in range(200, 206):  # near copies of document 5
        copy = list(texts[5])
        copy[i - 180] = "other"
        texts[i] = copy
    rows = {i: " ".join(w) for i, w in texts.items()}
    rows[206] = rows[7]
    junk = {300 + i: " ".join(w.upper() + "$$!" for w in prose(rng, 120)) for i in range(50)}
    short = {400: "", 401: None, 402: " ".join(prose(rng, 20))}
    return rows, junk, short


def test_stages_equal_a_brute_force_run(spark, tmp_path):
    rows, junk, short = corpus()
    every = {**rows, **junk, **short}
    folder = str(tmp_path)
    table = [(i, t, "en", "web", len(t or "")) for i, t in every.items()] + [(8, rows[8], "en", "web", 1)]
    spark.createDataFrame(table, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i not in junk), 0) for i in every if i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")

    names = [name for name, _ in corpus_pipeline.STAGES]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert not junk.keys() & kept[names[0]].keys()
    assert rows.keys() <= kept[names[0]].keys()
    assert kept[names[1]].keys() == rows.keys()
    alone = rows.keys() - {*range(200, 207)}
    assert kept[names[2]] == {i: rows[i] for i in alone}
    after = kept[names[3]]
    assert after.keys() == alone
    assert all(after[i] == rows[i] for i in alone - {20, 30})
    for i in (20, 30):
        words, whole = after[i].split(), rows[i].split()
        assert 60 <= len(whole) - len(words) <= 95
        assert words[:40] == whole[:40] and words[-20:] == whole[-20:]
    n_chars = {r.doc_id: r.n_chars for r in docs.collect()}
    assert all(n_chars[i] == len(after[i]) for i in (20, 30))

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(int)
    for r in corpus_pipeline.run(spark, folder).collect():
        pieces[r.doc_id] += r.length
    assert pieces == {
        i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in after.items()
    }


def test_an_empty_table(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_further_columns_of_any_name(spark, tmp_path):
    from pyspark.sql import functions as F

    rows, _, _ = corpus()
    folder = str(tmp_path)
    table = [(i, rows[i], "en", "web", len(rows[i])) for i in (5, 7, 200, 206, 10, 20)]
    docs = spark.createDataFrame(table + table[:1], SCHEMA).withColumn("a.b", F.lit(1)).withColumn("spans", F.lit("s"))
    once = corpus_pipeline.drop_near_duplicates(spark, docs, folder)
    left = corpus_pipeline.cut_passages(spark, once, folder)
    assert once.columns == left.columns == docs.columns
    assert {(r["doc_id"], r["a.b"], r["spans"]) for r in left.collect()} == {(i, 1, "s") for i in (5, 7, 10, 20)}
