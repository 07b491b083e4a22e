import random

from pairloom.llm.compression import fit_compression, score_quality


def text(rng, good):
    words = ["".join(rng.choice("aeioubdglmnst") for _ in range(rng.randint(2, 7))) for _ in range(120)]
    return " ".join(words) if good else " ".join(w.upper() + "$$!" for w in words)


def test_held_out_accuracy_and_edges(spark, documents):
    rng = random.Random(1)
    rows = [(i, text(rng, i % 4 > 0)) for i in range(400)]
    labels = spark.createDataFrame(
        [(i, int(i % 4 > 0), 0) for i in range(200)] + [(None, 1, 0), (7, None, 0), (9999, 0, 0), (3, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    docs = documents([*rows, (500, None), (501, ""), (502, "x"), (None, rows[1][1]), (1, rows[1][1])])
    model = fit_compression(docs, labels)
    found = score_quality(docs, model).collect()
    assert len(found) == 405 and all(0 <= r.score <= 1 for r in found)
    by_id = {r.doc_id: r.score for r in found}
    right = [(by_id[i] >= 0.3) == (i % 4 > 0) for i in range(200, 400)]
    assert sum(right) / len(right) >= 0.95
    assert by_id[500] == by_id[501]
    assert score_quality(documents([]), model).count() == 0


def test_without_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = documents([(1, "some text"), (2, None)])
    found = score_quality(docs, fit_compression(docs, none)).collect()
    assert len(found) == 2 and all(0 <= r.score <= 1 for r in found)
