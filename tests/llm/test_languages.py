import random

from pairloom.llm.languages import fit_languages, identify_languages

SYLLABLES = {"en": ["the", "ing", "er", "th", "and"], "de": ["sch", "ein", "ung", "ich", "ü"],
             "fr": ["eau", "é", "oi", "que", "les"]}


def text(rng, lang, size=40):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(size))


def test_languages(documents):
    rng = random.Random(2)
    rows = [(i, text(rng, lang), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    extra = [(900, None, "en"), (901, "", None), (902, "12 34 !?", "de"), (903, text(rng, "de"), None),
             (903, text(rng, "de"), None), (904, text(rng, "en", 60) + " " + text(rng, "fr", 30), None),
             (None, text(rng, "fr"), "fr"), (905, text(rng, "en", 60_000), None)]
    docs = documents([*rows, *extra])
    model = fit_languages(documents(rows[:90] + [(1, None, "xx"), (2, "word", None)]))
    assert model.languages == ("de", "en", "fr")
    found = identify_languages(docs, model).collect()
    assert len(found) == len(rows) + len(extra)
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[i].lang_pred == lang for i, _, lang in rows)
    for i in (900, 901, 902):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].languages) == ("und", 0.0, {})
    assert by_id[903].lang_pred == "de" and by_id[905].lang_pred == "en"
    mixed = by_id[904]
    assert mixed.lang_pred == "en" and set(mixed.languages) == {"en", "fr"}
    assert 0.5 < mixed.score < 0.85
    assert identify_languages(documents([]), model).count() == 0
    empty = fit_languages(documents([]))
    assert [r.lang_pred for r in identify_languages(documents([(1, "word")]), empty).collect()] == ["und"]
