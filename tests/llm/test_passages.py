import random

import numpy as np
import pyarrow as pa
import pytest

from pairloom.llm import passages
from pairloom.llm.passages import (
    SHINGLE, least_values, paragraph_starts, paragraphs, reach, remove_passages, repeated_passages,
    without_words,
)
from pairloom.llm.common import shingle_hashes, word_hashes


def prose(rng, size):
    return [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.randint(0, 4000)}" for _ in range(size)]


def brute(rows, size):
    """Documents that share a run of this many words with another one."""
    seen = {}
    for key, text in rows:
        w = (text or "").lower().split()
        for i in range(len(w) - size + 1):
            seen.setdefault(tuple(w[i : i + size]), set()).add(key)
    return {key for keys in seen.values() if len(keys) > 1 for key in keys}


def test_repeats_are_found_and_clean_texts_left(documents):
    rng = random.Random(11)
    shared = [prose(rng, n) for n in (60, 80, 120)]
    rows = []
    for i in range(60):
        w = prose(rng, rng.randint(100, 400))
        if i % 3 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = shared[i % 9 // 3]
        rows.append((i, " ".join(w) if i % 2 else "\n".join([" ".join(w[:9]), " ".join(w[9:])])))
    edited = list(shared[2])
    edited[60] = "changed"
    rows += [(70, " ".join(prose(rng, 50) + edited)), (80, None), (81, ""), (82, "two words"), (None, rows[0][1])]
    rows += [rows[4], (83, "Common line of text. " + " ".join(prose(rng, 60))), (84, "Common line of text. " + " ".join(prose(rng, 60)))]
    found = repeated_passages(documents(rows)).collect()
    want = brute([r for r in rows if r[0] is not None], 51)
    assert {r.doc_id for r in found} == want
    kept = {r.doc_id for r in found if not r.removed}
    assert kept == {0, 3, 6}
    spans = {r.doc_id: r for r in found}
    assert spans[70].n_words > 90
    cut = {r.doc_id: r.text for r in remove_passages(documents(rows), repeated_passages(documents(rows))).collect()}
    texts = dict(rows)
    assert set(cut) == set(texts)
    assert all(cut[i] == texts[i] for i in texts if i not in want or i in kept)
    assert not brute([(i, cut[i]) for i in want], 40)
    assert repeated_passages(documents([])).count() == 0


def test_own_words_between_common_phrases_stay(documents):
    rng = random.Random(14)
    phrases = [prose(rng, 40) for _ in range(12)]
    rows, own = [], {}
    for i in range(40):
        w, own[i] = [], []
        for phrase in rng.sample(phrases, 6):
            mine = [f"own{i}x{rng.randint(0, 10**9)}" for _ in range(rng.randint(6, 14))]
            own[i] += mine
            w += mine + phrase
        rows.append((i, " ".join(w)))
    docs = documents(rows)
    left = {r.doc_id: r.text.split() for r in remove_passages(docs, repeated_passages(docs)).collect()}
    lost = sum(len(set(own[i]) - set(left.get(i, []))) for i in own)
    gone = sum(len(set(sum(phrases, [])) - set(words)) for words in left.values())
    assert gone and lost <= 0.03 * sum(map(len, own.values()))


def test_copies_lose_all(documents):
    rng = random.Random(12)
    text = " ".join(prose(rng, 90))
    docs = documents([(1, text), (2, text.upper()), (3, text), (4, " ".join(prose(rng, 30)))])
    found = repeated_passages(docs)
    assert {(r.doc_id, r.removed, r.n_words) for r in found.collect()} == {(1, False, 90), (2, True, 90), (3, True, 90)}
    left = remove_passages(docs, found)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {1, 4}


def test_cuts_do_not_depend_on_what_stands_before():
    rng = random.Random(13)
    passage = word_hashes([w.encode() for w in prose(rng, 80)])
    import numpy as np

    inside = []
    for size in (0, 31, 77):
        before = word_hashes([w.encode() for w in prose(rng, size)])
        starts = paragraph_starts(np.concatenate([before, passage])) - size
        inside.append([x for x in starts.tolist() if x >= 8])
    assert inside[0] == inside[1] == inside[2]


def test_without_words():
    assert without_words(" a  b\nc d ", [(1, 3)]) == " a  d "
    assert without_words("a b", [(0, 2)]) == ""
    assert without_words("é x ü y", [(2, 4), (0, 1)]) == "x "


def test_edited_passages_are_found_whole(documents):
    rng = random.Random(15)
    rows, shared = [], {}
    for i in range(200):
        passage = prose(rng, 200)
        copy = [f"new{i}x{k}" if rng.random() < 0.04 else w for k, w in enumerate(passage)]
        rows.append((2 * i, " ".join(prose(rng, 50) + passage + prose(rng, 30))))
        rows.append((2 * i + 1, " ".join([f"own{i}x{k}" for k in range(40)] + copy + [f"own{i}y{k}" for k in range(60)])))
        shared[2 * i + 1] = copy
    docs = documents(rows)
    found = repeated_passages(docs)
    left = {r.doc_id: r.text.split() for r in remove_passages(docs, found).collect()}
    texts = dict(rows)
    assert all(left[i] == texts[i].split() for i in texts if i % 2 == 0)
    cut = sum(len(words) - len(set(words) & set(left[i])) for i, words in shared.items())
    assert cut >= 0.9 * sum(map(len, shared.values()))
    # a word beside a passage may be in a paragraph that is similar, not equal
    assert sum(w.startswith("own") for i in shared for w in left[i]) >= 0.99 * 100 * len(shared)
    kept = [r.n_words for r in found.collect() if not r.removed]
    assert sum(kept) >= 0.9 * 200 * 200


def test_only_what_is_shared_is_cut(documents):
    rng = random.Random(16)
    passage = prose(rng, 70)
    rows = [(i, " ".join([f"a{i}x{k}" for k in range(20 + i)] + passage + [f"b{i}x{k}" for k in range(25)])) for i in range(30)]
    # a phrase too short to be a passage, and two that are known from different documents
    phrase, other = prose(rng, 25), prose(rng, 25)
    mine = [f"mine{k}" for k in range(8)]
    rows += [(40, " ".join(phrase + [f"c{k}" for k in range(30)])), (41, " ".join(other + [f"d{k}" for k in range(30)]))]
    rows += [(42, " ".join(phrase + mine + other))]
    docs = documents(rows)
    spans = {(r.doc_id, r.start_word, r.end_word, r.removed) for r in repeated_passages(docs).collect()}
    assert spans == {(i, 20 + i, 90 + i, i > 0) for i in range(30)}


def test_reach():
    a = list("abcdefghijklmnop")
    assert reach(a, a) == (16, 16) and reach([], a) == (0, 0) == reach(a, [])
    assert reach(a, a[:5] + ["X"] + a[6:]) == (16, 16)  # changed
    assert reach(a, a[:5] + a[6:]) == (16, 15) and reach(a[:5] + a[6:], a) == (15, 16)  # left out, added
    assert reach(a, a[:5] + ["X"] * 3 + a[5:]) == (5, 5)  # too few equal ones follow
    assert reach(a * 2, a[:5] + ["X"] * 3 + a[5:] + a) == (32, 35)
    assert reach(a, list("abcdeXYZfg")) == (5, 5)


def test_very_long_texts_and_any_names(documents):
    from pyspark.sql import functions as F

    rng = random.Random(17)
    passage = prose(rng, 60)
    rows = [(1, " ".join(prose(rng, 150_000) + passage)), (2, " ".join(passage + prose(rng, 50))), (3, None), (4, "")]
    docs = documents(rows).withColumn("__spans__", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("start", F.lit("s"))
    found = repeated_passages(docs)
    assert {(r.doc_id, r.start_word, r.n_words, r.removed) for r in found.collect()} == {
        (1, 150_000, 60, False), (2, 0, 60, True),
    }
    left = remove_passages(docs, found)
    assert left.columns == docs.columns
    assert {r.doc_id: len((r.text or "").split()) for r in left.collect()} == {1: 150_060, 2: 50, 3: 0, 4: 0}


def linked_by_brute_force(texts, percent):
    """The component of each paragraph that is similar to another one."""
    sets = {}
    for text in texts:
        hashes = word_hashes(text.encode().lower().split())
        starts, sizes, contents, *_ = paragraphs(hashes, percent)
        for start, size, content in zip(starts, sizes, contents.view(np.int64).tolist()):
            sets[content] = set(shingle_hashes(hashes[start : start + size], SHINGLE).tolist())
    near = {content: {content} for content in sets}
    names = list(sets)
    for at, one in enumerate(names):
        for two in names[:at]:
            common = len(sets[one] & sets[two])
            if 100 * common >= percent * (len(sets[one]) + len(sets[two]) - common):
                near[one].add(two)
                near[two].add(one)
    least, waiting = {}, sorted(names)
    for first in waiting:
        queue = [first] if first not in least else []
        while queue:
            at = queue.pop()
            if least.setdefault(at, first) == first:
                queue += [other for other in near[at] if other not in least]
    return {content: least[content] for content in names if len(near[content]) > 1}


@pytest.mark.parametrize("percent, limit", [(80, 4096), (60, 4096), (80, 12)])
def test_all_similar_paragraphs_are_linked(documents, monkeypatch, percent, limit):
    """Also where a band's least member is unlike two others, and where no two MinHash values agree."""
    monkeypatch.setattr(passages, "BAND", limit)
    rng = random.Random(21)
    originals = [prose(rng, rng.randint(20, 60)) for _ in range(12)]
    common = prose(rng, 5)  # paragraphs that have one run in common, and little else
    texts = [" ".join(common + prose(rng, 9)) for _ in range(60)]
    for original in originals:
        for _ in range(20):
            words = list(original)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"new{rng.randint(0, 10**9)}"
            texts.append(" ".join(words))
    docs = documents(list(enumerate(texts)))
    found = passages.paragraph_components(docs, "doc_id", "text", percent).collect()
    want = linked_by_brute_force(texts, percent)
    assert len(set(want.values())) > 10
    assert {r.node: r.component for r in found} == want


def test_least_values_meet_at_the_threshold():
    rng = np.random.default_rng(3)
    for size in range(1, 61):
        for percent in (50, 80, 100):
            one = rng.integers(0, 2**63, size, dtype=np.uint64)
            for kept in range(size + 1):
                for more in range(3):
                    if 100 * kept < percent * (size + more):
                        continue
                    two = np.concatenate([one[:kept], rng.integers(0, 2**63, more, dtype=np.uint64)])
                    both = np.concatenate([one, two, two[:1]])
                    values, of = least_values(both, np.array([0, size]), np.array([size, len(two) + 1]), percent)
                    assert set(values[of == 0]) & set(values[of == 1])


def test_texts_are_cut_alike_together_and_alone():
    rng = random.Random(23)
    texts = [word_hashes([rng.choice((b"a", b"b", b"c")) for _ in range(n)]) for n in range(SHINGLE, 40)]
    texts += [word_hashes([w.encode() for w in prose(rng, n)]) for n in (5, 6, 7, 63, 64, 65, 300)]
    texts += [word_hashes([b"same"] * n) for n in (6, 7, 64, 65, 128, 129, 200)]
    rng.shuffle(texts)
    ends = np.cumsum([len(text) for text in texts])
    starts, sizes, contents, bands, of = paragraphs(np.concatenate(texts), 80, ends)
    at = np.searchsorted(ends, starts, side="right")
    for i, text in enumerate(texts):
        alone, mine = paragraphs(text, 80), np.flatnonzero(at == i)
        assert (starts[mine] - (ends[i] - len(text))).tolist() == alone[0].tolist()
        assert sizes[mine].tolist() == alone[1].tolist() and contents[mine].tolist() == alone[2].tolist()
        held = np.isin(of, mine)
        assert bands[held].tolist() == alone[3].tolist()
        assert (of[held] - mine[0]).tolist() == alone[4].tolist()


def test_short_texts_are_cut_many_at_a_time(monkeypatch):
    """A call for each text is most of the CPU time of the whole job."""
    rng, calls = random.Random(24), []

    def counted(hashes, *more):
        calls.append(len(hashes))
        return paragraphs(hashes, *more)

    class Source:
        def mapInArrow(self, cut, schema):
            texts = [" ".join(prose(rng, 30)) for _ in range(1000)]
            return list(cut([pa.RecordBatch.from_pydict({"key": list(range(1000)), "text": texts})]))

    monkeypatch.setattr(passages, "paragraphs", counted)
    monkeypatch.setattr(passages, "WORDS", 10_000, raising=False)
    assert sum(batch.num_rows for batch in passages._cut(Source(), 80)) >= 1000
    assert len(calls) <= 3 and sum(calls) == 30_000 and max(calls) < 10_030


def test_rows_with_one_id_and_unlike_texts(documents):
    rng = random.Random(25)
    rows = []
    for i in range(40):
        words = prose(rng, 60)
        rows += [(i, " ".join(words)), (i, " ".join(prose(rng, 60))), (i, "a short text of six words")]
        words[30] = f"new{i}"
        rows.append((100 + i, " ".join(words)))
    found = passages.paragraph_components(documents(rows)).collect()
    assert {r.node: r.component for r in found} == linked_by_brute_force([text for _, text in rows], 80)
