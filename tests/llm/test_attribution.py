import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers
from tokenizers import Tokenizer

from pairloom.llm import bpe
from pairloom.llm.attribution import attribute_tokens, line_bounds, token_spans

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["one line", "two\nlines \n\n here", "é😀 日本\n語 text", "x" * 300 + "\n" + "word " * 4000, "\n", "a  \n  b"]


def brute(text, bounds, rule):
    """Counts per section, from the spans of the tokenizer library."""
    found = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False)
    counts = [0] * (len(bounds) - 1)
    for start, end in found.offsets:
        overlap = [max(0, min(end, b) - max(start, a)) for a, b in zip(bounds, bounds[1:])]
        first = next(i for i, n in enumerate(overlap) if n)
        counts[first if rule == "first" else overlap.index(max(overlap))] += 1
    return counts


def test_spans_are_the_librarys():
    for text in TEXTS:
        want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).offsets
        starts, ends = token_spans(text, bpe.load(PATH))
        assert list(zip(starts.tolist(), ends.tolist())) == want


@pytest.mark.parametrize("rule", ["first", "most"])
def test_counts(spark, documents, rule):
    docs = documents([*enumerate(TEXTS), (90, None), (91, ""), (None, "a\nb"), (0, TEXTS[0])])
    rows = attribute_tokens(docs, PATH, rule=rule).collect()
    for i, text in enumerate(TEXTS):
        mine = sorted((r.section, r.n_tokens) for r in rows if r.doc_id == i)
        want = brute(text, line_bounds(text).tolist(), rule)
        assert mine == sorted([*enumerate(want)] * (2 if i == 0 else 1))
    assert [(r.section, r.n_tokens, r.end) for r in rows if r.doc_id in (90, 91)] == [(0, 0, 0)] * 2
    assert attribute_tokens(documents([]), PATH).count() == 0

    cut = spark.createDataFrame(
        [(i, t, [3, 3, 7, 9_999_999, -4, None]) for i, t in enumerate(TEXTS)] + [(50, "abc", None)],
        "doc_id long, text string, cuts array<long>",
    )
    rows = attribute_tokens(cut, PATH, bounds="cuts", rule=rule).collect()
    for i, text in enumerate(TEXTS):
        bounds = sorted({0, len(text), *(x for x in (3, 7) if x < len(text))})
        mine = [r.n_tokens for r in sorted(rows, key=lambda r: r.section) if r.doc_id == i]
        assert mine == brute(text, bounds, rule)
    with pytest.raises(ValueError):
        attribute_tokens(cut, PATH, rule="half")
