import random
from collections import Counter

import numpy as np

from pairloom.llm.outliers import quality_rules, repeated_words, text_counts


def brute_repeats(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)})


def test_counts():
    rng = random.Random(4)
    for _ in range(200):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 30))]
        assert repeated_words(words) == brute_repeats(words)
    assert text_counts("a b\na b\n \n\na b\nc#*") == (7, 9, 2, 2, 6, 4)
    assert text_counts("") == (0, 0, 0, 0, 0, 0)
    assert text_counts("é x") == (1, 3, 0, 0, 0, 1)


def prose(rng, size):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(size))


def test_rules(documents):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(60, 400)), "en", "s1") for i in range(150)]
    rows += [(200 + i, prose(rng, 100).replace(" ", "*** "), "en", "s1") for i in range(20)]
    rows += [
        (300, None, "en", "s1"), (301, "", None, None), (302, "short text", "en", "s1"),
        (303, "again and " * 60, "en", "s1"), (304, prose(rng, 90), None, "s1"), (305, prose(rng, 80), "xx", "y"),
        (306, prose(rng, 70), "en", None), (306, prose(rng, 70), "en", None), (None, prose(rng, 70), "en", "s1"),
    ]
    found = quality_rules(documents(rows)).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[i].kept for i in [*range(150), 304, 305, 306, None])
    assert not any(by_id[200 + i].kept or by_id[200 + i].base_failed for i in range(20))
    assert all(by_id[i].base_failed and not by_id[i].kept for i in (300, 301, 302, 303))
    assert by_id[300].n_words == 0 and by_id[300].distance is None
    assert quality_rules(documents([])).count() == 0


def test_estimate_is_a_brute_force_mcd(documents):
    """Distances equal those of concentration steps over the whole group in numpy."""
    from pairloom.llm import outliers

    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(60, 300)) + " #" * rng.randint(0, 3), "en", "s") for i in range(80)]
    found = quality_rules(documents(rows)).collect()
    x = []
    for _, text, *_ in rows:
        n, chars, symbols, repeats, again, lines = text_counts(text)
        x.append([np.log(chars / n), np.log1p(100 * symbols / n), np.log1p(10 * repeats / lines),
                  np.log1p(100 * again / n)])
    x = np.array(x)
    floor = np.square(list(outliers.FEATURES.values()))

    def sound(cov):
        out = outliers.CORRELATED * cov
        np.fill_diagonal(out, np.maximum(np.diag(cov), floor))
        return out

    rounded = np.round(x * outliers.VALUE_BINS) / outliers.VALUE_BINS

    def median(values):
        return np.sort(values)[(len(values) - 1) // 2]

    center = np.array([median(c) for c in rounded.T])
    spread = np.array([1.4826 * median(np.abs(c - m)) for c, m in zip(rounded.T, center)])
    cov = sound(np.diag(spread**2))
    for step in range(5):
        inverse = np.linalg.inv(cov)
        d2 = np.einsum("ij,jk,ik->i", x - center, inverse, x - center)
        bins = np.ceil(np.log2(np.maximum(d2, 2.0**-20)) * outliers.DISTANCE_BINS)
        if step == 4:
            inside = bins <= np.floor(np.log2(outliers.CHI2_INSIDE) * outliers.DISTANCE_BINS)
            center, cov = x[inside].mean(0), sound(outliers.CHI2_FACTOR * np.cov(x[inside].T, bias=True))
            continue
        inside = bins <= np.sort(bins)[max(40, (80 + 5) // 2) - 1]
        center, cov = x[inside].mean(0), sound(np.cov(x[inside].T, bias=True))
        if step == 3:
            cov = cov * max(1.0, 2.0 ** (np.sort(bins)[39] / outliers.DISTANCE_BINS) / outliers.CHI2_MEDIAN)
    want = np.sqrt(np.einsum("ij,jk,ik->i", x - center, np.linalg.inv(cov), x - center))
    got = np.array([r.distance for r in sorted(found, key=lambda r: r.doc_id)])
    assert np.allclose(got, want, rtol=1e-6)


def odd_in_one(statistic, rng):
    """A text of 200 words that is odd in one statistic and as clean as the others in the rest."""
    words = prose(rng, 200).split()
    if statistic == "word_length":
        return " ".join(word * 3 for word in words)
    if statistic == "symbol_rate":
        return " ".join(word + "#" * (i % 3 == 0) for i, word in enumerate(words))
    if statistic == "line_repeats":  # four lines of five are one word, always the same
        return "\n".join(["zz"] * 80 + [prose(rng, 20) for _ in range(20)])
    return " ".join(words[:106] + words[:47] + words[106:])


def test_each_statistic_rejects_on_its_own(documents):
    from pairloom.llm import outliers

    # What a text can reach in the two bounded statistics lies beyond the cutoff.
    cutoff = outliers.CHI2_CUTOFFS[0.001] ** 0.5
    assert np.log1p(10) / outliers.FEATURES["line_repeats"] > cutoff
    assert np.log1p(50) / outliers.FEATURES["word_repeats"] > cutoff

    rng = random.Random(12)
    clean = [(i, "\n".join(prose(rng, 20) for _ in range(10)), "en", "s") for i in range(300)]
    for at, name in enumerate(outliers.FEATURES):
        text = odd_in_one(name, rng)
        found = {r.doc_id: r for r in quality_rules(documents([*clean, (1000, text, "en", "s")])).collect()}
        assert not found[1000].base_failed and not found[1000].kept, name
        assert sum(not r.kept for r in found.values()) <= 4
