import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers
from tokenizers import Tokenizer

from pairloom.llm import bpe
from pairloom.llm.packing import best_fill, pack_documents, pack_lengths

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute_fill(counts, room):
    sums = {0}
    for length, n in counts.items():
        sums = {s + length * k for s in sums for k in range(n + 1) if s + length * k <= room}
    return max(sums)


def test_fill_is_the_closest_sum():
    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(rng.randint(0, 6))}
        room = rng.randint(0, 90)
        picked = best_fill(counts, room)
        assert all(n <= counts[length] for length, n in picked)
        assert sum(length * n for length, n in picked) == brute_fill(counts, room)


@pytest.mark.parametrize("lengths", [
    [], [5], [600] * 50, [1] * 300, [1023] * 40, [random.Random(1).randint(1, 1023) for _ in range(400)],
])
def test_windows_hold_each_part_once_and_are_not_padded(lengths):
    parts = defaultdict(list)
    for window in pack_lengths(lengths, 1024):
        size = sum(x[2] for x in window)
        assert size == 1024 or (size < 1024 and size & (size - 1) == 0)
        for item, start, length in window:
            parts[item].append((start, length))
    for item, length in enumerate(lengths):
        at = 0
        for start, size in sorted(parts[item]):
            assert start == at
            at += size
        assert at == length


def test_ids_are_the_librarys():
    encoder, library = bpe.load(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(3)
    texts = ["", "a  b\n\n c ", "x<|endoftext|> y <|endoftext|>", " \x85q　r", "it's 12a", "w" * 200 + " y"]
    texts += ["".join(rng.choice(" \n\tabZé'sd1٣.,!😀́\x1c\x85 <|>") for _ in range(25)) for _ in range(2000)]
    for text in texts:
        assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_pieces(documents):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "délta", "ε"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 900)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "same"), (102, "same"), (None, "no id"), (103, "long word " * 9000)]
    found = pack_documents(documents(rows), PATH, block_docs=20).collect()
    library = Tokenizer.from_file(PATH)
    ids = defaultdict(list)
    for key, text in rows:
        ids[key].append(np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
        assert any(
            zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and len(x) == r.doc_tokens
            for x in ids[r.doc_id]
        )
    for key, own in ids.items():
        assert sum(r.length for r in pieces[key]) == sum(map(len, own))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0
    assert pack_documents(documents([]), PATH).count() == 0
