import hashlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers
from tokenizers import Tokenizer

from pairloom.llm.word_table import encode_digests, encode_documents

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "a b   c", "<|endoftext|>x <|startoftext|>", "É é é ́x", "Σας ΣΑΣ",
    "\x1c a\x1fb", "it's DON'T 12a3 #$%!", "日本 😀‍👩 x", "İI ß ŉ", "x" * 5000 + " y",
    " q 　w\u0085e", "the the the", "the the the", "word " * 3000,
]


@pytest.mark.parametrize("block_words", [4, 1_000_000])
def test_equals_the_library(documents, block_words):
    library = Tokenizer.from_file(PATH)
    docs = documents([*enumerate(TEXTS), (3, TEXTS[3]), (None, "no id")])
    whole = encode_documents(docs, PATH, block_words=block_words).collect()
    digests = encode_digests(docs, PATH, block_words=block_words).collect()
    assert len(whole) == len(digests) == len(TEXTS) + 2
    for r in whole:
        ids = library.encode("no id" if r.doc_id is None else TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.pieces == library.decode(ids, skip_special_tokens=False)
    for r in digests:
        ids = library.encode("no id" if r.doc_id is None else TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert encode_digests(documents([]), PATH).count() == 0
