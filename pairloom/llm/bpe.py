"""Byte-pair encoding of whole texts inside a task.

The ids are those of the ``tokenizers`` library for the same byte-level vocabulary. Words recur, so a
worker encodes each once while it is in its cache. A text may be cut at a blank between two characters
that are no white space: no token of this vocabulary's splitting pattern spans such a place.
"""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken

from pairloom.llm.common import CACHE_WORDS

#: Fixed value: how byte-level vocabularies of this kind split a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_DOUBLE_SPACE = re.compile(r"\s\s")
_CLEAN_BLANK = re.compile(r"(?<=\S) (?=\S)")


def byte_of_symbol() -> dict[str, int]:
    """The printable symbol that stands for each byte in such vocabularies, the other way round."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe(dict):
    """Encoder of a byte-level ``tokenizer.json``; as a dict, the ids of `` word`` by ``word``."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        symbols = byte_of_symbol()
        special = {t["content"]: t["id"] for t in made["added_tokens"]}
        ranks = {
            bytes(symbols[c] for c in piece): rank
            for piece, rank in made["model"]["vocab"].items() if piece not in special
        }
        self.encoding = tiktoken.Encoding(
            path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special
        )
        size = max([*ranks.values(), *special.values()]) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.lengths = np.zeros(size, np.int64)
        for piece, rank in ranks.items():
            self.lengths[rank] = len(piece)
        for text, rank in special.items():
            self.lengths[rank] = len(text.encode())

    def _encode(self, text: str) -> bytes:
        ids = self.encoding.encode(text, allowed_special="all")
        return np.array(ids, self.dtype).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = self._encode(" " + word)
        if len(word) < 64:
            self[word] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """The ids of the whole text."""
        clean = not (_DOUBLE_SPACE.search(text) or text[:1].isspace() or text[-1:].isspace())
        first, *rest = text.split(" ") if clean else _CLEAN_BLANK.split(text)
        return np.frombuffer(self._encode(first) + b"".join(map(self.__getitem__, rest)), self.dtype)


_loaded: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    """The encoder of this file, made once per worker."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]
