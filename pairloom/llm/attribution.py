"""Token counts of sections, from one encoding of the whole text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pairloom.checks import need_choice, need_columns, named
from pairloom.llm import bpe
from pairloom.llm.common import arrow_batches, id_and_text

RULES = ("first", "most")
_COLUMNS = {
    "doc_id": pa.int64(), "section": pa.int64(), "start": pa.int64(), "end": pa.int64(),
    "n_tokens": pa.int64(), "n_crossing": pa.int64(), "doc_tokens": pa.int64(),
}


def line_bounds(text: str) -> np.ndarray:
    """Where lines begin, and the end of the text; a line holds its line break."""
    ends, at = [0], text.find("\n")
    while at >= 0:
        ends.append(at + 1)
        at = text.find("\n", at + 1)
    if ends[-1] != len(text):
        ends.append(len(text))
    return np.array(ends, np.int64)


def token_spans(text: str, encoder: bpe.ByteBpe) -> tuple[np.ndarray, np.ndarray]:
    """The characters ``[start, end)`` of each token of the text.

    Tokens are runs of bytes that together are the text. Tokens that share a character have it both.
    """
    ends = np.cumsum(encoder.lengths[encoder.encode(text)])
    starts = np.concatenate([[0], ends])[:-1]
    if text.isascii():
        return starts, ends
    data = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((data & 0xC0) != 0x80) - 1  # the character of each byte
    return char[starts], char[ends - 1] + 1


def allocate(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str):
    """The section of each token, and whether it crosses a bound.

    ``first``: the section of the token's first character. ``most``: the section that has most of its
    characters, the first of those that have as many.
    """
    section = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, ends - 1, side="right") - 1
    crossing = last != section
    if rule == "most":
        for i in np.flatnonzero(crossing):
            cuts = np.clip(bounds[section[i] : last[i] + 2], starts[i], ends[i])
            section[i] += int(np.diff(cuts).argmax())
    return section, crossing


def attribute_tokens(
    docs: DataFrame, tokenizer: str, bounds: str | None = None, rule: str = "most",
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``doc_id, section, start, end, n_tokens, n_crossing, doc_tokens`` for each section of each text.

    A whole text is encoded once; each token's span of characters is looked up among the sections, which are
    ordered and leave no gap, so their counts add up to ``doc_tokens``. ``bounds`` names a column with the
    positions (array of long, increasing) at which sections begin after the first; without it, sections
    are lines with their line breaks. ``rule`` says who gets a token that crosses a bound (`allocate`);
    ``n_crossing`` counts those that a section got. ``section`` counts from 0.

    A null or empty text is one empty section without tokens; null bounds are none, bounds outside the text
    and repeated ones make no section; rows that repeat are counted each on its own; an empty table gives
    no rows.
    """
    need_choice(rule, RULES, "rule")
    build = arrow_batches(_COLUMNS)
    rows = id_and_text(docs, key, text)
    if bounds is not None:
        need_columns(docs, bounds)
        rows = docs.select(
            named(key).cast("long").alias("key"), named(text).alias("text"),
            named(bounds).cast("array<long>").alias("bounds"),
        )

    def count(batches):
        encoder = bpe.load(tokenizer)
        for batch in batches:
            given = batch.column("bounds").to_pylist() if bounds is not None else [None] * batch.num_rows
            out = []
            columns = (batch.column("key").to_pylist(), batch.column("text").to_pylist(), given)
            for key, text, cuts in zip(*columns):
                text = text or ""
                if bounds is None:
                    edges = line_bounds(text)
                else:
                    edges = np.array(sorted({0, len(text), *(
                        x for x in cuts or () if x is not None and 0 < x < len(text)
                    )}), np.int64)
                if not text:
                    out.append((key, 0, 0, 0, 0, 0, 0))
                    continue
                starts, ends = token_spans(text, encoder)
                section, crossing = allocate(starts, ends, edges, rule)
                size = len(edges) - 1
                tokens = np.bincount(section, minlength=size).tolist()
                crossed = np.bincount(section[crossing], minlength=size).tolist()
                edge = edges.tolist()
                out += [
                    (key, i, edge[i], edge[i + 1], tokens[i], crossed[i], len(starts))
                    for i in range(size)
                ]
            if out:
                yield build(*zip(*out))

    return rows.mapInArrow(count, ", ".join(f"{name} long" for name in _COLUMNS))
