"""Encoding by a table of distinct words, and decoding by a table of pieces."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairloom.llm.common import arrow_batches, id_and_text, partitions

#: Words of a block of documents, within which a word is sent to the table once; bounds a task's memory.
BLOCK_WORDS = 4_000_000
#: Words of a group of documents that travels as one row.
CHUNK_WORDS = 200_000
#: Words encoded at a time.
ENCODE_WORDS = 20_000


class _Payload:
    """Compressed lists. Positions count up mostly, so their differences are stored, byte by byte plane."""

    def __init__(self):
        self.packer = zstandard.ZstdCompressor(level=3)
        self.unpacker = zstandard.ZstdDecompressor()

    def pack(self, data: bytes) -> bytes:
        return self.packer.compress(data)

    def unpack(self, data: bytes) -> bytes:
        return self.unpacker.decompress(data)

    def pack_numbers(self, values: np.ndarray) -> bytes:
        return self.pack(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())

    def unpack_numbers(self, data: bytes) -> np.ndarray:
        planes = np.frombuffer(self.unpack(data), np.uint8).reshape(4, -1)
        return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _mark_new(numbers: np.ndarray, known: int) -> np.ndarray:
    """0 for a word's first occurrence, which is always the next unused number, else its number + 1."""
    before = np.maximum.accumulate(np.concatenate([[known - 1], numbers]))[:-1]
    return np.where(numbers > before, 0, numbers + 1)


def _unmark_new(marked: np.ndarray, known: int) -> np.ndarray:
    new = marked == 0
    return np.where(new, known + np.cumsum(new) - 1, marked.astype(np.int64) - 1)


class _Block:
    """Documents whose words are numbered together, by first occurrence."""

    def __init__(self):
        self.table, self.docs, self.size = {}, [], 0

    def add(self, key: int | None, text: str) -> None:
        table = self.table
        words = text.encode().split()
        numbers = [table.setdefault(word, len(table)) for word in words]
        self.docs.append((key, np.array(numbers, np.int64)))
        self.size += len(words)

    def name(self) -> int:
        """The block is named by its words in order, so blocks of one name number words alike."""
        return xxhash.xxh3_64_intdigest(b"\n".join(self.table)) >> 1

    def word_rows(self, shares: int, payload: _Payload):
        """The distinct words by share of the table: ``block, share, numbers, words``."""
        words = list(self.table)
        share = np.fromiter((zlib.crc32(w) for w in words), np.uint32, len(words)) % shares
        name = self.name()
        order = np.argsort(share, kind="stable")
        ends = np.searchsorted(share[order], np.arange(shares + 1))
        for k in range(shares):
            mine = order[ends[k] : ends[k + 1]]
            if len(mine):
                yield (
                    name, k, payload.pack_numbers(np.diff(mine, prepend=0)),
                    payload.pack(b"\n".join(words[i] for i in mine)),
                )

    def doc_rows(self, payload: _Payload):
        """``block, known, keys, sizes, numbers`` for groups of documents, in order."""
        name, known, group, size = self.name(), 0, [], 0
        for at, (key, numbers) in enumerate(self.docs):
            group.append((key, numbers))
            size += len(numbers)
            if size >= CHUNK_WORDS or at == len(self.docs) - 1:
                flat = np.concatenate([x for _, x in group])
                yield (
                    name, known, [k for k, _ in group], [len(x) for _, x in group],
                    payload.pack_numbers(_mark_new(flat, known)),
                )
                known = max(known, int(flat.max()) + 1 if len(flat) else 0)
                group, size = [], 0


def _blocks(batches, block_words: int):
    block = _Block()
    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            block.add(key, text)
            if block.size >= block_words:
                yield block
                block = _Block()
    if block.docs:
        yield block


_WORDS = {
    "block": pa.int64(), "share": pa.int64(), "numbers": pa.binary(),
    "words": pa.binary(),
}
_DOCS = {
    "block": pa.int64(), "known": pa.int64(), "keys": pa.list_(pa.int64()),
    "sizes": pa.list_(pa.int64()), "numbers": pa.binary(),
}


def encode_words(words: DataFrame, tokenizer: str) -> DataFrame:
    """Encode each distinct word of ``words`` (rows of `_Block.word_rows`) once.

    A share of the words, with all blocks' rows for it, is one key. The ids go back with the positions
    the words came from: ``block, numbers, counts, ids``.
    """
    build = arrow_batches({
        "block": pa.int64(), "numbers": pa.binary(), "counts": pa.binary(), "ids": pa.binary(),
    })

    def encode(batches):
        encoder, payload = Tokenizer.from_file(tokenizer), _Payload()
        encoder.no_truncation()
        encoder.no_padding()
        current, table = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["share"] != current:
                    current, table = row["share"], {}
                words = payload.unpack(row["words"]).split(b"\n")
                fresh = [w for w in words if w not in table]
                for start in range(0, len(fresh), ENCODE_WORDS):
                    part = fresh[start : start + ENCODE_WORDS]
                    found = encoder.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
                    table.update((w, np.array(x.ids, "<u4").tobytes()) for w, x in zip(part, found))
                ids = [table[w] for w in words]
                counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                flat = np.frombuffer(b"".join(ids), "<u4")
                yield build(
                    [row["block"]], [row["numbers"]],
                    [payload.pack_numbers(counts)], [payload.pack_numbers(flat)],
                )

    count = partitions(words.sparkSession)
    return words.repartition(count, "share").sortWithinPartitions("share").mapInArrow(
        encode, "block long, numbers binary, counts binary, ids binary"
    )


def encode_documents(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``doc_id, ids (array of int), pieces (their decoded text)`` of whole texts,."""
    return _joined(docs, tokenizer, key, text, block_words, digests=False)


def encode_digests(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: digests of what `encode_documents` gives."""
    return _joined(docs, tokenizer, key, text, block_words, digests=True)


def _joined(docs, tokenizer, key, text, block_words, digests) -> DataFrame:
    """Split, encode each distinct word once, join ids back by position.

    Texts are cut at ASCII white space only, which no token of a word-end vocabulary spans; the tokenizer
    does the rest within a word. A block of documents numbers its distinct words and sends each one to
    its share of the table once, however often it occurs; so a frequent word makes one entry per block.
    Its ids come back under the same number and replace the numbers in the block's documents. Decoding
    joins ids with the pieces of the vocabulary, a table of fixed size that each task loads.

    The documents are read twice, for their words and for their numbers, rather than written down. Both
    readings must meet the same rows in the same order; a block is named by a hash of its words, and the
    job fails where a block has no answer, so materialize an input that is no stable table.

    A null or empty text has no ids and an empty decoded text; rows that repeat are encoded each on their
    own, a null id is kept, an empty table gives no rows.
    """
    source, shares = id_and_text(docs, key, text), partitions(docs.sparkSession)
    build_words, build_docs = arrow_batches(_WORDS), arrow_batches(_DOCS)

    def to_words(batches):
        payload = _Payload()
        for block in _blocks(batches, block_words):
            for row in block.word_rows(shares, payload):
                yield build_words(*([value] for value in row))

    def to_docs(batches):
        payload = _Payload()
        for block in _blocks(batches, block_words):
            for row in block.doc_rows(payload):
                yield build_docs(*([value] for value in row))

    words = source.mapInArrow(
        to_words, "block long, share long, numbers binary, words binary"
    )
    numbered = source.mapInArrow(
        to_docs,
        "block long, known long, keys array<long>, sizes array<long>, numbers binary",
    )
    coded = encode_words(words, tokenizer)
    none = F.lit(None)
    rows = coded.select(
        "block", F.lit(-1).cast("long").alias("known"), none.cast("array<long>").alias("keys"),
        none.cast("array<long>").alias("sizes"), "numbers", "counts", "ids",
    ).unionByName(numbered.select(
        "block", "known", "keys", "sizes", "numbers",
        none.cast("binary").alias("counts"), none.cast("binary").alias("ids"),
    ))
    rows = rows.repartition(shares, "block").sortWithinPartitions("block", "known")

    def assemble(batches):
        payload = _Payload()
        pieces = _pieces(tokenizer)
        current, ids, decoded, pending = None, [], [], []

        def close():
            """Put the block's answers at their numbers."""
            size = sum(len(x[0]) for x in pending)
            table, texts = [b""] * size, [b""] * size
            for numbers, coded_ids, counts in pending:
                flat = coded_ids.tolist()
                raw = coded_ids.tobytes()
                at = 0
                for number, count in zip(numbers.tolist(), counts.tolist()):
                    table[number] = raw[4 * at : 4 * (at + count)]
                    texts[number] = b" ".join([pieces[i] for i in flat[at : at + count]])
                    at += count
            pending.clear()
            return table, texts

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["block"] != current:
                    current, ids, decoded = row["block"], [], []
                    pending.clear()
                if row["known"] < 0:
                    numbers = np.cumsum(payload.unpack_numbers(row["numbers"]).astype(np.int64))
                    pending.append((
                        numbers, payload.unpack_numbers(row["ids"]), payload.unpack_numbers(row["counts"])
                    ))
                    continue
                if pending:
                    ids, decoded = close()
                if not ids and any(row["sizes"]):
                    raise ValueError("the documents changed between two readings; materialize them first")
                numbers = _unmark_new(payload.unpack_numbers(row["numbers"]), row["known"]).tolist()
                start = 0
                for key, size in zip(row["keys"], row["sizes"]):
                    part = numbers[start : start + size]
                    start += size
                    raw = b"".join([ids[i] for i in part])
                    words = [decoded[i] for i in part]
                    text = b" ".join(words if b"" not in words else [w for w in words if w])
                    if digests:
                        out.append((
                            key, len(raw) // 4, hashlib.sha256(raw).hexdigest(),
                            hashlib.sha256(text).hexdigest(),
                        ))
                    else:
                        out.append((key, np.frombuffer(raw, "<u4").tolist(), text.decode()))
            if out:
                yield (build_digests if digests else build_whole)(*zip(*out))

    build_digests = arrow_batches({
        "doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(),
        "decoded_sha256": pa.string(),
    })
    build_whole = arrow_batches({
        "doc_id": pa.int64(), "ids": pa.list_(pa.int32()), "pieces": pa.string(),
    })
    return rows.mapInArrow(
        assemble,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests
        else "doc_id long, ids array<int>, pieces string",
    )


def _pieces(tokenizer: str) -> list[bytes]:
    """The piece of each id. A vocabulary without a decoder joins pieces by blanks."""
    encoder = Tokenizer.from_file(tokenizer)
    if encoder.decoder is not None:
        raise ValueError("only vocabularies without a decoder are decoded piece by piece")
    vocabulary = encoder.get_vocab(with_added_tokens=True)
    pieces = [b""] * (max(vocabulary.values()) + 1)
    for piece, number in vocabulary.items():
        pieces[number] = piece.encode()
    return pieces
