"""Encoding of a corpus with a public tokenizer, and back.

Arrow batches of texts go through the tokenizers library (byte-level BPE). Results are defined for
every text: null and empty texts have an empty list; text that looks like a special token is
ordinary text; no special tokens are added; texts are encoded whole, whatever their length; repeated
rows are encoded alike; an empty table gives an empty table. Other columns of the input are ignored.
Lone surrogates can't occur, as Spark's strings are UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from seqloom.llm.texts import TOKENIZERS, batches, loaded, sent_along


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes
    stand for themselves, the others for the characters from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in table:
            table[b], extra = chr(extra), extra + 1
    return [table[b] for b in range(256)]


def token_bytes(vocabulary: dict[str, int]) -> list[bytes]:
    """The bytes of each id."""
    back = {c: b for b, c in enumerate(byte_characters())}
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, k in vocabulary.items():
        out[k] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return out


def decoded(ids: list[int], table: list[bytes]) -> str:
    """The text of ids. Bytes of a character that ids cut in two become U+FFFD, as each end is incomplete."""
    return b"".join([table[k] for k in ids]).decode("utf-8", errors="replace")


def _lists(column, flat: list) -> pa.Array:
    offsets = [0]
    for x in column:
        offsets.append(offsets[-1] + x)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


def encoded(df: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids array<int>) of each row."""
    vocabulary = sent_along(df.sparkSession, name, folder)

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(vocabulary.value)
        for part in parts:
            sizes, flat = [], []
            for some in batches([x or "" for x in part.column(1).to_pylist()]):
                for e in tokenizer.encode_batch(some, add_special_tokens=False):
                    ids = e.ids
                    sizes.append(len(ids))
                    flat += ids
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(sizes, flat)], [doc_id, "ids"])

    return df.select(doc_id, text).mapInArrow(encode, f"`{doc_id}` bigint, ids array<int>")


def with_offsets(df: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """One row per token: (doc_id, position, id, char_start, char_end, byte_start, byte_end).

    Bytes are exact. A token that holds only a part of a character spans that whole character.
    """
    vocabulary = sent_along(df.sparkSession, name, folder)

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        tokenizer = loaded(vocabulary.value)
        sizes = np.array([len(b) for b in token_bytes(tokenizer.get_vocab())])
        for part in parts:
            ids_, texts = part.column(0).to_pylist(), [x or "" for x in part.column(1).to_pylist()]
            for doc, t in zip(ids_, texts, strict=True):
                ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids, np.int64)
                if not len(ids):
                    continue
                ends = np.cumsum(sizes[ids])
                starts = ends - sizes[ids]
                raw = np.frombuffer(t.encode(), np.uint8)
                number = np.cumsum((raw & 0xC0) != 0x80) - 1  # of the character that each byte belongs to
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), pa.array(ids.astype(np.int32)), pa.array(number[starts].astype(np.int32)), pa.array((number[ends - 1] + 1).astype(np.int32)), pa.array(starts.astype(np.int32)), pa.array(ends.astype(np.int32))],
                    [doc_id, "position", "id", "char_start", "char_end", "byte_start", "byte_end"],
                )

    return df.select(doc_id, text).mapInArrow(encode, f"`{doc_id}` bigint, position int, id int, char_start int, char_end int, byte_start int, byte_end int")


def back_to_text(df: DataFrame, doc_id: str = "doc_id", ids: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, text) of lists of ids; a null list gives an empty text."""
    vocabulary = sent_along(df.sparkSession, name, folder)

    def decode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(loaded(vocabulary.value).get_vocab())
        for part in parts:
            texts = [decoded(x or [], table) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], [doc_id, "text"])

    return df.select(doc_id, ids).mapInArrow(decode, f"`{doc_id}` bigint, text string")
