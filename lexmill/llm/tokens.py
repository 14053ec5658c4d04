"""Encoding texts with a public byte-level BPE tokenizer, and back.

The tokenizers library encodes over Arrow batches. Its pre-tokenizer never joins characters across the place before a single space
that a non-space follows, so texts are cut there and each distinct cut is encoded once a worker: the words of a corpus repeat,
and the ids of a text are the ids of its cuts in order. The cache is emptied when it holds ``CACHE`` cuts, and long cuts are not
kept, so memory is bounded whatever the texts are.

Defined results: null and empty texts give an empty list; special tokens in a text are ordinary text; equal rows give
equal lists; texts of any length are encoded whole; lone surrogates do not occur in Spark strings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
CACHE, LONGEST = 200_000, 64
#: Before a space that something other than Unicode white space follows.
_SPLIT = re.compile(" (?=[^\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000])")


@lru_cache(maxsize=2)
def _load(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


class Encoder:
    """Encodes texts by way of their cuts."""

    def __init__(self, path: str = TOKENIZER):
        self.tokenizer = _load(path)
        self.first: dict[str, list[int]] = {}
        self.later: dict[str, list[int]] = {}

    def _learn(self, cuts: set[str], cache: dict[str, list[int]], space: str) -> dict[str, list[int]]:
        if len(cache) > CACHE:
            cache.clear()
        new = [c for c in cuts if c not in cache]
        if not new:
            return cache
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([space + c for c in new], add_special_tokens=False)]
        fresh = dict(zip(new, ids))
        cache.update((c, i) for c, i in fresh.items() if len(c) <= LONGEST)
        return {c: cache[c] if c in cache else fresh[c] for c in cuts}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        parts = [_SPLIT.split(t) if t else None for t in texts]
        first = self._learn({p[0] for p in parts if p}, self.first, "")
        later = self._learn({c for p in parts if p for c in p[1:]}, self.later, " ")
        out = []
        for p in parts:
            ids: list[int] = []
            if p:
                ids += first[p[0]]
                for c in map(later.__getitem__, p[1:]):
                    ids += c
            out.append(ids)
        return out

    def counts(self, texts: list[str | None]) -> list[int]:
        return [len(i) for i in self.encode(texts)]


@lru_cache(maxsize=2)
def byte_table(path: str = TOKENIZER) -> tuple[bytes, ...]:
    """The bytes of every id. Vocabulary entries spell bytes as printable characters; the rest of the 256 follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    to_byte = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}
    vocab = _load(path).get_vocab()
    table = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        table[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
    return tuple(table)


def decode(ids: list[int], path: str = TOKENIZER) -> str:
    """The text of the ids; characters split over several ids are joined before they are read."""
    table = byte_table(path)
    return b"".join(table[i] for i in ids).decode("utf-8", errors="replace")


def offsets(text: str, ids: list[int], path: str = TOKENIZER) -> list[tuple[int, int]]:
    """The range of characters that each id touches; ids that share a split character all touch it."""
    if not ids:
        return []
    table = byte_table(path)
    ends = np.cumsum([len(table[i]) for i in ids])
    starts = ends - [len(table[i]) for i in ids]
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    at = np.cumsum((raw & 0xC0) != 0x80) - 1  # byte to character
    return list(zip(at[starts].tolist(), (at[ends - 1] + 1).tolist()))


def _encode(batches: Iterator[pa.RecordBatch], path: str, what: str) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(path)
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            ids = encoder.encode(part.column(1).to_pylist())
            if what == "ids":
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(ends[-1]))
                column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            else:
                column = pa.array(map(len, ids), pa.int64())
            yield pa.record_batch([part.column(0), column], ["id", what])


def encode(texts: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, ids array<int>) of every row."""
    rows = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return spread(rows).mapInArrow(partial(_encode, path=tokenizer, what="ids"), "id bigint, ids array<int>")


def count_tokens(texts: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, n bigint) of every row, without building the lists in the result."""
    rows = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return spread(rows).mapInArrow(partial(_encode, path=tokenizer, what="n"), "id bigint, n bigint")


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            yield pa.record_batch([part.column(0), pa.array([decode(i or [], path) for i in part.column(1).to_pylist()], pa.string())], ["id", "text"])


def decode_ids(encoded: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, text) of every row (id, ids); null and empty lists give an empty text."""
    return encoded.select("id", "ids").mapInArrow(partial(_decode, path=tokenizer), "id bigint, text string")


def _offsets(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(path)
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            texts = part.column(1).to_pylist()
            spans = [offsets(t or "", i, path) for t, i in zip(texts, encoder.encode(texts))]
            sides = [pa.array([[x[k] for x in s] for s in spans], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.record_batch([part.column(0), *sides], ["id", "starts", "ends"])


def token_offsets(texts: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, starts, ends) of every row: the range of characters of each id of its text."""
    rows = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return spread(rows).mapInArrow(partial(_offsets, path=tokenizer), "id bigint, starts array<int>, ends array<int>")
