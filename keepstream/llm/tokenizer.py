"""Encoding of a corpus by a public byte-level BPE, through a sentencepiece model.

The model is serialised here from the rank file alone: one piece per vocabulary
entry, its bytes mapped to printable characters, its score the negative rank,
with identity normalisation. Merging the best-scored pair first then is merging
the lowest rank first. Pre-tokens are cut by the public split pattern and encoded
one by one; a cache of pre-tokens makes the usual word one dictionary lookup.
Decoding maps the pieces' characters back to bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies lie unless a parameter says otherwise, and
#: the public split pattern of byte_bpe_50k.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens the cache of a Python worker may hold; longer ones than CACHED_CHARS are not kept.
CACHE_SIZE, CACHED_CHARS = 400_000, 48


def byte_chars() -> list[str]:
    """A printable character for each byte: printable Latin-1 stands for itself, the rest follows from U+0100."""
    out, extra = [], 0
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _int(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n & (1 << 64) - 1)


def _bytes(field: int, b: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(b)) + b


def model_proto(vocabulary: bytes) -> bytes:
    """The serialised sentencepiece model of a rank file (lines of base64 and rank)."""
    chars = byte_chars()
    ranked = sorted((int(r), base64.b64decode(t)) for t, r in (line.split() for line in vocabulary.splitlines() if line.strip()))
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must be consecutive from 0")
    out = bytearray()
    for rank, token in ranked:
        piece = "".join(chars[b] for b in token).encode()
        score = _varint(2 << 3 | 5) + struct.pack("<f", -float(rank))
        out += _bytes(1, _bytes(1, piece) + score + _int(3, 1))  # 1: a normal piece
    out += _bytes(1, _bytes(1, b"<unk>") + _int(3, 2))  # 2: the unknown piece, required and never met
    # model type 2 is BPE; no begin, end and padding pieces
    out += _bytes(2, _int(3, 2) + _int(40, len(ranked)) + _int(41, -1) + _int(42, -1) + _int(43, -1))
    # identity normalisation: no dummy prefix, white space neither removed nor escaped
    out += _bytes(3, _bytes(1, b"identity") + _int(3, 0) + _int(4, 0) + _int(5, 0))
    return bytes(out)


class _Words(dict):
    """What ``find`` gives for a pre-token, kept while there is room."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, word: str):
        value = self.find(word)
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHE_SIZE:
                self.clear()
            self[word] = value
        return value


class Encoder:
    """Encodes and decodes with one model; lives once per Python worker."""

    def __init__(self, proto: bytes):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.split = regex.compile(PATTERN).findall
        self.span = regex.compile(PATTERN).finditer
        self.table = dict(enumerate(byte_chars()))
        self.back = {c: b for b, c in self.table.items()}
        self.ids = _Words(self._one)
        self.sizes = _Words(lambda w: len(self.ids[w]))

    def _one(self, word: str) -> list[int]:
        return self.model.encode(word.encode().decode("latin-1").translate(self.table))

    def words(self, words: list[str]) -> list[list[int]]:
        """Ids of each pre-token."""
        return list(map(self.ids.__getitem__, words))

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.ids.__getitem__, self.split(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(self.sizes.__getitem__, self.split(text))) if text else 0

    def token_bytes(self, ids: list[int]) -> list[bytes]:
        return [bytes(self.back[c] for c in self.model.id_to_piece(i)) for i in ids]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.token_bytes(ids)).decode("utf-8", errors="replace")


_ENCODERS: dict[int, Encoder] = {}


def encoder(shared) -> Encoder:
    """The worker's encoder of a broadcast model."""
    if shared.id not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[shared.id] = Encoder(shared.value)
    return _ENCODERS[shared.id]


class _Shared:
    """A broadcast model and its identity."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self) -> bytes:
        return self.broadcast.value


def share(spark, vocabulary: str = VOCABULARY) -> _Shared:
    """The model of a vocabulary file, read by the driver and broadcast (about 1 MB, the vocabulary's own size)."""
    with open(vocabulary, "rb") as f:
        return _Shared(spark.sparkContext.broadcast(model_proto(f.read())))


def token_ids(df: DataFrame, text: str = "text", out: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` plus ``out``: the ids of ``text`` without special tokens.

    A null and an empty text give an empty list; a text that looks like a special
    token is ordinary text. Whole texts are encoded, whatever their length. Other
    columns pass through; a column called ``out`` is replaced.
    """
    shared = share(df.sparkSession, vocabulary)

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(shared)
        for b in batches:
            parts = [np.array(enc.encode(t.as_py()), np.int32) for t in b]
            ends = np.cumsum([0, *map(len, parts)], dtype=np.int64)
            if ends[-1] > np.iinfo(np.int32).max:
                raise OverflowError("a batch of more than 2^31 tokens: lower spark.sql.execution.arrow.maxRecordsPerBatch")
            yield pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate([np.empty(0, np.int32), *parts])))

    return df.withColumn(out, F.arrow_udf(encode, "array<int>")(F.col(text)))


def token_count(df: DataFrame, text: str = "text", out: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` plus ``out``: the number of tokens of ``text``, 0 for a null text."""
    shared = share(df.sparkSession, vocabulary)

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(shared)
        for b in batches:
            yield pa.array([enc.count(t.as_py()) for t in b], pa.int64())

    return df.withColumn(out, F.arrow_udf(count, "bigint")(F.col(text)))


def decoded(df: DataFrame, ids: str = "ids", out: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` plus ``out``: the text of a list of ids; null ids give a null text."""
    shared = share(df.sparkSession, vocabulary)

    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(shared)
        for b in batches:
            yield pa.array([None if i is None else enc.decode(i) for i in b.to_pylist()], pa.string())

    return df.withColumn(out, F.arrow_udf(decode, "string")(F.col(ids)))


def has_over(text: Column, tokens: int) -> Column:
    """Whether a text may have more than so many tokens: every token has a byte at least."""
    return F.octet_length(text) > tokens
