"""Encoding with a public byte-level BPE vocabulary through a sentencepiece model built from its ranks.

Method
    Each token's bytes are written as printable characters (one a byte), and the vocabulary becomes the
    pieces of a sentencepiece BPE model with score = minus rank: the merge with the highest score is the
    merge with the lowest rank.  The model is serialised here field by field (identity normalisation, no
    dummy prefix, no white space handling).  Texts are cut to pre-tokens by the vocabulary's pattern, the
    pre-tokens' bytes are mapped to the same characters and encoded; decoding is the inverse mapping.

The model (about 1 MB, fixed by the vocabulary file) is broadcast as bytes.  Each worker keeps ids of
pre-tokens it has met in a memo of bounded size.  The path of the vocabulary is a parameter.

Defined results: null and empty text give an empty list; strings of special tokens are ordinary text;
lone surrogates are encoded as U+FFFD; repeated rows are encoded each; extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
import struct
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.sources.spread import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-token pattern of the vocabulary; the second form is the same for ASCII text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
ASCII_PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
MEMO_SIZE = 400_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


_ALPHABET = byte_alphabet()
_TO_CHAR = {b: ord(c) for b, c in enumerate(_ALPHABET)}
_TO_BYTE = {c: b for b, c in enumerate(_ALPHABET)}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protobuf field: varint, 32-bit float or length-delimited."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised model; piece ids are ranks, and the unknown piece (never produced) comes last."""
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    out = bytearray()
    for token, rank in by_rank:
        piece = token.decode("latin-1").translate(_TO_CHAR)
        out += _field(1, _field(1, piece.encode()) + _field(2, float(-rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    n = len(by_rank)
    out += _field(2, _field(3, 2) + _field(4, n + 1) + _field(40, n) + _field(41, -1) + _field(42, -1) + _field(43, -1))
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class Encoder(dict):
    """Memo of pre-token -> ids over a sentencepiece processor."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        super().__init__()
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.wide = regex.compile(PATTERN).findall
        self.ascii = re.compile(ASCII_PATTERN).findall

    def __missing__(self, pre_token: str) -> list[int]:
        mapped = pre_token.encode("utf-8").decode("latin-1").translate(_TO_CHAR)
        ids = self[pre_token] = self.processor.encode(mapped, num_threads=1)
        return ids

    def pre_tokens(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii(text)
        return self.wide(text.encode("utf-16", "surrogatepass").decode("utf-16", "replace"))

    def trim(self) -> None:
        if len(self) > MEMO_SIZE:
            self.clear()

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.pre_tokens(text)))) if text else []

    def decode(self, ids: list[int]) -> str:
        mapped = "".join(map(self.processor.id_to_piece, ids))
        return bytes(_TO_BYTE[c] for c in mapped).decode("utf-8", "replace")


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(model: Broadcast) -> Encoder:
    """This worker's encoder for a broadcast model."""
    key = hash(model.value)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(model.value)
    return _ENCODERS[key]


def broadcast_model(spark: SparkSession, vocabulary: str = VOCABULARY) -> Broadcast:
    return spark.sparkContext.broadcast(sentencepiece_model(read_ranks(vocabulary)))


def encode_documents(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(key, ids)`` with the token ids of every row's text."""
    model = broadcast_model(df.sparkSession, vocabulary)
    key_type = df.schema[key].dataType.simpleString()

    def run(batches):
        enc = encoder_of(model)
        for batch in batches:
            enc.trim()
            flat, offsets = array("i"), [0]
            for t in batch.column(1).to_pylist():
                if t:
                    flat.extend(chain.from_iterable(map(enc.__getitem__, enc.pre_tokens(t))))
                offsets.append(len(flat))
            values = pa.array(np.frombuffer(flat, dtype=np.int32) if flat else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], ["key", "ids"])

    rows = spread(df.select(F.col(key), F.col(text)))
    return rows.mapInArrow(run, f"`{key}` {key_type}, ids array<int>")


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), vocabulary: str = VOCABULARY) -> DataFrame:
    """``(key, *keep, n_tokens)``; the ids are counted, never built."""
    model = broadcast_model(df.sparkSession, vocabulary)
    cols = [key, *keep]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)

    def run(batches):
        enc = encoder_of(model)
        for batch in batches:
            enc.trim()
            n = [sum(map(len, map(enc.__getitem__, enc.pre_tokens(t)))) if t else 0 for t in batch.column(len(cols)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(cols))), pa.array(n, pa.int64())], [*cols, "n_tokens"])

    return spread(df.select(*cols, text)).mapInArrow(run, f"{schema}, n_tokens long")
