"""Byte-level BPE by a sentencepiece model written straight from a rank file.

A rank file gives byte strings by rank. Each byte is mapped to a printable letter of
its own, so every token is a piece of such letters; its score is the negative rank.
Merging the best-scored neighbours first is then merging by rank. The model is
serialised here (no training), with identity normalisation and no dummy prefix.
A text is cut by the pre-token pattern; a pre-token that is itself a token is that
token, any other is encoded by the model. Decoding maps ids back to their bytes.

Scale: one pass, no shuffle. A worker builds the model once from the rank file's
bytes (one vocabulary: a fixed size) and remembers at most ``MEMO`` pre-tokens.

Edge cases: null and empty texts have no tokens; texts and pre-tokens of any length
are encoded whole; special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, texts_of

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
MEMO = 200_000
#: Longest pre-token that is remembered.
MEMO_BYTES = 64
#: First of 256 consecutive letters that stand for the bytes.
LETTERS = 0x1400


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


def letters(token: bytes) -> str:
    return token.decode("latin-1").translate(_TO_LETTERS)


_TO_LETTERS = {b: LETTERS + b for b in range(256)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value & (1 << 64) - 1)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece k + 1 is the token of the k-th smallest rank; piece 0 is unknown."""
    pieces = [_message(1, _message(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2))]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        pieces.append(_message(1, _message(1, letters(token).encode()) + b"\x15" + struct.pack("<f", -float(rank)) + _number(3, 1)))
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, 0) + _number(41, -1) + _number(42, -1) + _number(43, -1)
    normaliser = _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _message(2, trainer) + _message(3, normaliser)


class Codec:
    def __init__(self, data: bytes, pattern: str = public_tokenizers.PATTERN):
        import sentencepiece

        self.ranks = read_ranks(data)
        self.split = regex.compile(pattern).findall
        self.by_piece = [0, *sorted(self.ranks.values())]
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(serialise(self.ranks))
        self.memo: dict[str, bytes] = {}

    def _piece(self, pre: str) -> bytes:
        token = pre.encode()
        rank = self.ranks.get(token)
        ids = [rank] if rank is not None else [self.by_piece[k] for k in self.model.EncodeAsIds(letters(token))]
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(token) <= MEMO_BYTES:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[pre] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        memo, piece = self.memo, self._piece
        return b"".join([memo.get(p) or piece(p) for p in self.split(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))


def rank_file(path: str | None = None) -> bytes:
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return f.read()


def _mapped(docs: DataFrame, id_col: str, text_col: str, path: str | None, schema: str, row, columns) -> DataFrame:
    data = docs.sparkSession.sparkContext.broadcast(rank_file(path))  # one vocabulary file: under a megabyte
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        codec = Codec(data.value)
        for batch in pieces(batches, 1):
            rows = [row(codec, t.decode()) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns(rows)], names=["doc_id", *(c.split()[0] for c in schema.split(", "))])

    return docs.mapInArrow(run, f"doc_id {kind}, {schema}")


def _digests(codec: Codec, text: str) -> tuple:
    ids = codec.encode(text)
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()


def _lists(rows: list[bytes]) -> list[pa.Array]:
    """Counts and lists of ids, without a Python number for each."""
    sizes = np.array([len(r) // 4 for r in rows], np.int64)
    ids = np.frombuffer(b"".join(rows), "<u4").astype(np.int32)
    return [pa.array(sizes), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids))]


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return _mapped(docs, id_col, text_col, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", _digests, lambda rows: [pa.array(c) for c in zip(*rows)])


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids."""
    return _mapped(docs, id_col, text_col, path, "n_tokens long, ids array<int>", Codec.encode, _lists)


def decode(encoded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """One row per document: doc_id and the bytes that its ids stand for; a null list is empty, an unknown id fails."""
    data = encoded.sparkSession.sparkContext.broadcast(rank_file(path))
    encoded = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>"))
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bytes_of = {rank: token for token, rank in read_ranks(data.value).items()}
        for batch in batches:
            out = [b"".join([bytes_of[i] for i in ids or ()]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return encoded.mapInArrow(run, f"doc_id {kind}, bytes binary")
