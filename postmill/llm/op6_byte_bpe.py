"""Byte-level BPE encoding and decoding with a sentencepiece model written from a tiktoken vocabulary.

Each of the vocabulary's byte strings becomes a piece: its bytes mapped to printable characters, its score
the negative rank, in rank order, so that ids are ranks. The normaliser is the identity. sentencepiece then
merges the pair whose piece has the highest score, leftmost first, which is tiktoken's rule. Texts are split
by the vocabulary's pre-token pattern and every pre-token is encoded by itself; equal pre-tokens of a task
are encoded once (a bounded memo). Decoding maps each id's piece back to its bytes.

Defined cases: a null or empty text has no ids. Repeated rows each keep their row; extra columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from postmill.llm.blocks import trim
from postmill.llm.common import documents, narrow, ship

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens that a worker remembers, and their greatest length in characters.
MEMO, MEMO_LENGTH = 150_000, 48


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protocol-buffer field: bytes, varint or 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_proto(vocabulary: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose id i is vocabulary[i]; one unknown piece follows them."""
    chars = byte_characters()
    pieces = [_field(1, "".join(chars[b] for b in v).encode()) + _field(2, float(-i)) + _field(3, 1) for i, v in enumerate(vocabulary)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(vocabulary)) + _field(41, 2**64 - 1) + _field(42, 2**64 - 1) + _field(43, 2**64 - 1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


#: A character that both engines take for a letter, a number or white space; and one that both take for none of these.
TYPICAL = {r"\p{L}": 0x4E00, r"\p{N}": 0x0966, r"\s": 0x2003}
NONE = 0x0378


@lru_cache(1)
def stand_ins() -> tuple[dict[int, int], frozenset[str]]:
    """Characters that the regex module and tiktoken's engine put in different classes (their Unicode tables differ), each with
    one of its class in tiktoken, and the set of them. What tiktoken's engine matches is read from an
    encoding of single bytes, which gives back all that its pattern matches."""
    import regex
    import tiktoken

    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    theirs, ours = {}, {}
    for name in TYPICAL:
        bytes_only = tiktoken.Encoding("bytes", pat_str=name, mergeable_ranks={bytes([k]): k for k in range(256)}, special_tokens={})
        for k in range(0, len(everything), 1 << 16):
            part = everything[k : k + (1 << 16)]
            theirs |= dict.fromkeys(bytes(bytes_only.encode_ordinary(part)).decode(), name)
            ours |= dict.fromkeys(regex.findall(name, part), name)
    odd = {ord(c): TYPICAL.get(theirs.get(c), NONE) for c in theirs.keys() | ours.keys() if theirs.get(c) != ours.get(c)}
    return odd, frozenset(map(chr, odd))


class ByteBPE:
    def __init__(self, name: str = VOCABULARY):
        import public_tokenizers
        import regex
        import sentencepiece

        with open(public_tokenizers.path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        vocabulary = sorted(ranks, key=ranks.get)
        if [ranks[v] for v in vocabulary] != list(range(len(ranks))):
            raise ValueError("ranks must run from 0 without gaps")
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.stand_in, self.odd = stand_ins()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(vocabulary))
        chars = byte_characters()
        back = {c: i for i, c in enumerate(chars)}
        self.to_chars = {i: c for i, c in enumerate(chars)}
        self.piece = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(vocabulary))]
        self.memo: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        if text.isascii() or self.odd.isdisjoint(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.stand_in))]

    def _encode_new(self, tokens: list[str]) -> dict[str, bytes]:
        mapped = [t.encode().decode("latin-1").translate(self.to_chars) for t in tokens]
        return {t: np.array(ids, "<u4").tobytes() for t, ids in zip(tokens, self.model.encode(mapped, num_threads=1), strict=True)}

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        tokens = self.split(text)
        parts = list(map(self.memo.get, tokens))
        if None in parts:
            new = self._encode_new(list({t for t, p in zip(tokens, parts, strict=True) if p is None}))
            if len(self.memo) + len(new) > MEMO:
                self.memo.clear()
            parts = [new[t] if p is None else p for t, p in zip(tokens, parts, strict=True)]
            self.memo.update((t, p) for t, p in new.items() if len(t) <= MEMO_LENGTH)
        return b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        piece = self.piece
        return b"".join([piece[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(2)
def tokenizer(name: str = VOCABULARY) -> ByteBPE:
    return ByteBPE(name)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids: each document's ids as little-endian unsigned 32-bit integers."""
    ship(docs.sparkSession)

    def run(batches):
        bpe = tokenizer(vocabulary)
        for x in batches:
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array([bpe.encode(t or "") for t in x.column(1).to_pylist()], pa.binary())], names=["doc_id", "ids"])

    return narrow(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, ids binary")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text: the inverse of encode()."""
    ship(encoded.sparkSession)

    def run(batches):
        bpe = tokenizer(vocabulary)
        for x in batches:
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array([bpe.decode(v or b"").decode("utf-8", "replace") for v in x.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded and decoded in one task, only digests leave it."""
    ship(docs.sparkSession)

    def run(batches):
        bpe = tokenizer(vocabulary)
        for x in batches:
            n, a, b = [], [], []
            for t in x.column(1):  # a text at a time: ids of a batch are never held together
                ids = bpe.encode(t.as_py() or "")
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.memo.clear()
        trim()

    return narrow(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: doc_id, n_tokens and digests of every document that is left."""
    return round_trip(docs)
