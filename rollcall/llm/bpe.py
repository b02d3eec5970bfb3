"""Byte-level BPE encoding and decoding through a sentencepiece model made from a rank file.

The model is serialised here from the vocabulary alone: each token's bytes
are mapped to printable characters, its score is the negative rank, and the
normaliser is the identity, so sentencepiece merges exactly as the ranks
say. Texts are cut by the pre-token pattern, each pre-token is encoded by
itself, and decoding inverts the mapping from ids to bytes.

Defined results: a null text is the empty text: no tokens, the hash of no
bytes; very long texts and pre-tokens are encoded whole; repeated rows each
get a row; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import bounded_batches

#: Encoded pre-tokens a worker keeps; beyond it the cache starts afresh.
CACHE = 200_000
NORMAL, UNKNOWN = 1, 2
BPE_MODEL = 2


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else the next free one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 0x7F
        out.append(low | (0x80 if n else 0))
        if not n:
            return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _chunk(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model whose ids are the ranks; one id after them is the unknown piece, never used."""
    shown = byte_characters()
    tokens = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    out = []
    for token, rank in tokens:
        piece = "".join(shown[b] for b in token).encode()
        out.append(_chunk(1, _chunk(1, piece) + b"\x15" + struct.pack("<f", -float(rank)) + _number(3, NORMAL)))
    unknown = len(tokens)
    out.append(_chunk(1, _chunk(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, UNKNOWN)))
    none = 2**64 - 1  # -1: no such piece
    trainer = _number(3, BPE_MODEL) + _number(4, unknown + 1) + _number(40, unknown) + b"".join(_number(f, none) for f in (41, 42, 43))
    normalizer = _chunk(1, b"identity") + _chunk(2, b"") + b"".join(_number(f, 0) for f in (3, 4, 5))
    return b"".join([*out, _chunk(2, trainer), _chunk(3, normalizer)])


class BytePairCodec:
    """Encodes and decodes texts by a rank file's model; made once in each task."""

    def __init__(self, model: bytes, ranks: Iterable[bytes], pattern: str):
        import regex
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        shown = byte_characters()
        self.mapped = {b: shown[b] for b in range(256)}
        self.token_bytes = list(ranks)
        self.cache: dict[str, list[int]] = {}

    def _learn(self, missing: list[str]) -> None:
        mapped = [x.encode().decode("latin-1").translate(self.mapped) for x in missing]
        self.cache.update(zip(missing, self.pieces.encode(mapped, num_threads=1), strict=True))

    def encode(self, text: str) -> list[int]:
        tokens = self.split(text)
        missing = [x for x in set(tokens) if x not in self.cache]
        if len(self.cache) + len(missing) > CACHE:
            self.cache.clear()
            missing = list(set(tokens))
        if missing:
            self._learn(missing)
        return list(chain.from_iterable(map(self.cache.__getitem__, tokens)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """Per document: doc_id, n_tokens, ids (if ``keep_ids``), and digests of the ids and of the bytes they decode to.

    ``ranks_path`` is read on the driver; the vocabulary (under 1 MB) goes to
    the tasks as a broadcast value. No shuffle: each row is encoded where it is read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    ranks = read_ranks(ranks_path)
    names = [str(i) for i in range(len(ranks))]
    shared = spark.sparkContext.broadcast((sentencepiece_model(ranks), sorted(ranks, key=ranks.get)))

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, tokens = shared.value
        codec = BytePairCodec(model, tokens, pattern)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = codec.encode(text)
                row = (
                    doc_id,
                    len(ids),
                    hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest(),
                    hashlib.sha256(codec.decode(ids)).hexdigest(),
                )
                rows.append((*row, ids) if keep_ids else row)
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + keep_ids]).astype({"doc_id": "Int64"})

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("doc_id", F.col("doc_id").cast("long")).mapInPandas(encoded, schema)
