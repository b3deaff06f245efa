"""Problem 8: encode every text with a public byte-level BPE vocabulary.

The vocabulary (bytes and rank of each token) is serialised on the driver as a
sentencepiece BPE model: each piece is the token's bytes mapped to one printable
character a byte, its score the negative rank, so that sentencepiece's best-score
merge is the lowest-rank merge; the normaliser is the identity. Texts are cut
into pre-tokens by the tokenizer's pattern, each distinct pre-token is encoded
once per worker, and ids are joined. Decoding is the inverse mapping.

Defined results: null and empty texts give an empty list, blank texts are encoded
as they are, the strings of special tokens are ordinary text, texts of any length
are encoded whole. Rows are not reordered, merged or dropped: equal rows give
equal ids, an empty table an empty one. Only the id and text columns are read, so
further columns, whatever their names, pass by.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.sources.tables import spread

TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
# The pre-token pattern of byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHED = 200_000


def byte_chars() -> list[str]:
    """A printable character for each byte: itself where printable, else from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in own}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(own))
    return [out[b] for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranks = sorted((int(rank), base64.b64decode(token)) for token, rank in pairs)
    if [r for r, _ in ranks] != list(range(len(ranks))):
        raise ValueError(f"ranks of {path} are not 0 to {len(ranks) - 1}")
    return [token for _, token in ranks]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


def bpe_model(tokens: list[bytes]) -> bytes:
    """The serialised sentencepiece model; token ids are ranks, the unknown piece comes last."""
    chars = byte_chars()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(chars[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _field(2, -float(rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + b"".join(_field(n, -1) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return bytes(out + _field(2, trainer) + _field(3, normalizer))


class Codec:
    """Encoder and decoder over one model; keeps ids of recent pre-tokens."""

    def __init__(self, model: bytes, pattern: str = PATTERN):
        import regex
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        chars = byte_chars()
        self.table = {b: c for b, c in enumerate(chars)}
        self.back = {c: b for b, c in enumerate(chars)}
        self.known: dict[str, list[int]] = {}

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        out, known = [], self.known
        for text in texts:
            if not text:
                out.append([])
                continue
            parts = self.split(text)
            new = list({p for p in parts if p not in known})
            if new:
                if len(known) + len(new) > CACHED:
                    known.clear()
                    new = list(set(parts))
                mapped = [p.encode().decode("latin-1").translate(self.table) for p in new]
                known.update(zip(new, self.pieces.encode(mapped, num_threads=1)))
            ids: list[int] = []
            for p in parts:
                ids += known[p]
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        mapped = "".join(self.pieces.id_to_piece(list(ids))) if len(ids) else ""
        return bytes(self.back[c] for c in mapped).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(model: bytes) -> Codec:
    """One codec per worker process and model."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model)
    return _codecs[key]


def load_model(vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> bytes:
    return bpe_model(read_ranks(os.path.join(folder, vocabulary)))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: bytes | None = None) -> DataFrame:
    """(id, ids): the token ids of each row's text."""
    shared = docs.sparkSession.sparkContext.broadcast(model or load_model())  # about 1 MB, fixed by the vocabulary
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):  # small slices keep long texts' ids few at a time
                part = batch.slice(start, 256)
                ids = own.encode_all(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return spread(narrow).mapInArrow(run, f"doc_id {kind}, ids array<int>").withColumnRenamed("doc_id", id_col)


def token_counts(docs: DataFrame, keep: list[str], text_col: str = "text", model: bytes | None = None) -> DataFrame:
    """The kept columns and n_tokens of each row's text; ids do not leave the worker."""
    shared = docs.sparkSession.sparkContext.broadcast(model or load_model())
    narrow = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                n = pa.array([len(x) for x in own.encode_all(part.column(part.num_columns - 1).to_pylist())], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], n], [*keep, "n_tokens"])

    return spread(narrow).mapInArrow(run, f"{schema}, n_tokens bigint")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: bytes | None = None) -> DataFrame:
    """(id, text): the inverse of encode; null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(model or load_model())
    narrow = encoded.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids"))
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for batch in batches:
            texts = [own.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return narrow.mapInArrow(run, f"doc_id {kind}, text string").withColumnRenamed("doc_id", id_col)
