"""Byte-level BPE encoding and decoding through a serialised sentencepiece model.

The model is written directly from a vocabulary of ranks (no training): every token's bytes are mapped to printable
characters, its score is the negative rank, normalisation is the identity.  Each pre-token is encoded by itself; a pre-token
that is itself a token is taken whole, as the rank-file encoders do.  Decoding maps ids to their bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import small_batches

#: Characters of text that are cut into pre-tokens at a time, roughly.
SLICE = 1 << 20
#: Pre-tokens whose ids are kept by a worker (about 150 bytes each).
CACHE = 250_000
#: Bytes of text that are encoded together.
TOGETHER = 2 << 20


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank; the ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("the ranks have gaps")
    return [ranks[i] for i in range(len(ranks))]


@lru_cache(1)
def byte_map() -> list[str]:
    """A printable character for each byte: itself where printable in Latin-1, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], extra = chr(256 + extra), extra + 1
    return out


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _number(number: int, n: int) -> bytes:
    return _varint(number << 3) + _varint(n)


def serialise(tokens: list[bytes]) -> bytes:
    """ModelProto: piece r is the token of rank r, the piece after the last is <unk>."""
    chars = byte_map()
    # fixed values of the public format: 1 pieces (1 text, 2 score, 3 type: 1 normal, 2 unknown), 2 trainer (3 model type: 2
    # BPE; 40 unk, 41 bos, 42 eos, 43 pad ids), 3 normaliser (1 name, 3 dummy prefix, 4 extra blanks, 5 escape blanks)
    pieces = []
    for rank, token in enumerate(tokens):
        text = "".join(chars[b] for b in token).encode()
        pieces.append(_field(1, _field(1, text) + b"\x15" + struct.pack("<f", -float(rank)) + _number(3, 1)))
    pieces.append(_field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2)))
    minus_one = (1 << 64) - 1
    trainer = _number(3, 2) + _number(4, len(tokens) + 1) + _number(40, len(tokens)) + _number(41, minus_one) + _number(42, minus_one) + _number(43, minus_one)
    normaliser = _field(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    def __init__(self, tokens: list[bytes], pattern: str):
        import sentencepiece

        self.tokens = tokens
        self.whole = {t: i for i, t in enumerate(tokens)}
        self.pattern = regex.compile(pattern)
        self.table = {b: c for b, c in enumerate(byte_map())}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(tokens))
        self.known: dict[str, bytes] = {}
        missing = [b for b in range(256) if bytes([b]) not in self.whole]
        if missing:
            raise ValueError(f"bytes without a token: {missing[:5]}")

    def pieces(self, text: str):
        """Pre-tokens of the whole text.  Long texts are cut before a blank that stands between two letters, where no match
        of the pattern ends or begins otherwise."""
        at = 0
        while len(text) - at > SLICE:
            cut = regex.compile(r"(?<=\p{L}) (?=\p{L})").search(text, at + SLICE)
            if not cut:
                break
            yield from self.pattern.findall(text, at, cut.start())
            at = cut.start()
        yield from self.pattern.findall(text, at)

    def _learn(self, words: set[str]) -> None:
        """Cache the ids of new pre-tokens as packed unsigned 32-bit integers."""
        rest, raw = [], []
        for word in words:
            b = word.encode("utf-8", "replace")
            whole = self.whole.get(b)
            if whole is None:
                rest.append(word)
                raw.append(b.decode("latin-1").translate(self.table))
            else:
                self.known[word] = struct.pack("<I", whole)
        if rest:
            for word, ids in zip(rest, self.model.encode(raw, num_threads=1)):
                self.known[word] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text, packed as little-endian unsigned 32-bit integers; null is empty."""
        parts = [list(self.pieces(t)) if t else [] for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        self._learn(set().union(*parts) - self.known.keys())
        take = self.known.__getitem__
        return [b"".join(map(take, p)) for p in parts]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


def encode_documents(docs: DataFrame, path: str, pattern: str, keep: list[str] | None = None, ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids``) for every document, with the columns in ``keep``.

    ``keep`` may not name a column of the result.  Null and empty texts have no ids and the digests of nothing.  Very long texts are pre-tokenised in slices.  Repeated rows
    are kept; an empty table gives an empty result.  ``path`` is read on the driver; the vocabulary (under 1 MB) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast((read_ranks(path), pattern))
    keep = list(dict.fromkeys(["doc_id", *(keep or [])]))
    if clash := {"n_tokens", "ids_sha256", "decoded_sha256", "ids"}.intersection(c.lower() for c in keep):
        raise ValueError(f"columns that the result has itself can't be kept: {sorted(clash)}")
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids


    def run(batches):
        codec = Codec(*shared.value)  # of a task: kept by workers, it would take 100 MB of each while other stages run
        for batch in batches:
            for at, packed in _encoded(codec, batch.column(0)):
                columns = [
                    *batch.slice(at, len(packed)).columns[1:],
                    pa.array([len(x) // 4 for x in packed], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string()),
                    pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in packed], pa.string()),
                ]
                if ids:
                    ends = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), dtype="<i4"))))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids])

    return small_batches(docs.select("text", *[F.col(f"`{c}`") for c in keep])).mapInArrow(run, schema)


def _encoded(codec: Codec, column: pa.Array):
    """(first row, packed ids of it and the following rows): a few MB of text at a time."""
    held, size, first = [], 0, 0
    for i, text in enumerate(column):
        held.append(text.as_py())
        size += len(held[-1] or "")
        if size >= TOGETHER or i == len(column) - 1:
            yield first, codec.encode(held)
            held, size, first = [], 0, i + 1
