"""Byte-level BPE: encode whole texts to ids, and ids back to bytes and text.

The merges run in the ``tokenizers`` library.  Its vocabulary is written in the
printable alphabet that stands for bytes; ``byte_alphabet`` is that table and
decoding reverses it.  The vocabulary file holds ranks only, so every way of
splitting a token into two known tokens becomes a merge with the rank of the
token: exactly the pairs that rank-driven merging would join.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import narrowed, slices

VOCABULARY = "byte_bpe_50k.tiktoken"


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable ones stand for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(spare)
            spare += 1
    return [table[b] for b in range(256)]


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _Uneven(Exception):
    """A space that follows white space: the text can't be cut before it."""


class _Memo(dict):
    """Packed ids by key, for the first ``most`` keys that aren't long."""

    LONGEST = 64

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        ids = self.make(key)
        if len(self) < self.most and len(key) <= self.LONGEST:
            self[key] = ids
        return ids


class ByteBpe:
    """One vocabulary, ready to encode and decode in a worker.

    A piece (one match of the pattern) always gives the same ids, so each worker keeps
    the ids of the first ``MEMO`` pieces it meets, which hold the frequent ones.  No match of the pattern
    goes on across a space that follows a visible character; what stands between two such
    spaces is kept likewise, and spares most texts the pattern.
    """

    MEMO = 400_000

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        from tokenizers import models

        table = ranks(path)
        alphabet = byte_alphabet()
        spelled = {token: "".join(alphabet[b] for b in token) for token in table}
        merges = []
        for token in sorted(table, key=table.__getitem__):
            for cut in range(1, len(token)):
                left, right = token[:cut], token[cut:]
                if left in table and right in table:
                    merges.append((spelled[left], spelled[right]))
        assert sys.byteorder == "little" and array("I").itemsize == 4
        self.model = models.BPE(vocab={s: table[t] for t, s in spelled.items()}, merges=merges, cache_capacity=0)
        self.pieces = regex.compile(pattern)
        self.to_alphabet = dict(enumerate(alphabet))
        of_char = {c: b for b, c in enumerate(alphabet)}
        self.bytes_of = [b""] * (max(table.values()) + 1)
        for token, text in spelled.items():  # the reversed table gives each id its bytes
            self.bytes_of[table[token]] = bytes(of_char[c] for c in text)
        self.length_of = np.array([len(b) for b in self.bytes_of], np.int32)
        self.memo = _Memo(self._piece, self.MEMO)
        self.spaced = _Memo(self._spaced, self.MEMO)

    def _tokens(self, piece: str) -> list:
        return self.model.tokenize(piece.encode().decode("latin-1").translate(self.to_alphabet))

    def _piece(self, piece: str) -> bytes:
        return array("I", [t.id for t in self._tokens(piece)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.pieces.findall(text)))

    def _spaced(self, part: str) -> bytes:
        if not part or part[-1].isspace():
            raise _Uneven
        return self._whole(" " + part)

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        first, *rest = text.split(" ")
        if rest and first and not first[-1].isspace():
            try:
                return self._whole(first) + b"".join(map(self.spaced.__getitem__, rest))
            except _Uneven:
                pass
        return self._whole(text)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Where each token ends in the UTF-8 bytes of the text; it begins where the one before ends.

        The library's tokens follow each other without gaps, also where one holds only a
        part of a character, so their places are sums of their lengths in bytes.
        """
        return np.cumsum(self.length_of[ids], dtype=np.int32)

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Text of any run of ids; a character cut at either end becomes U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", errors="replace")

    def stream(self, ids: Iterator[int]) -> Iterator[str]:
        """Text as it becomes certain: bytes of a split character wait for the rest."""
        decoder = codecs.getincrementaldecoder("utf-8")(errors="replace")
        for i in ids:
            if piece := decoder.decode(self.bytes_of[i]):
                yield piece
        if rest := decoder.decode(b"", final=True):
            yield rest


@lru_cache(maxsize=2)
def loaded(path: str) -> ByteBpe:
    return ByteBpe(path)


def _path(name_or_path: str) -> str:
    return name_or_path if os.path.isabs(name_or_path) else public_tokenizers.path(name_or_path)


def encode(documents: DataFrame, vocabulary: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column, ids array<int>, ends array<int>`` for every row; a null text is an empty one.

    ``ends`` are offsets: where each token ends in the text's UTF-8 bytes (and the next begins).

    ``vocabulary`` is a file of ranks: a path, or a name among the installed public
    vocabularies, found anew on each executor.  Empty texts give no ids; repeated rows
    stay repeated; a null id stays null; other columns are not read.
    """
    rows = narrowed(documents, id_column, text_column)
    kind = rows.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(_path(vocabulary))
        for batch in batches:
            for part in slices(batch, 1):
                ids = [np.frombuffer(bpe.packed(t or ""), "<i4") for t in part.column(1).to_pylist()]
                ends = [bpe.ends(x) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], names=[id_column, "ids", "ends"])

    return rows.mapInArrow(run, f"`{id_column}` {kind}, ids array<int>, ends array<int>")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """``id_column, bytes binary, text string`` of every row's ids; null ids count as none.

    Ids that end inside a character keep its bytes in ``bytes`` and show U+FFFD in ``text``.
    """
    rows = narrowed(encoded, id_column, ids_column)
    kind = rows.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(_path(vocabulary))
        for batch in batches:
            raw = [bpe.decode_bytes(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array([r.decode("utf-8", "replace") for r in raw], pa.string())], names=[id_column, "bytes", "text"])

    return rows.mapInArrow(run, f"`{id_column}` {kind}, bytes binary, text string")


def round_trip(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Encode every text and decode its ids in one pass: counts and digests of both sides.

    Returns ``doc_id, n_tokens, ids_sha256`` (ids as little-endian unsigned 32-bit) and
    ``decoded_sha256``, one row for each input row; null texts count as empty.
    """
    rows = narrowed(documents, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(_path(vocabulary))
        for batch in batches:
            for part in slices(batch, 1):
                packed = [bpe.packed(t or "") for t in part.column(1).to_pylist()]
                out = [part.column(0), pa.array([len(p) // 4 for p in packed], pa.int64())]
                out.append(pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()))
                out.append(pa.array([hashlib.sha256(bpe.decode_bytes(np.frombuffer(p, "<u4").tolist())).hexdigest() for p in packed], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


__all__ = ["ByteBpe", "byte_alphabet", "decode", "encode", "loaded", "ranks", "round_trip"]
