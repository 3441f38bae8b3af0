"""Byte-level BPE by a sentencepiece model that is written out from a vocabulary of ranks.

Every byte stands for one letter (U+0100 and up), so that a token's bytes are a piece of
ordinary letters. The model's file holds those pieces, in the order of their ranks, each
scored by its negative rank, and an identity normalisation: sentencepiece then merges, in
each pre-token, the neighbours of the lowest rank first, the leftmost of equal ones, as the
ranks ask for. Pre-tokens are the matches of the vocabulary's pattern. Decoding maps ids to
pieces and their letters back to bytes.
"""

from __future__ import annotations

import base64
import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellspark.llm import blocks
from cellspark.llm.lattice import default_vocabulary
from cellspark.llm.packing import Tokens

#: The letter of byte 0.
FIRST = 0x100
LETTERS = {b: FIRST + b for b in range(256)}
#: Fixed values of sentencepiece's format: kinds of pieces, and BPE as the kind of model.
NORMAL, UNKNOWN, BPE = 1, 2, 2
#: Ids that are decoded at once.
IDS = 1 << 18


def letters(data: bytes) -> str:
    return data.decode("latin-1").translate(LETTERS)


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank of each token of a file in the ``tiktoken`` format; ranks must run from 0 without a gap and fit into 16 bits."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    if sorted(ranks.values()) != list(range(len(ranks))) or len(ranks) >= 1 << 16:
        raise ValueError("ranks must be 0, 1, 2, ... below 65535")
    return ranks


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One field of a protocol buffer: a number, a 32-bit float or bytes."""
    if isinstance(value, bytes):
        return _number(number << 3 | 2) + _number(len(value)) + value
    return _number(number << 3 | 5) + struct.pack("<f", value) if isinstance(value, float) else _number(number << 3) + _number(value)


def serialised(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model of a vocabulary: ids are ranks, the one after them is the unknown piece that no text needs."""
    pieces = [(letters(token).encode(), -float(rank), NORMAL) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    pieces.append((b"<unk>", 0.0, UNKNOWN))
    body = b"".join(_field(1, _field(1, text) + _field(2, score) + _field(3, kind)) for text, score, kind in pieces)
    # The trainer's part names the kind of model; the normaliser's neither adds, drops nor escapes white space.
    return body + _field(2, _field(3, BPE)) + _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))


class Codec(Tokens):
    """Encodes whole texts and decodes ids; equal stretches of text are encoded once for a task."""

    def __init__(self, path: str, most: int = 500_000):
        import public_tokenizers
        import regex
        from sentencepiece import SentencePieceProcessor

        ranks = read_ranks(path)
        self.model = SentencePieceProcessor(model_proto=serialised(ranks))
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        #: Tokens that merges don't reach: as a whole pre-token they still are one.
        self.whole = {x: [rank] for x, rank, got in zip(map(letters, ranks), ranks.values(), map(self.model.encode, map(letters, ranks))) if got != [rank]}
        table = [self.model.id_to_piece(i).encode("utf-16-le") for i in range(len(ranks))]
        self.piece_size = np.array([len(x) // 2 for x in table], np.int64)
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self.bytes = (np.frombuffer(b"".join(table), "<u2") - FIRST).astype(np.uint8)
        self.most = most
        self._clear()

    def encode(self, text: str) -> list[int]:
        # One by one: for a list the library would start threads.
        return [i for x in map(letters, map(str.encode, self.pattern.findall(text))) for i in self.whole.get(x) or self.model.encode(x)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all documents end to end, and their offsets."""
        size = self.piece_size[ids]
        before = np.concatenate(([0], np.cumsum(size)))
        return self.bytes[blocks.ragged(self.piece_start[ids], size)], before[offsets]


@functools.cache
def codec(path: str) -> Codec:
    """One for each Python worker."""
    return Codec(path)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``doc_id``, ``ids`` (array of int) for each row of ``docs``.

    Texts are encoded whole, however long they are, without special tokens: their strings
    in a text are ordinary text. A null text is empty and has no ids. Repeated rows come
    out repeated; an empty table gives an empty result; other columns, whatever their
    names, are not read.
    """
    path = vocabulary or default_vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, offsets = codec(path)(*blocks.layout(part.column("text")))
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
        return pa.record_batch([part.column("doc_id"), lists], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(blocks.in_blocks(run), f"doc_id {kind}, ids array<int>")


def decode_ids(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``doc_id``, ``ids``, ``decoded`` (bytes) for each row of ``tokens``; null ids are none. An id outside the vocabulary is an error."""
    path = vocabulary or default_vocabulary()
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("ids").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            share = np.cumsum(size) // IDS
            cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                part, offsets = batch.slice(a, b - a), np.concatenate(([0], np.cumsum(size[a:b])))
                data, ends = codec(path).decode(part.column("ids").flatten().to_numpy(), offsets)
                decoded = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
                yield pa.record_batch([part.column("doc_id"), part.column("ids"), decoded.cast(pa.binary())], ["doc_id", "ids", "decoded"])

    rows = tokens.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def op13_rows(docs: DataFrame) -> DataFrame:
    """The digests that op13 asks for: ids as decimals joined by commas, and the bytes that decoding gives back."""
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return decode_ids(encode_texts(docs)).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
