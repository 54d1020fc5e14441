"""Byte-level BPE by way of a sentencepiece model that is made directly from the ranks.

Each vocabulary entry becomes a piece of byte characters (byte b is code point 256 + b) whose score is its negative rank; the
normaliser is the identity. sentencepiece then merges the adjacent pair of the best score, the leftmost of equals, which is
byte-level BPE by ranks. Pre-tokens of the public pattern are encoded one by one, and decoding looks bytes up by id.

Null texts are empty and have no ids. Repeated rows and doc_ids are encoded row by row; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_text, sliced

#: Code point of byte 0. Latin Extended letters: each is one character to sentencepiece, none is white space.
FIRST = 256
#: Unicode white space as the pattern's \s has it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space after a blank, or doubled: such texts are split by the pattern as a whole.
UNEVEN = regex.compile(rf"(?:^| )[{SPACE}]| $")
#: Marks of chunks met before; two chunks may share one, which only holds a chunk earlier.
MARKS = 1 << 22
#: Characters of a chunk that is held, at most, so that what is held is bounded in bytes.
LONG = 64
_TO_CHARS = {b: FIRST + b for b in range(256)}


def ranks(path: str) -> dict[bytes, int]:
    """Byte strings and their ranks, of a file of base64 strings and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: int | float | bytes) -> bytes:
    """A protocol-buffer field: varint, 32-bit float or bytes."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.array([value], "<f4").tobytes()
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model(vocabulary: dict[bytes, int]) -> bytes:
    """The sentencepiece model: piece k is the entry of the k-th rank, and one unknown piece follows them."""
    order = sorted(vocabulary, key=vocabulary.__getitem__)
    pieces = [_field(1, w.decode("latin-1").translate(_TO_CHARS).encode()) + _field(2, float(-vocabulary[w])) for w in order]
    unknown = _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)
    bpe = 2
    trainer = _field(3, bpe) + _field(4, len(order) + 1) + _field(40, len(order)) + _field(41, -1 & (1 << 64) - 1) + _field(42, -1 & (1 << 64) - 1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in [*pieces, unknown]) + _field(2, trainer) + _field(3, normalizer)


class ByteBpe(dict):
    """From a chunk of text, a blank before it if that belongs to it, to its packed ids. Chunks are held from the second time
    they are met, by a table of marks, so that the many that are met once take no memory."""

    def __init__(self, path: str, pattern: str, cap: int = 250_000):
        import sentencepiece

        super().__init__()
        vocabulary = ranks(path)
        order = sorted(vocabulary, key=vocabulary.__getitem__)
        self.numbers = np.array([vocabulary[w] for w in order], np.uint32)
        self.bytes = dict(zip(map(vocabulary.__getitem__, order), order))
        self.text = {i: b"%d" % i for i in self.bytes}
        self.own = sentencepiece.SentencePieceProcessor(model_proto=model(vocabulary))
        self.split = regex.compile(pattern).findall
        self.cap, self.old, self.met = cap, {}, bytearray(MARKS)

    def __missing__(self, chunk: str) -> bytes:
        if (ids := self.old.get(chunk)) is None:
            pieces = [x.encode().decode("latin-1").translate(_TO_CHARS) for x in self.split(chunk)]
            ids = b"".join(self.numbers[self.own.encode(x)].tobytes() for x in pieces)
        if len(chunk) > LONG:
            return ids
        mark = hash(chunk) % MARKS
        if not self.met[mark]:
            self.met[mark] = 1
            return ids
        if len(self) >= self.cap:
            self.old, self.met = dict(self), bytearray(MARKS)
            self.clear()
        self[chunk] = ids
        return ids

    def encode(self, raw: bytes) -> np.ndarray:
        """Ids of a UTF-8 text.

        If each blank has a character that isn't white space after it, then a blank begins a pre-token, and what lies between
        blanks is encoded by itself; other texts are split by the pattern from their beginning.
        """
        text = raw.decode("utf-8", "replace")
        if not text:
            return np.zeros(0, np.uint32)
        if UNEVEN.search(text):
            pieces = self.split(text)
        else:
            first, *rest = text.split(" ")
            pieces = [first] * bool(first) + [" " + x for x in rest]
        return np.frombuffer(b"".join(map(self.__getitem__, pieces)), np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


_OPEN: dict[tuple[str, str], ByteBpe] = {}


def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """The worker's own coder of a file."""
    if (path, pattern) not in _OPEN:
        _OPEN[path, pattern] = ByteBpe(path, pattern)
    return _OPEN[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded (bytes) of every row."""
    return _rows(docs, path, pattern, text, lambda coder, ids: (ids.astype("<u4").tobytes(), coder.decode(ids)), "ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""

    def both(coder: ByteBpe, ids: np.ndarray) -> tuple[str, str]:
        spelt = b" ".join(map(coder.text.__getitem__, ids.tolist()))
        return hashlib.sha256(spelt).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()

    return _rows(docs, path, pattern, text, both, "ids_sha256 string, decoded_sha256 string")


def _rows(docs: DataFrame, path: str, pattern: str, text: str, made, columns: str) -> DataFrame:
    kind = pa.binary() if "binary" in columns else pa.string()
    names = ["doc_id", "n_tokens", *(x.split()[0] for x in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(path, pattern)
        for part in sliced(batches):
            ids = [coder.encode(x) for x in part.column(1).to_pylist()]
            one, two = zip(*(made(coder, x) for x in ids))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, ids)), pa.int64()), pa.array(one, kind), pa.array(two, kind)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text(text))
    return rows.mapInArrow(run, f"doc_id long, n_tokens long, {columns}")
