"""Token ids in files of a static range asymmetric numeral system (rANS).

A segment holds the ids of consecutive documents: a frequency table that all its blocks share, the documents' ids and
lengths, and blocks of LANES x STEPS ids. A block is coded by itself in LANES interleaved 64-bit states that share one
stream of 32-bit words, holds each lane's state and the stream's place at every CHECK steps, and a crc32 of its ids.
All blocks of a segment, and in decoding all checkpoints too, advance together in numpy.

A table of the format is a Parquet folder of rows part, segment, n_docs, n_tokens, payload, in ascending doc_id order
by (part, segment), written by Spark's committer, so that lost or repeated tasks leave nothing behind.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, raw_text, sliced
from .word_tokens import word_tokens

MAGIC = 0x31534E52
LANES, STEPS, CHECK = 32, 256, 64
BLOCK = LANES * STEPS
#: log2 of the table's total; states stay in [2**31, 2**63) and move 32 bits at a time.
SCALE = 18
LOW = np.uint64(1 << 31)
#: Ids in a segment at most, unless one document alone has more: what a task holds.
SEGMENT = 1 << 21


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, and their frequencies scaled to sum to 2**SCALE, each at least 1."""
    symbols, counts = np.unique(ids, return_counts=True)
    if len(symbols) > 1 << (SCALE - 1):
        raise ValueError(f"{len(symbols)} distinct ids are too many for a table of 2**{SCALE}")
    total = 1 << SCALE
    scaled = np.maximum(1, counts * (total - len(symbols)) // max(1, counts.sum())).astype(np.int64)
    scaled[np.argmax(scaled)] += total - scaled.sum()
    return symbols.astype(np.uint32), scaled


def encode(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment as bytes."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    symbols, freq = frequencies(ids) if n else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    known = np.array([x is not None for x in doc_ids], np.uint8)
    names = np.array([x or 0 for x in doc_ids], np.int64)
    head = np.array([MAGIC, len(doc_ids), n, blocks, len(symbols)], "<u4").tobytes()
    head += known.tobytes() + names.astype("<i8").tobytes() + lengths.astype("<i8").tobytes()
    head += symbols.astype("<u4").tobytes() + freq.astype("<u4").tobytes()
    if not n:
        return head
    crcs = np.array([zlib.crc32(ids[at : at + BLOCK].astype("<u4").tobytes()) for at in range(0, n, BLOCK)], "<u4")
    start = np.cumsum(freq) - freq
    place = np.searchsorted(symbols, ids)
    place = np.concatenate([place, np.full(blocks * BLOCK - n, np.argmax(freq))]).reshape(blocks, STEPS, LANES)
    state = np.full((blocks, LANES), LOW, np.uint64)
    words = np.zeros((blocks, STEPS, LANES), np.uint32)
    sent = np.zeros((blocks, STEPS, LANES), bool)
    marks = np.zeros((blocks, STEPS // CHECK, LANES), np.uint64)
    ufreq, ustart = freq.astype(np.uint64), start.astype(np.uint64)
    for s in range(STEPS - 1, -1, -1):
        at = place[:, s]
        f = ufreq[at]
        full = state >= (f << np.uint64(63 - SCALE))
        words[:, s], sent[:, s] = state.astype(np.uint32), full
        state = np.where(full, state >> np.uint64(32), state)
        q = state // f
        state = (q << np.uint64(SCALE)) + (state - q * f) + ustart[at]
        if s % CHECK == 0:
            marks[:, s // CHECK] = state
    per_mark = sent.reshape(blocks, STEPS // CHECK, CHECK * LANES).sum(2)
    size = per_mark.sum(1)
    places = np.cumsum(per_mark, axis=1) - per_mark
    return head + b"".join([crcs.tobytes(), size.astype("<u4").tobytes(), places.astype("<u4").tobytes(), marks.astype("<u8").tobytes(), words[sent].astype("<u4").tobytes()])


def decode(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids of a segment; raises ValueError if a checksum differs."""
    at = 0

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(payload, kind, n, at)
        at += out.nbytes
        return out

    magic, docs, n, blocks, distinct = map(int, take("<u4", 5))
    if magic != MAGIC:
        raise ValueError("not a segment of this format")
    known, names, lengths = take("u1", docs), take("<i8", docs), take("<i8", docs)
    doc_ids = [int(x) if k else None for x, k in zip(names, known)]
    symbols, freq = take("<u4", distinct), take("<u4", distinct).astype(np.uint64)
    if not n:
        return doc_ids, lengths, np.zeros(0, np.uint32)
    crcs, size = take("<u4", blocks), take("<u4", blocks).astype(np.int64)
    each = STEPS // CHECK
    places = take("<u4", blocks * each).astype(np.int64).reshape(blocks, each) + (np.cumsum(size) - size)[:, None]
    state = take("<u8", blocks * each * LANES).reshape(blocks * each, LANES).copy()
    words = np.concatenate([take("<u4", int(size.sum())), np.zeros(LANES, np.uint32)])
    start = np.cumsum(freq, dtype=np.uint64) - freq
    look = np.repeat(np.arange(distinct, dtype=np.uint32), freq.astype(np.int64))
    out = np.zeros((blocks * each, CHECK, LANES), np.uint32)
    read = places.reshape(-1)
    for s in range(CHECK):
        slot = state & np.uint64((1 << SCALE) - 1)
        k = look[slot]
        out[:, s] = k
        state = freq[k] * (state >> np.uint64(SCALE)) + slot - start[k]
        low = state < LOW
        before = np.cumsum(low, axis=1)
        word = words[np.minimum(read[:, None] + before - low, len(words) - 1)]
        state = np.where(low, (state << np.uint64(32)) | word, state)
        read = read + before[:, -1]
    ids = symbols[out.reshape(-1)[:n]]
    for b, crc in enumerate(crcs):
        if zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {b}: its checksum differs")
    return doc_ids, lengths, ids


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, text: str = "text") -> None:
    """Encode every text (null: empty), end each with end_id, and write the ids in ascending doc_id order (null first,
    rows of the same doc_id in the order of their texts). Repeated rows are all written; an empty table has no segment."""
    import pyspark

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(tokenizer)
        kind = np.uint16 if words.size == 2 else np.uint32
        end = np.array([end_id], np.uint32)
        part, segment = pyspark.TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        total = 0

        def closed() -> pa.RecordBatch:
            ids = np.concatenate(held)
            payload = encode(names, np.fromiter(map(len, held), np.int64, len(held)), ids)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "segment": pa.array([segment], pa.int32()), "n_docs": [len(names)], "n_tokens": [len(ids)], "payload": pa.array([payload], pa.binary())})

        for batch in sliced(batches):
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.concatenate([np.frombuffer(words.encode(raw), kind).astype(np.uint32), end])
                if held and total + len(ids) > SEGMENT:
                    yield closed()
                    names, held, total, segment = [], [], 0, segment + 1
                names.append(name)
                held.append(ids)
                total += len(ids)
        if held:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text(text))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "raw")
    made = ordered.mapInArrow(run, "part int, segment int, n_docs long, n_tokens long, payload binary")
    made.write.option("compression", "uncompressed").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before the document's), ids (little-endian unsigned 32-bit) of each document in the files.

    A document's start needs the sizes of all segments before its own: a table of one short row a segment, summed up in order.
    """
    files = spark.read.parquet(path)
    sizes = files.select("part", "segment", "n_tokens")
    whole = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    by_part = whole.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(by_part, "part")
    before = before.select("part", "segment", (F.col("base") + F.col("inside")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                names, lengths, ids = decode(payload.as_py())
                first = np.cumsum(lengths) - lengths
                raw = ids.astype("<u4")
                for at in range(0, len(names), 1024):
                    own = range(at, min(at + 1024, len(names)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[k] for k in own], pa.int64()), pa.array([int(base + first[k]) for k in own], pa.int64()), pa.array([raw[first[k] : first[k] + lengths[k]].tobytes() for k in own], pa.binary())],
                        names=["doc_id", "start", "ids"],
                    )

    return files.select("part", "segment", "payload").join(bounded(before), ["part", "segment"]).select("base", "payload").mapInArrow(run, "doc_id long, start long, ids binary")
