"""Passages that repeat across documents, by relative Lempel-Ziv parsing against blocks of all earlier documents.

The reference of a document is every document of a smaller doc_id. Its blocks are runs of windows of `window` words that follow each other with
one anchor (the smallest GRAM-word hash of a window), with all their words; the index holds each block, and each single window of an anchor
whose blocks differ, with the place where it occurs first: the smallest doc_id and the word there. A document's blocks and windows that the
index has from a smaller doc_id are seeds: a place in the document and one in a reference. Seeds of one reference that
go on there as they do in the document extend each other. The parse is greedy: from the first window that has a seed, the one that
reaches farthest is the factor (its words, the reference and the place in it); windows across the factor's end are looked at next,
so that a factor may begin before the last one's words are over, and what no seed has is literal. Factors of a window's words or more are duplicate spans.

Equal windows have equal anchors, so whatever a document shares with another lies in blocks of the same anchor; only where these
differ, at the ends of what is shared, are windows looked up one by one. So no window is missed, and few are hashed, sent and joined by
themselves. A factor is as long as the reference that the index names for its windows has it; another reference may have a
longer one, which covers no more.

Three steps: anchors that two documents have fill a bitmap, whose size follows their number up to 2**BITS bits (others may be met in it by
chance, none is lost; beyond that size more are, and more blocks are joined in vain); blocks with such anchors are joined to the smallest
doc_id that has them; anchors of several different blocks fill a second bitmap, and the windows under those are joined likewise. Hashes
joined are of 96 bits.

Words are what ASCII white space separates. Null texts have no words. A document that repeats its own passage keeps it. Rows of
one doc_id are judged each by its text and don't make each other's passages duplicates; a row of a null doc_id is neither
reference nor duplicate. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, raw_text, sliced, stored

WINDOW, GRAM = 13, 5
#: Bits of a bitmap for each anchor, and log2 of its bits at most.
SPARSE, BITS = 64, 30
_RANDOM = np.random.default_rng(13)
_ODD = _RANDOM.integers(1, 1 << 63, (3, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _sums(hashes: np.ndarray, width: int, key: int) -> np.ndarray:
    """A hash of each run of `width` words, from the words' hashes."""
    n = len(hashes) - width + 1
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out += hashes[j : j + n] * _ODD[key, j]
    return _mixed(out)


def _words(raw: bytes) -> np.ndarray:
    words = raw.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """The smallest gram hash of the block at each word."""
    grams = _sums(hashes, GRAM, 0)
    n = len(hashes) - window + 1
    out = grams[:n].copy()
    for j in range(1, window - GRAM + 1):
        np.minimum(out, grams[j : j + n], out=out)
    return out


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0), kind))


def _bitmap(anchors: DataFrame, bits: int | None) -> tuple[bytes, int]:
    """Bits of the anchors, 2**bits / 8 bytes, and bits: by the anchors' number if not given."""
    anchors = stored(anchors, "anchors")
    bits = bits or min(BITS, max(16, (SPARSE * anchors.count()).bit_length()))
    place = F.col("anchor").bitwiseAND(F.lit((1 << bits) - 1).cast("long")).alias("place")
    pages = anchors.select(place).groupBy(F.bitmap_bucket_number("place").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    out = np.zeros((max(1 << bits >> 15, 1) + 2, 4096), np.uint8)
    made = stored(pages, "bitmap")
    for r in made.toLocalIterator():
        out[r["page"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    forget(anchors, made)
    return out.tobytes(), bits


def _shared_anchors(rows: DataFrame, window: int) -> DataFrame:
    """Anchors that two or more doc_ids have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            found = [_words(x) for x in part.column(2).to_pylist()]
            found = [np.unique(_anchors(x, window)).view(np.int64) if len(x) >= window else np.zeros(0, np.int64) for x in found]
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(found, pa.int64())], names=["doc_id", "anchors"])

    each = rows.mapInArrow(run, "doc_id long, anchors array<long>").select("doc_id", F.explode("anchors").alias("anchor"))
    return each.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")


#: bitmap_bucket_number counts from 1 for positions over 0, with bit_position (place - 1) % 32768; place 0 is in bucket 0.
def _inside(bitmap: np.ndarray, anchors: np.ndarray, bits: int) -> np.ndarray:
    place = (anchors & np.uint64((1 << bits) - 1)).astype(np.int64)
    bucket = np.where(place > 0, 1 + (place - 1) // 32768, 0)
    at = np.where(place > 0, (place - 1) % 32768, 0)
    return (bitmap[bucket * 4096 + at // 8] >> (at % 8).astype(np.uint8)) & 1 == 1


_BASE = np.array([0xD1342543DE82EF95, 0xAF251AF3B0F025B5], np.uint64)
_BACK = np.array([pow(int(x), -1, 1 << 64) for x in _BASE], np.uint64)


def _runs(windows: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int) -> np.ndarray:
    """A hash of each run of windows, from the windows' hashes: differences of sums over powers, moved back to the start."""
    n = len(windows)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE[key])]))
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BACK[key])]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(windows * power[:n])])
    return _mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * _ODD[2, 63])


_NONE = (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))


def _blocks_of(hashes: np.ndarray, window: int, bitmap: np.ndarray, bits: int, single: bool) -> tuple[np.ndarray, ...]:
    """at, n (windows), anchor, high, low of the blocks whose anchor is in the bitmap, or of their single windows."""
    if len(hashes) < window:
        return _NONE
    anchors = _anchors(hashes, window)
    starts = np.arange(len(anchors)) if single else np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    ends = np.append(starts[1:], len(anchors))
    own = _inside(bitmap, anchors[starts], bits)
    if not own.any():
        return _NONE
    starts, ends = starts[own], ends[own]
    high, low = _sums(hashes, window, 1), _sums(hashes, window, 2)
    high, low = (high[starts], low[starts]) if single else (_runs(high, starts, ends, 0), _runs(low, starts, ends, 1))
    return starts.astype(np.int32), (ends - starts).astype(np.int32), anchors[starts].view(np.int64), high.view(np.int64), low.astype(np.uint32).view(np.int32)


def _blocks(rows: DataFrame, window: int, anchors: DataFrame, bits: int | None, single: bool) -> DataFrame:
    """doc_id, text_hash, at, n, anchor, high, low of each block or window of every row with one of the anchors, written to the shared folder."""
    bitmap, bits = _bitmap(anchors, bits)
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.frombuffer(shared.value, np.uint8)
        for part in sliced(batches):
            found = list(zip(*(_blocks_of(_words(x), window, there, bits, single) for x in part.column(2).to_pylist())))
            lists = [_lists(list(x), kind) for x, kind in zip(found, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], names=["doc_id", "text_hash", "at", "n", "anchor", "high", "low"])

    made = rows.mapInArrow(run, "doc_id long, text_hash long, at array<int>, n array<int>, anchor array<long>, high array<long>, low array<int>").where(F.size("at") > 0)
    held = stored(made, "windows" if single else "blocks")
    return held.select("doc_id", "text_hash", F.explode(F.arrays_zip("at", "n", "anchor", "high", "low")).alias("b")).select("doc_id", "text_hash", "b.*")


def _seeds(blocks: DataFrame, first: DataFrame, tag: str) -> DataFrame:
    """doc_id, text_hash, at, n, ref, ref_at: blocks that a smaller doc_id has too, with the smallest and the first word of it there."""
    # stored, so that a join deals out both sides itself and can split what a frequent block fills
    met = stored(blocks.join(first, ["high", "low"]).select("doc_id", "text_hash", "at", "n", "high", "low", F.col("first").alias("ref")), tag)
    places = stored(met.where("doc_id = ref").groupBy("high", "low").agg(F.min("at").alias("ref_at")), f"{tag}-places")
    return met.where("ref < doc_id").join(places, ["high", "low"]).select("doc_id", "text_hash", "at", "n", "ref", "ref_at")


def seeds(docs: DataFrame, window: int = WINDOW, bits: int | None = None, text: str = "text") -> DataFrame:
    """doc_id, text_hash, at, n, ref, ref_at: the words at which n windows begin that follow word ref_at of document ref too, ref < doc_id."""
    rows = _keyed(docs, text).where("doc_id is not null")
    blocks = _blocks(rows, window, _shared_anchors(rows, window), bits, single=False)
    # counted per task first, so that what a third of all documents have is a few rows here
    first = stored(blocks.groupBy("anchor", "high", "low").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "first")
    whole = stored(_seeds(blocks, first.where("first < last").select("high", "low", "first"), "met"), "whole")
    several = first.groupBy("anchor").count().where("count > 1").select("anchor")
    windows = _blocks(rows, window, several, bits, single=True)
    one = windows.groupBy("high", "low").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    return whole.union(_seeds(windows, stored(one, "one"), "met-one"))


def parsed(hits: list[tuple[int, int, int, int]], window: int) -> list[tuple[int, int, int, int]]:
    """The factors (at, words, ref, ref_at) of a document, from its seeds (at, n, ref, ref_at)."""
    lines: dict[tuple[int, int], list[list[int]]] = {}
    for at, n, ref, ref_at in sorted(hits):
        own = lines.setdefault((ref, ref_at - at), [])
        if own and own[-1][1] >= at:  # goes on in the reference
            own[-1][1] = max(own[-1][1], at + n)
        else:
            own.append([at, at + n])
    runs = sorted((at, to, ref, ref_at) for (ref, ref_at), own in lines.items() for at, to in own)
    out: list[tuple[int, int, int, int]] = []
    k, at, best = 0, 0, None
    while k < len(runs) or best:
        if best is None:
            at = max(at, runs[k][0])
        while k < len(runs) and runs[k][0] <= at:
            if runs[k][1] > at and (best is None or runs[k][1] > best[1]):
                best = runs[k]
            k += 1
        if best:
            out.append((at, best[1] - at + window - 1, best[2], at + best[3]))
            at, best = best[1], None
    return out


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text(text)).select("doc_id", F.xxhash64("raw").alias("text_hash"), "raw")


def _parses(docs: DataFrame, window: int, bits: int | None, text: str) -> DataFrame:
    """doc_id, text_hash, and its factors as at, words, ref, ref_at (arrays of equal length) of each document that has any."""
    found = seeds(docs, window, bits, text).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("at", "n", "ref", "ref_at")).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            each = [parsed(list(zip(*hits)), window) for hits in zip(*(part.column(k).to_pylist() for k in range(2, 6)))]
            columns = [_lists([np.array([f[k] for f in own], np.int64) for own in each], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["doc_id", "text_hash", "at", "words", "ref", "ref_at"])

    hits = found.select("doc_id", "text_hash", *[F.col(f"h.{c}") for c in ("at", "n", "ref", "ref_at")])
    return stored(hits.mapInArrow(run, "doc_id long, text_hash long, at array<long>, words array<long>, ref array<long>, ref_at array<long>"), "parses")


def factors(docs: DataFrame, window: int = WINDOW, bits: int | None = None, text: str = "text") -> DataFrame:
    """doc_id, text_hash, at, words, ref, ref_at: the factors of each document: that many words from word `at` on are those from word ref_at of
    document ref on. Rows of equal doc_id and text give their factors once."""
    each = F.explode(F.arrays_zip("at", "words", "ref", "ref_at")).alias("f")
    return _parses(docs, window, bits, text).select("doc_id", "text_hash", each).select("doc_id", "text_hash", "f.*")


def covered(n: int, at: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether each of n words lies in a factor."""
    turns = np.zeros(n + 1, np.int64)
    np.add.at(turns, at, 1)
    np.add.at(turns, at + words, -1)
    return np.cumsum(turns)[:n] > 0


def without_repeats(docs: DataFrame, window: int = WINDOW, bits: int | None = None, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (what is left, words joined by one blank) of every row."""
    return _removed(docs, window, bits, text, lambda kept: kept.decode("utf-8", "replace"), "kept")


def digests(docs: DataFrame, window: int = WINDOW, bits: int | None = None, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    return _removed(docs, window, bits, text, lambda kept: hashlib.sha256(kept).hexdigest(), "kept_sha256")


def _removed(docs: DataFrame, window: int, bits: int | None, text: str, made, name: str) -> DataFrame:
    rows = _keyed(docs, text).join(_parses(docs, window, bits, text).select("doc_id", "text_hash", "at", "words"), ["doc_id", "text_hash"], "left").select("doc_id", "raw", "at", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            counts, removed, out = [], [], []
            for raw, at, long in zip(*(part.column(k).to_pylist() for k in range(1, 4))):
                words = raw.split()
                gone = covered(len(words), np.array(at), np.array(long)) if at else None
                kept = words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g]
                counts.append(len(words))
                removed.append(len(words) - len(kept))
                out.append(made(b" ".join(kept)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n_words", "n_removed", name])

    return rows.mapInArrow(run, f"doc_id long, n_words long, n_removed long, {name} string")
