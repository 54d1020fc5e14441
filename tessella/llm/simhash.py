"""SimHash near-duplicates by multi-index hashing.

A text's words are what ASCII white space separates after A-Z are lower-cased; its features are all runs of
`shingle` words, repeats included (all words, if fewer). A fingerprint bit is 1 if more than half the features' XXH64 have it.
Two fingerprints link at `radius` or fewer differing bits; documents of linked fingerprints form a component.

Null and empty texts have fingerprint zero and link like any other. Rows with equal fingerprints are one node,
so copies cost nothing. Repeated doc_ids are separate rows of the result; a null doc_id never names a component
unless all its members' ids are null. Other columns of the input are ignored. No table size is special.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, raw_text, sliced, stored

SEED = 42
BITS = 64
#: Features hashed at a time, which bounds the memory that a very long text takes.
BLOCK = 1 << 16
#: Fingerprints of a bucket, on average, up to which there are more segments.
FULL = 16


def fingerprint(raw: bytes, shingle: int) -> int:
    """The unsigned 64-bit SimHash of a UTF-8 text."""
    words = raw.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: n - shingle + 1], ends[shingle - 1 :]
    each = []
    for at in range(0, len(starts), BLOCK):
        spans = map(slice, starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist())
        each.append(np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, spans), repeat(SEED)), np.uint64))
    return majority(each)


def majority(blocks: list[np.ndarray]) -> int:
    """The SimHash of features' hashes: the bits that over half of them have; of none zero."""
    ones = np.zeros(BITS, np.int64)
    for hashes in blocks:
        for at in range(0, len(hashes), BLOCK):
            bits = np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > sum(map(len, blocks)), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 4, text: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            fps = np.fromiter((fingerprint(x, shingle) for x in part.column(1).to_pylist()), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text(text))
    return kept.mapInArrow(run, "doc_id long, fp long")


def layout(radius: int, segments: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment to search: with radius = a * segments + b, two fingerprints that
    close differ by at most a in one of the first b + 1 segments or by at most a - 1 in another."""
    a, b = divmod(radius, segments)
    found, shift = [], 0
    for s in range(segments):
        width = BITS // segments + (s >= segments - BITS % segments)
        if (own := a if s <= b else a - 1) >= 0:
            found.append((shift, width, own))
        shift += width
    return found


def ball(width: int, radius: int) -> list[int]:
    """All masks of at most `radius` of `width` bits, as signed longs."""
    masks = [sum(1 << i for i in at) for r in range(radius + 1) for at in combinations(range(width), r)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _masks(width: int, radius: int):
    return F.from_json(F.lit(str(ball(width, radius))), "array<bigint>")


def segments_for(n: int) -> int:
    """The most segments whose buckets hold FULL of n evenly spread fingerprints or fewer: more make smaller balls, fewer longer keys."""
    return next((s for s in (4, 3) if n <= FULL << BITS // s), 2)


def links(fps: DataFrame, radius: int = 4, segments: int = 3, hot: int = 1024) -> DataFrame:
    """Pairs a, b that connect whatever distinct fingerprints fp are linked.

    Tables hold every fingerprint under its exact segments; probes enumerate the small Hamming ball of each segment,
    fetch matches and verify whole distances. Buckets of over `hot` fingerprints, whose pairs would grow with the square,
    go another exact way: two fingerprints are within the radius if and only if a 64-bit point lies within
    radius // 2 of one and within the rest of the other; each point joins what it sees to the smallest, so that
    links grow with the number of fingerprints. At most a ball's size meets at a point, whatever the data.
    """
    parts = layout(radius, segments)
    key = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1).cast("long")) for s, w, _ in parts]
    table = fps.select("fp", F.posexplode(F.array(*key)).alias("seg", "key"))
    crowded = stored(table.groupBy("seg", "key").count().where(F.col("count") > hot).select("seg", "key"), "crowded")
    balls = F.array(*[F.transform(_masks(w, r), k.bitwiseXOR) for k, (_, w, r) in zip(key, parts)])
    probes = fps.select("fp", F.posexplode(balls).alias("seg", "keys")).select("fp", "seg", F.explode("keys").alias("key"))
    far = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    some = not crowded.isEmpty()
    left, right = (x.join(crowded, ["seg", "key"], "left_anti") if some else x for x in (probes, table))
    found = (
        left.withColumnRenamed("fp", "a").join(right.withColumnRenamed("fp", "b"), ["seg", "key"])
        .where((F.col("a") < F.col("b")) & (far <= radius)).select("a", "b")
    )
    if some:
        dense = probes.join(crowded, ["seg", "key"], "left_semi").select("fp").distinct()
        found = found.union(_dense_links(dense, radius))
    return found.distinct()


def _dense_links(fps: DataFrame, radius: int) -> DataFrame:
    near, rest = ball(BITS, radius // 2), ball(BITS, radius - radius // 2)
    point = F.col("fp").bitwiseXOR(F.col("m"))
    masks = F.from_json(F.lit(str(rest)), "array<bigint>")
    seen = fps.select("fp", F.posexplode(masks).alias("i", "m")).select("fp", point.alias("z"), (F.col("i") < len(near)).alias("near"))
    hub = seen.where("near").groupBy("z").agg(F.min("fp").alias("a"))
    return seen.join(hub, "z").where("fp != a").select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: nodes of the pairs a, b, each with its component's root, by repeated contraction.

    In each round every node moves to the neighbour (or itself) that comes first in an order drawn anew, and pairs that
    met vanish; each round is written to the shared folder. Only the number of pairs left reaches the driver.
    """
    pairs = stored(edges.select("a", "b").where("a != b").distinct(), "pairs")
    roots = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "roots")
    step = 0
    while not pairs.isEmpty():
        rank = lambda c, s=step: F.struct(F.xxhash64(F.lit(s), c).alias("h"), c.alias("n"))
        ends = pairs.union(pairs.select(F.col("b"), F.col("a")))
        to = ends.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m"))
        to = stored(to.select(F.col("a").alias("from"), F.least(rank(F.col("a")), F.col("m"))["n"].alias("to")), "parents")
        moved = stored(roots.join(to, roots["root"] == to["from"], "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        one = pairs.join(to, pairs["a"] == to["from"]).select(F.col("to").alias("a"), "b")
        two = one.join(to, one["b"] == to["from"]).select("a", F.col("to").alias("b")).where("a != b")
        left = stored(two.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        forget(pairs, roots, to)
        pairs, roots = left, moved
        step += 1
    return roots


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, segments: int | None = None, text: str = "text", hot: int = 1024) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id of the component) of every row; segments follow the number of fingerprints if not given."""
    rows = stored(fingerprints(docs, shingle, text), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), radius, segments or segments_for(nodes.count()), hot))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = placed.join(least, "root").select("fp", "component_id")
    return rows.join(ids, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, **kind) -> DataFrame:
    """docs without all but the row of the smallest doc_id of each component; of rows that repeat that doc_id one stays.
    A component of null doc_ids only keeps one row."""
    found = stored(near_duplicates(docs, **kind), "found")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    kept = stored(found.where(first).groupBy(F.col("doc_id").alias("kept_id")).count(), "kept")
    gone = found.where(~first).select(F.col("doc_id").alias("gone_id")).distinct()
    gone = stored(gone.join(kept, F.col("gone_id").eqNullSafe(F.col("kept_id")), "left_anti"), "gone")
    # Spark broadcasts what goes below its own threshold; beyond it, both sides are shuffled
    out = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("gone_id")), "left_anti")
    repeated = not kept.where("count > 1").isEmpty()
    return out.dropDuplicates(["doc_id"]) if repeated else out
