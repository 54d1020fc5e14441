"""Near copies: texts whose sets of SHINGLE-word runs have a Jaccard similarity of ALIKE / OF or more; none is missed.

Words are what ASCII white space separates after A-Z are lower-cased; a text of fewer words has one run of all. Equal sets are
one node. Texts whose SimHash fingerprints (of all their runs, as simhash) differ by RADIUS bits or fewer are found by multi-index hashing,
checked by their sets and linked. At this similarity fingerprints differ by about ten bits, for which multi-index hashing needs
thousands of probes a fingerprint or buckets that grow with the corpus (README), so that an exact check of the rest follows.

That goes by prefix filtering: two sets that similar share a run among the first (1 - ALIKE / OF) * n + 1 of each, in any order
common to all sets; the order here puts runs that many sets have last, by counts in windows of WINDOW runs, which bear on the cost only.
Sets that meet there, whose places allow the similarity and which fingerprints haven't linked, are compared whole: in turns each with
some of those it meets, then all that meet and aren't yet in one component. Linked texts form a component.

Runs meet by 64-bit hashes. What is kept of a whole set, and compared, is 32 bits of each, so that two runs of one text that share
these count as one: some k**2 / 2**33 of k runs.

Null and empty texts have the empty set and are near copies of each other. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import bounded, forget, raw_text, sliced, stored
from .simhash import BLOCK, SEED, components

SHINGLE = 5
ALIKE, OF = 4, 5
#: Bits by which fingerprints are linked.
RADIUS = 4
#: Runs that a task counts at a time; how often one occurs among them to be noted; how many are listed as frequent.
WINDOW, OFTEN, LISTED = 1 << 21, 3, 1 << 18
#: Runs of prefixes that a task packs at a time and that are met in one group, on average; how many of one run are compared pair by pair.
ROWS, FEW = 1 << 18, 32
#: Nodes that a task remembers; times as many nodes that a run names in the next turn.
MET, MORE = 1 << 20, 8
#: Numbers of parities at most.
WIDE = 256


def hashes(raw: bytes) -> np.ndarray:
    """The hashes of a text's runs of words, repeats included."""
    words = raw.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if n <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: n - SHINGLE + 1], ends[SHINGLE - 1 :]
    each = []
    for at in range(0, len(starts), BLOCK):
        spans = map(slice, starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist())
        each.append(np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, spans), repeat(SEED)), np.uint64))
    return np.concatenate(each)


def runs(raw: bytes) -> np.ndarray:
    """The sorted distinct hashes of a text's runs of words."""
    return np.unique(hashes(raw))


def _row(text: str) -> Column:
    """A number for each doc_id and text, by which rows are dropped."""
    return F.xxhash64(F.col("doc_id").cast("long"), raw_text(text))


def _frequent(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of runs that many sets have, and in how many, as a power of two. A run counts where a window has it OFTEN or more
    times, so that what goes out follows the runs that are shared, and one in f of w windows' sets is found where f**OFTEN is some w**(OFTEN - 1)
    or more. Of more than LISTED those of the greatest powers are listed."""

    def noted(held: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(held)
        x.sort()
        starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        n = np.diff(np.append(starts, len(x)))
        many = n >= OFTEN
        return pa.RecordBatch.from_arrays([pa.array(x[starts[many]].view(np.int64)), pa.array(n[many])], names=["run", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        out: list[np.ndarray] = []
        held = 0
        for part in sliced(batches):
            for raw in part.column(0).to_pylist():
                x = runs(raw)
                node = xxhash.xxh64_intdigest(x.tobytes(), SEED)
                if not len(x) or node in met:
                    continue
                met.add(node)
                out.append(x)
                held += len(x)
                if held >= WINDOW:
                    yield noted(out)
                    met.clear()
                    out.clear()
                    held = 0
        if out:
            yield noted(out)

    counted = docs.select(raw_text(text)).mapInArrow(run, "run long, n long").groupBy("run").agg(F.floor(F.log2(F.sum("n"))).cast("int").alias("level"))
    counts = stored(counted, "counts")
    least, all_listed = 64, 0
    for r in sorted(counts.groupBy("level").count().collect(), reverse=True):  # 64 rows at most
        if (all_listed := all_listed + r["count"]) > LISTED:
            break
        least = r["level"]
    listed = counts.where(F.col("level") >= least).toArrow()  # LISTED rows at most
    forget(counts)
    run_, level = listed.column("run").to_numpy().view(np.uint64), listed.column("level").to_numpy().astype(np.uint8)
    order = np.argsort(run_)
    return run_[order], level[order]


def _level(x: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The levels of sorted hashes; of one that isn't listed zero."""
    run, level = frequent
    if not len(run):
        return np.zeros(len(x), np.uint8)
    at = np.minimum(np.searchsorted(run, x), len(run) - 1)
    return np.where(run[at] == x, level[at], 0)


def sets(docs: DataFrame, text: str = "text") -> DataFrame:
    """row, doc_id, node (a number for each set), n (its size), fp (the SimHash fingerprint) of every row; runs (32 bits of each run's hash), first (the whole hashes of
    those by which similar sets meet, in their order) and bits (parities) once at least for each node, else null: a task that met a node
    before leaves them out."""
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(docs, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for part in sliced(batches):
            rows: list[tuple] = []
            for raw in part.column(2).to_pylist():
                every = hashes(raw)
                x, fp = np.unique(every), simhash.majority([every])
                node, n = xxhash.xxh64_intdigest(x.tobytes(), SEED), len(x)
                if node in met:
                    rows.append((node, n, None, None, None, fp))
                    continue
                if len(met) == MET:
                    met.clear()
                met.add(node)
                first = x[np.argsort(_level(x, shared.value), kind="stable")[: n - -(-ALIKE * n // OF) + 1]]
                short = np.unique(x.astype(np.uint32))
                rows.append((node, n, short.tobytes(), first.tobytes(), parities(short), fp))
            node = np.array([r[0] for r in rows], np.uint64).view(np.int64)
            fps = np.array([r[5] for r in rows], np.uint64).view(np.int64)
            rest = [pa.array([r[k] for r in rows], kind) for k, kind in ((1, pa.int64()), (2, pa.binary()), (3, pa.binary()), (4, pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(node), *rest, pa.array(fps)], names=["row", "doc_id", "node", "n", "runs", "first", "bits", "fp"])

    kept = docs.select(_row(text).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), raw_text(text))
    return kept.mapInArrow(run, "row long, doc_id long, node long, n long, runs binary, first binary, bits array<long>, fp long")


def _meeting(key: np.ndarray, node: np.ndarray, n: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rows, each once, whose set meets another at the same key with places that allow the similarity, as _may says. Of a key that over
    FEW sets have all rows stay."""
    order = np.lexsort((node, key))
    key, node, n, place = (x[order] for x in (key, node, n, place))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node, n, place = (x[new] for x in (key, node, n, place))
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(key)))
    size = np.repeat(sizes, sizes)
    stays, left = size > FEW, n - place
    at = np.flatnonzero((size > 1) & ~stays)
    for step in range(1, FEW):
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        if not len(at):
            break
        other = at + step
        may = np.minimum(left[at], left[other]) * (ALIKE + OF) >= (n[at] + n[other]) * ALIKE
        stays[at[may]] = stays[other[may]] = True
    return tuple(x[stays] for x in (key, node, n, place))


def prefixes(rows: DataFrame) -> DataFrame:
    """key, node, n, place: the runs of each set by which similar ones meet, where they meet one that they may be similar to. Runs go packed,
    24 bytes each, to groups by their hashes, in numbers that follow theirs."""
    whole = rows.where("n > 0 and first is not null").select("node", "n", "first")
    total = (whole.agg(F.sum(F.length("first"))).first()[0] or 0) // 8
    groups = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + total // ROWS)

    def packed(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, node, n, place = (np.concatenate(x) for x in zip(*held))
        own = key.view(np.uint64) % np.uint64(groups)
        order = np.argsort(own, kind="stable")
        numbers, starts = np.unique(own[order], return_index=True)
        cut = [np.split(x[order], starts[1:]) for x in (key, node, n.astype(np.uint32), place.astype(np.uint32))]
        return pa.RecordBatch.from_arrays([pa.array(numbers.astype(np.int64)), pa.array([b"".join(x.tobytes() for x in one) for one in zip(*cut)], pa.binary())], names=["own", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, ...]] = []
        held = 0
        for part in sliced(batches):
            for node, n, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist()):
                first = np.frombuffer(x, np.int64)
                for at in range(0, len(first), ROWS):
                    some = first[at : at + ROWS]
                    out.append((some, np.full(len(some), node, np.int64), np.full(len(some), n, np.int64), np.arange(at, at + len(some), dtype=np.int64)))
                    held += len(some)
                    if held >= ROWS:
                        yield packed(out)
                        out.clear()
                        held = 0
        if out:
            yield packed(out)

    def met(own: pa.Table) -> pa.Table:
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for x in own.column("packed"):
            raw = x.as_buffer()
            k = raw.size // 24
            for into, kind, at in zip(parts, (np.int64, np.int64, np.uint32, np.uint32), (0, 8 * k, 16 * k, 20 * k)):
                into.append(np.frombuffer(raw, kind, k, at))
        key, node, n, place = (np.concatenate(x).astype(np.int64) for x in parts)
        return pa.table(dict(zip(("key", "node", "n", "place"), map(pa.array, _meeting(key, node, n, place)))))

    return whole.mapInArrow(run, "own long, packed binary").groupBy("own").applyInArrow(met, "key long, node long, n long, place long")


def parities(runs: np.ndarray) -> np.ndarray:
    """How often runs fall on each place, modulo two: two bits for each run or more, up to WIDE numbers of 64 bits, in a power of two of
    them. Sets differ in at least as many runs as their parities differ in places."""
    wide = 1 << min(WIDE.bit_length() - 1, max(0, (len(runs) // 32)).bit_length())
    odd = np.bincount((runs % np.uint32(64 * wide)).astype(np.int64), minlength=64 * wide) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _near(a: str, b: str) -> Column:
    """Whether sets can be similar by their parities. Those of similar sets are as long, or one's twice the other's: it is folded."""
    x, y = F.col(f"{a}.bits"), F.col(f"{b}.bits")

    def folded(v: Column, to: Column) -> Column:
        return F.when(F.size(v) > F.size(to), F.zip_with(F.slice(v, F.lit(1), F.size(to)), F.slice(v, F.size(to) + 1, F.size(to)), lambda p, q: p.bitwiseXOR(q))).otherwise(v)

    off = F.aggregate(F.zip_with(folded(x, y), folded(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, n: s + n)
    return off * (ALIKE + OF) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (OF - ALIKE)


def _may(a: str, b: str) -> Column:
    """Whether sets that meet first at these places can be similar: what is left of each bounds what they share."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return F.least(n - F.col(f"{a}.place"), m - F.col(f"{b}.place")) * (ALIKE + OF) >= (n + m) * ALIKE


def _possible(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs a, b whose sizes and parities allow that their sets are similar."""
    names = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "names")
    bits = rows.where("bits is not null").join(bounded(names), "node", "left_semi").groupBy("node").agg(F.first(F.struct("n", "bits")).alias("own"))
    own = lambda c, to: bits.select(F.col("node").alias(c), F.col("own").alias(to))
    long = F.least("x.n", "y.n") * OF >= F.greatest("x.n", "y.n") * ALIKE
    found = stored(pairs.join(own("a", "x"), "a").join(own("b", "y"), "b").where(long & _near("x", "y")).select("a", "b"), "possible")
    forget(names)
    return found


def _alike(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs a, b whose sets are similar."""
    names = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "names")
    # one set a node and task goes out, however many rows have it
    one = rows.where("runs is not null").join(bounded(names), "node", "left_semi").groupBy("node").agg(F.first("runs").alias("runs"))
    whole = stored(one, "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            yes = []
            for x, y in zip(part.column(2), part.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)
                yes.append(len(np.intersect1d(x, y, assume_unique=True)) * (ALIKE + OF) >= (len(x) + len(y)) * ALIKE)
            yield part.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))

    left = pairs.join(whole.select(F.col("node").alias("a"), F.col("runs").alias("x")), "a")
    both = left.join(whole.select(F.col("node").alias("b"), F.col("runs").alias("y")), "b")
    found = stored(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "alike")
    forget(whole, names)
    return found


def _pairs(one: Column, two: Column) -> list[Column]:
    return [F.least(one, two).alias("a"), F.greatest(one, two).alias("b")]


def _open(met: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of met with their roots moved to those of roots, where nodes of several components still meet."""
    to = roots.select(F.col("node").alias("root"), F.col("root").alias("to"))
    moved = stored(met.join(to, "root", "left").withColumn("root", F.coalesce("to", "root")).drop("to"), "moved")
    several = moved.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key")
    left = stored(moved.join(several, "key", "left_semi"), "prefixes")
    forget(moved)
    return left


def _joined(found: DataFrame, met: DataFrame) -> DataFrame:
    """node, root: the roots of met as the pairs found connect them, each with its component's."""
    own = met.select("node", "root").distinct()
    x, y = (own.select(F.col("node").alias(c), F.col("root").alias(to)) for c, to in (("a", "x"), ("b", "y")))
    return components(found.join(x, "a").join(y, "b").select(F.col("x").alias("a"), F.col("y").alias("b")))


def near_fingerprints(rows: DataFrame) -> DataFrame:
    """Pairs a, b of nodes whose fingerprints are equal or linked, by multi-index hashing: of each linked fingerprint two at most, the first and
    the last of its links in an order of their hashes."""
    nodes = stored(rows.where("n > 0").select("fp", "node").distinct(), "nodes")
    fps = stored(nodes.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    same = nodes.join(fps, "fp").where("node != least").select(*_pairs(F.col("least"), F.col("node")))
    linked = stored(simhash.links(fps.select("fp"), RADIUS, simhash.segments_for(fps.count())), "linked")
    ends = linked.union(linked.select("b", "a")).groupBy("a").agg(*[f(F.struct(F.xxhash64("b").alias("h"), "b"))["b"].alias(c) for f, c in ((F.min, "h0"), (F.max, "h1"))])
    two = ends.select("a", F.explode(F.array("h0", "h1")).alias("b")).select(*_pairs(F.col("a"), F.col("b"))).distinct()
    least = lambda c: fps.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_node"))
    across = two.join(least("a"), "a").join(least("b"), "b").where("a_node != b_node").select(*_pairs(F.col("a_node"), F.col("b_node")))
    found = stored(same.union(across).distinct(), "near")
    forget(nodes, fps, linked)
    return found


def links(rows: DataFrame) -> DataFrame:
    """Pairs a, b of similar nodes that connect all that are connected.

    Those that fingerprints name come first; runs that only nodes of one component have are done. Then every run that nodes of several
    components have names two of them, the smallest and the largest, and all others are compared with these. Of a run that three nodes or
    fewer have these are all pairs, and it is done; so are most runs that texts share by chance.

    What is left goes with its parities, in turns: each run names some of its nodes, in an order drawn anew that is the same for all
    runs, and those of other components whose parities allow the similarity are compared with these. What is found similar becomes one
    component before the next turn, which names MORE times as many; so near copies of each other cost a few pairs a node, not all their
    pairs, however many dissimilar sets share their runs. Turns end when no run has over FEW nodes, or when as many pairs as in the last
    turn from all nodes would be fewer than rows. Then all that meet in different components and weren't compared are."""
    tested = [near_fingerprints(rows)]
    found: list[DataFrame] = []

    def compared(pairs: DataFrame, told: bool) -> int:
        """How many of the pairs weren't compared before; they are now. told: their parities allow it."""
        for known in tested:
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        tested.append(stored(pairs, "star"))
        possible = tested[-1] if told else _possible(tested[-1], rows)
        found.append(_alike(possible, rows))
        if not told:
            forget(possible)
        return tested[-1].count()

    first = _possible(tested[0], rows)
    found.append(_alike(first, rows))
    roots = components(found[0])
    all_met = stored(prefixes(rows), "prefixes")
    met = _open(all_met.withColumn("root", F.col("node")), roots)
    forget(first, all_met, roots)

    order = F.struct("n", "node", "place", "root")
    hubs = stored(met.groupBy("key").agg(F.min(order).alias("h0"), F.max(order).alias("h1"), F.count("*").alias("size")), "hubs")
    star = met.withColumn("own", F.struct("n", "place")).join(hubs.select("key", F.explode(F.array("h0", "h1")).alias("hub")), "key")
    star = star.where(F.col("hub.root") != F.col("root")).where(_may("hub", "own")).select(*_pairs(F.col("hub.node"), F.col("node"))).distinct()
    compared(star, False)
    roots = _joined(found[-1], met)
    left = _open(met.join(hubs.where("size > 3").select("key"), "key", "left_semi"), roots)
    forget(met, roots, hubs)

    # parities once a node; a row for each run and node has them within a turn only
    names = stored(left.select("node").distinct(), "names")
    bits = stored(rows.where("bits is not null").join(bounded(names), "node", "left_semi").groupBy("node").agg(F.first("bits").alias("bits")), "bits")
    forget(names)
    turn, many = 1, 2
    may = (F.col("a.key") == F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & _may("a", "b") & _near("a", "b")
    ends = _pairs(F.col("a.node"), F.col("b.node"))
    while True:
        sizes = left.groupBy("key").count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
        if (sizes["most"] or 0) <= FEW or many >= sizes["most"]:
            break
        wide = stored(left.join(bits, "node"), "parities")
        # one of each part of a run's nodes, so that partial aggregates choose them
        hub = F.struct(F.xxhash64(F.lit(turn), "node").alias("h"), "node", "n", "place", "root", "bits")
        hubs = wide.groupBy("key", F.pmod(F.xxhash64(F.lit(-turn), "node"), F.lit(many)).alias("part")).agg(F.min(hub).alias("hub")).select("key", "hub.*")
        tried = compared(hubs.alias("a").join(wide.alias("b"), may).select(*ends).distinct(), True)
        forget(wide)
        roots = _joined(found[-1], left)
        still = _open(left, roots)
        forget(left, roots)
        left = still
        if tried * sizes["most"] <= many * sizes["all"]:
            break
        turn, many = turn + 1, many * MORE
    wide = stored(left.join(bits, "node"), "parities")
    compared(wide.alias("a").join(wide.alias("b"), may & (F.struct("a.n", "a.node") < F.struct("b.n", "b.node"))).select(*ends).distinct(), True)
    forget(wide, left, bits, *tested)
    return reduce(DataFrame.unionAll, found)


def one_of_each(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, nulls last. Rows are told apart by
    doc_id and text, so that a repeated or null doc_id costs no other component a row; of rows that repeat both one stays."""
    rows = stored(sets(docs, text), "sets")
    roots = stored(components(links(rows)), "roots")
    placed = stored(rows.select("row", "doc_id", "node").join(roots, "node", "left").select("row", "doc_id", F.coalesce("root", "node").alias("root")), "rows")
    forget(rows)
    first = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("kept"))
    found = stored(placed.join(first, "root").select("row", "kept"), "found")
    forget(placed)
    gone = stored(found.where("row != kept").select(F.col("row").alias("gone")).distinct(), "gone")
    # Spark broadcasts what goes below its own threshold; beyond it, both sides are shuffled
    out = docs.join(gone, _row(text) == F.col("gone"), "left_anti")
    repeated = not found.where("row = kept").groupBy("row").count().where("count > 1").isEmpty()
    return out.withColumn("kept_row", _row(text)).dropDuplicates(["kept_row"]).drop("kept_row") if repeated else out
