"""Nearest neighbours by largest inner product, from balanced posting lists.

With the largest norm L of all vectors, x becomes (x, sqrt(L**2 - |x|**2)) and a query (q, 0): nearest by distance is then largest by
inner product; all x are of length L then, and so are centroids and, scaled, queries. The number of lists is the square root of the vectors', up to LISTS. Their centroids come from balanced k-means over at
most SAMPLE vectors or PER_LIST a list (those of the smallest hash of vec_id), by two levels if there are more than FLAT: the square root
of their number first, then each part's own share. Every vector is indexed: in the list of its nearest centroid, and in those of
up to REPLICAS further ones that are hardly farther and not nearer to a list it is in already. A query searches a graph of the
centroids, held in memory, best first, until what is left is farther than SLACK * near times the smallest distance (and than the
BEAM nearest), and takes the lists within `near` times the smallest distance, however many, and further ones until they hold READ vectors.
How far `near` must reach goes with the vectors (hardly at all where they cluster, far where they don't), so it is measured: ASKED vectors of the
sample, each with its nearest ones there, would find FOUND of these. Neighbours in a sample are farther than among all, so that all fare better.

Lists are dealt out in blocks by salted keys, as many as vectors and queries in them ask for, so that copies of one vector fill many
blocks; each block gives a query's best k by a matrix product, and these meet by query_id. No list or block is capped.

Vectors that are null, zero, hold null or non-finite components, or aren't as long as most, take no part; nor do null vec_ids. Rows of one
vec_id count as one candidate, by their best score, and as one query, by the smallest of their vectors. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import sliced, stored

SAMPLE, PER_LIST, LISTS, FLAT = 16_384, 8, 65_536, 512
REPLICAS, CLOSE = 4, 1.08
DEGREE, BEAM, NEAR = 24, 128, 1.16
#: Sample vectors by which `near` is measured, and the share of their neighbours that must be found.
ASKED, FOUND = 512, 0.95
#: How much farther than `near` the search goes, for lists that only farther ones lead to.
SLACK = 1.1
#: Vectors that a query reads at least, if there are so many.
READ = 2_048
#: Vectors and queries of a block, about; queries of a task that searches the graph; numbers of a matrix at a time.
VECTORS, QUERIES, SEARCHES, NUMBERS = 16_384, 8_192, 256, 1 << 22


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 20, weight: float = 0.2, seed: int = 3) -> np.ndarray:
    """k-means of vectors of one length, whose centroids are of that length too, so that none is near to all for lying in their midst;
    assignment pays for lists that are fuller than the mean."""
    draw = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    c = distinct[draw.permutation(len(distinct))[:k]]
    sizes, long = np.full(k, len(x) / k), np.sqrt((x[0] ** 2).sum())
    for _ in range(rounds):
        d = _square(x, c)
        fee = weight * np.median(d.min(1)) * (sizes / (len(x) / k) - 1)
        own = np.argmin(d + np.clip(fee, -np.inf, 4 * abs(weight) * np.median(d.min(1)))[None], axis=1)
        sizes = np.bincount(own, minlength=k).astype(float)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.sqrt((sums**2).sum(1))
        filled = size > 1e-9 * long
        c[filled] = sums[filled] * (long / size[filled])[:, None]
        c[~filled] = x[draw.integers(0, len(x), (~filled).sum())]
    return c


def centroids_of(x: np.ndarray, k: int) -> np.ndarray:
    """k balanced centroids (fewer, if there are fewer vectors), by two levels if k is over FLAT."""
    if k <= FLAT:
        return balanced_centroids(x, k)
    coarse = balanced_centroids(x, round(k**0.5))
    own = np.concatenate([np.argmin(_square(part, coarse), axis=1) for part in np.array_split(x, -(-len(x) * len(coarse) // NUMBERS))])
    sizes = np.bincount(own, minlength=len(coarse))
    return np.concatenate([balanced_centroids(x[own == c], max(1, round(k * sizes[c] / len(x)))) for c in np.flatnonzero(sizes)])


@dataclass
class Index:
    top: float
    centroids: np.ndarray
    graph: np.ndarray
    counts: np.ndarray | None = None
    near: float = NEAR

    @staticmethod
    def of(sample: np.ndarray, top: float, n: int, k: int = 20) -> Index:
        x = np.concatenate([sample, np.sqrt(np.maximum(top**2 - (sample**2).sum(1), 0))[:, None]], axis=1)
        c = centroids_of(x, lists_for(n))
        near = np.concatenate([np.argsort(_square(part, c), axis=1, kind="stable")[:, 1 : DEGREE + 1] for part in np.array_split(c, -(-(len(c) ** 2) // NUMBERS))])
        # a ring through all keeps the graph connected
        ring = (np.arange(len(c)) + 1) % len(c)
        made = Index(top, c, np.concatenate([near, ring[:, None]], axis=1))
        made.near = made.reach(sample, int(np.clip(-(-k * len(sample) // n), 4, k)))
        return made

    def reach(self, sample: np.ndarray, k: int) -> float:
        """How many times farther than the nearest centroid a list may be that FOUND of the sample's k nearest lie in."""
        asked = np.linspace(0, len(sample) - 1, min(ASKED, len(sample))).astype(int)
        if len(sample) < 3:
            return NEAR
        q = sample[asked]
        close = q @ sample.T
        close[np.arange(len(q)), asked] = -np.inf
        k = min(k, len(sample) - 1)
        best = np.argpartition(-close, k - 1, axis=1)[:, :k]
        far = np.sqrt(_square(np.append(q * (self.top / np.sqrt((q**2).sum(1)))[:, None], np.zeros((len(q), 1)), axis=1), self.centroids))
        far /= np.maximum(far.min(1), 1e-12)[:, None]
        distinct, place = np.unique(best, return_inverse=True)
        lists = self.lists(sample[distinct])
        needed = [far[i, lists[place.reshape(best.shape)[i, j]]].min() for i in range(len(q)) for j in range(k)]
        return float(np.quantile(needed, FOUND))

    def lists(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists of each vector: the nearest, and the boundary ones."""
        x = np.concatenate([x, np.sqrt(np.maximum(self.top**2 - (x**2).sum(1), 0))[:, None]], axis=1)
        out = []
        for part in np.array_split(x, -(-len(x) * len(self.centroids) // NUMBERS)):
            d = np.sqrt(_square(part, self.centroids))
            m = min(2 * REPLICAS, d.shape[1])
            near = np.argpartition(d, m - 1, axis=1)[:, :m]
            near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
            for row, order in zip(d, near):
                own = [order[0]]
                for c in order[1:]:
                    if len(own) > REPLICAS or row[c] > CLOSE * row[own[0]]:
                        break
                    if all(((self.centroids[c] - self.centroids[o]) ** 2).sum() > (0.5 * row[c]) ** 2 for o in own):
                        own.append(c)
                out.append(np.array(own, np.int32))
        return out

    def search(self, q: np.ndarray, least: int) -> np.ndarray:
        """Lists to read for a query: best-first over the graph, those within `near` of the nearest, and more until they hold `least` vectors."""
        q = np.append(q * (self.top / np.sqrt((q**2).sum())), 0.0)  # as long as all others: its own length changes no order
        far = lambda ids: np.sqrt(((self.centroids[ids] - q) ** 2).sum(1))
        k = len(self.centroids)
        starts = np.unique(np.linspace(0, k - 1, min(k, 16)).astype(int))
        seen = np.zeros(k, bool)
        seen[starts] = True
        todo = [(d, int(c)) for d, c in zip(far(starts), starts)]
        best = heapq.nsmallest(BEAM, todo)
        met, least_far = list(todo), best[0][0]
        heapq.heapify(todo)
        worst = best[-1][0] if len(best) == BEAM else np.inf
        best = [(-d, c) for d, c in best]
        heapq.heapify(best)
        while todo:
            d, c = heapq.heappop(todo)
            if len(best) >= BEAM and d > max(worst, SLACK * self.near * least_far):
                break
            new = self.graph[c][~seen[self.graph[c]]]
            seen[new] = True
            for dn, n in zip(far(new), new):
                if len(best) < BEAM or dn <= max(worst, SLACK * self.near * least_far):
                    heapq.heappush(todo, (dn, int(n)))
                    met.append((dn, int(n)))
                    least_far = min(least_far, dn)
                    heapq.heappush(best, (-dn, int(n)))
                    if len(best) > BEAM:
                        heapq.heappop(best)
                    worst = -best[0][0]
        found = sorted(met)
        if self.counts is not None and self.counts[[c for _, c in found]].sum() < least:
            every = np.arange(k)
            found = sorted(zip(far(every), every))
        out, held = [], 0
        for d, c in found:
            if d > self.near * found[0][0] and held >= least:
                break
            out.append(c)
            held += self.counts[c] if self.counts is not None else 0
        return np.array(out, np.int32)


def lists_for(n: int) -> int:
    return int(np.clip(round(n**0.5), 1, LISTS))


def best_of(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query_id, vec_id, score of each query's k best of the vectors, but for its own vec_id."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    again = np.concatenate([[False], (ids[1:] == ids[:-1]) & (x[1:] == x[:-1]).all(1)])
    ids, x = ids[~again], x[~again]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    names, sizes = ids[first], np.diff(np.append(first, len(ids)))
    found = []
    for turn in np.array_split(np.arange(len(q)), -(-len(q) * len(ids) // NUMBERS)):
        near = np.maximum.reduceat(q[turn] @ x.T, first, axis=1)
        near[names[None] == query_ids[turn][:, None]] = -np.inf
        low = -np.partition(-near, k - 1, axis=1)[:, k - 1] if len(names) > k else np.full(len(turn), -np.inf)
        low = np.where(np.isfinite(low), low - 1e-9 * (1 + np.abs(low)), low)
        a, b = np.nonzero((near >= low[:, None]) & (near > -np.inf))
        # the same sum for equal vectors, wherever they lie; the best row of each vec_id
        rows = np.concatenate([[0], np.cumsum(sizes[b])])
        at = np.arange(rows[-1]) - np.repeat(rows[:-1] - first[b], sizes[b])
        each = (x[at] * q[turn][np.repeat(a, sizes[b])]).sum(1)
        exact = np.maximum.reduceat(each, rows[:-1]) if len(b) else each
        order = np.lexsort((names[b], -exact, a))
        a, b, exact = a[order], b[order], exact[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        some = place < k
        found.append((query_ids[turn][a[some]], names[b[some]], exact[some]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(F.coalesce(whole, F.lit(False)))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (size["n"] if size else 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of queries, from the other vec_ids of vectors."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    asked = usable(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    total = rows.agg(F.count("*").alias("n"), F.max(norm).alias("top")).first()
    if not total["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    wanted = max(SAMPLE, PER_LIST * lists_for(total["n"]))
    order = F.xxhash64("vec_id")
    # few rows are sorted: those of small hashes, unless there are too few of them
    small = rows.where(order < int(((2 * wanted / total["n"]) * 2 - 1) * (1 << 63)) if 4 * wanted < total["n"] else F.lit(True))
    sample = small.orderBy(order, "vec_id", "v").limit(wanted).select("v").toArrow()
    if sample.num_rows < min(wanted, total["n"]):
        sample = rows.orderBy(order, "vec_id", "v").limit(wanted).select("v").toArrow()
    index = Index.of(_matrix(sample.column("v").combine_chunks()), total["top"], total["n"], k)
    shared = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 2048):
            lists = [x.tolist() for x in shared.value.lists(_matrix(part.column(1)))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lists, pa.list_(pa.int32()))], names=["vec_id", "v", "lists"])

    placed = rows.mapInArrow(place, "vec_id long, v array<double>, lists array<int>")
    postings = stored(placed.select("vec_id", "v", F.explode("lists").alias("list")), "postings")
    counts = np.zeros(len(index.centroids), np.int64)
    for r in postings.groupBy("list").count().collect():  # LISTS rows at most
        counts[r["list"]] = r["count"]
    full = spark.sparkContext.broadcast(Index(index.top, index.centroids, index.graph, counts, index.near))
    least = max(READ, (REPLICAS + 1) * (k + 1))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 2048):
            lists = [full.value.search(q, least).tolist() for q in _matrix(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lists, pa.list_(pa.int32()))], names=["query_id", "q", "lists"])

    asked = stored(asked, "asked")
    asked = asked.repartition(-(-max(1, asked.count()) // SEARCHES), "vec_id")
    found = asked.mapInArrow(ask, "query_id long, q array<double>, lists array<int>").select("query_id", "q", F.explode("lists").alias("list"))
    found = stored(found, "queries")
    asks = np.zeros(len(counts), np.int64)
    for r in found.groupBy("list").count().collect():  # LISTS rows at most
        asks[r["list"]] = r["count"]
    blocks = spark.createDataFrame([(int(c), int(-(-counts[c] // VECTORS)), int(-(-asks[c] // QUERIES))) for c in np.flatnonzero(counts * asks)], "list int, parts int, turns int")
    blocks = F.broadcast(blocks)
    left = postings.join(blocks, "list").select("list", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "vec_id", "v")
    right = found.join(blocks, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("query_id"), "turns").cast("int").alias("turn"), "query_id", "q")

    def best(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        found = best_of(own["vec_id"].to_numpy(), np.stack(own["v"].to_numpy()), asked["query_id"].to_numpy(), np.stack(asked["q"].to_numpy()), k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))

    keys = ["list", "part", "turn"]
    each = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, "query_id long, vec_id long, score double")
    one = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return one.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
