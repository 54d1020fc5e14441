"""Nearest vectors to stated queries: every query against every row, by matrix products.

Queries go to the rows in blocks of BLOCK; each batch of rows gives a block's best, and these meet by query. So what is sent and held is
bounded, whatever the numbers of queries and rows, and nothing but the best of each batch is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that are sent to every task at a time, and numbers of a matrix at a time.
BLOCK, NUMBERS = 4096, 1 << 22


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def rounded(c: str, places: int) -> Column:
    """A double to some places as SQL engines round it: by its product with a power of ten. F.round goes by the decimal that it is spelt as,
    which at a half may be on the other side."""
    return F.round(F.col(c) * float(10**places), 0) / float(10**places)


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    size = np.sqrt((q**2).sum(1))[:, None] * np.sqrt((x**2).sum(1))[None]
    return np.divide(q @ x.T, size, out=np.full(size.shape, np.nan), where=size > 0)


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances; the products' rounding is made good where vectors are nearly equal."""
    d = (q**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * q @ x.T
    near = np.argwhere(d < 1e-6 * ((q**2).sum(1)[:, None] + 1))
    d[near[:, 0], near[:, 1]] = ((q[near[:, 0]] - x[near[:, 1]]) ** 2).sum(1)
    return np.sqrt(np.maximum(d, 0))


#: What a search sees of queries and rows: ids, labels and vectors.
Side = tuple[np.ndarray, np.ndarray, np.ndarray]


def _side(ids: pa.Array, labels: pa.Array, embeddings: pa.Array) -> Side:
    v = embeddings.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return ids.to_numpy(zero_copy_only=False), labels.to_numpy(zero_copy_only=False), v.reshape(len(ids), -1)


def _sides(rows: DataFrame) -> DataFrame:
    """id, label, v of the rows whose vectors have no null."""
    return rows.select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null)")


def searched(queries: DataFrame, rows: DataFrame, best: Callable[[Side, Side], list[pa.Array]], schema: str) -> DataFrame:
    """What `best` gives of each block of queries and batch of rows (both vec_id, label, embedding); a batch is in order of vec_id."""
    spark = rows.sparkSession
    asked, there = _sides(queries), _sides(rows)
    blocks = -(-asked.count() // BLOCK)
    names = [c.split()[0] for c in schema.split(", ")]
    if not blocks:
        return spark.createDataFrame([], schema)

    def one(block: int) -> DataFrame:
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block) if blocks > 1 else asked
        got = own.orderBy("vec_id").toArrow().combine_chunks()  # about BLOCK rows
        shared = spark.sparkContext.broadcast(tuple(np.ascontiguousarray(x) for x in _side(*(got.column(c).combine_chunks() for c in range(3)))) if got.num_rows else None)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if shared.value is None:
                return
            q = shared.value
            for batch in batches:
                batch = batch.take(pa.compute.sort_indices(batch.column(0)))
                wide = pa.compute.list_value_length(batch.column(2)).to_numpy() == q[2].shape[1]
                batch = batch.filter(pa.array(wide))
                for at in range(0, batch.num_rows, max(1, NUMBERS // len(q[0]))):
                    part = batch.slice(at, max(1, NUMBERS // len(q[0])))
                    yield pa.RecordBatch.from_arrays(best(q, _side(*(part.column(c) for c in range(3)))), names=names)

        return there.mapInArrow(run, schema)

    return reduce(DataFrame.unionAll, map(one, range(blocks)))


def firsts(key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k smallest of each row of a matrix, ties to the left; NaN is nowhere."""
    key = np.where(np.isnan(key), np.inf, key)
    if key.shape[1] > k:
        bar = np.partition(key, k - 1, axis=1)[:, k - 1 : k]
        a, b = np.nonzero((key <= bar) & np.isfinite(key))
    else:
        a, b = np.nonzero(np.isfinite(key))
    order = np.lexsort((b, key[a, b], a))
    a, b = a[order], b[order]
    some = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[some], b[some]


def top(found: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    """The first k of each query; ranks are total orders."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def nearest_cosine(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score, rank: the k of largest cosine (to six places; ties to the smaller vec_id) but for the query itself."""

    def best(q: Side, x: Side) -> list[pa.Array]:
        s = cosines(q[2], x[2])
        a, b = firsts(np.where(q[0][:, None] == x[0][None], np.nan, -np.round(s, 6)), k)
        return [pa.array(q[0][a]), pa.array(x[0][b]), pa.array(s[a, b])]

    return top(searched(queries, rows, best, "query_id long, vec_id long, score double"), "query_id", k, F.desc(F.round("score", 6)), F.col("vec_id"))


def nearest_combined(queries: DataFrame, rows: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """The k rows of other labels by `weight` of the cosine and the rest of the nearness of ids."""

    def best(q: Side, x: Side) -> list[pa.Array]:
        s = weight * cosines(q[2], x[2]) + (1 - weight) * (1.0 / (1 + np.abs(x[0][None] - q[0][:, None])))
        a, b = firsts(np.where(q[1][:, None] == x[1][None], np.nan, -np.round(s, 6)), k)
        return [pa.array(q[0][a]), pa.array(x[0][b]), pa.array(s[a, b])]

    return top(searched(queries, rows, best, "query_id long, vec_id long, score double"), "query_id", k, F.desc(F.round("score", 6)), F.col("vec_id"))


def nearest_preferred(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The k nearest by Euclidean distance, rows of the query's label before all others."""

    def best(q: Side, x: Side) -> list[pa.Array]:
        d, same = distances(q[2], x[2]), q[1][:, None] == x[1][None]
        far = np.round(d, 6) + np.where(same, 0.0, 4 * np.max(d, initial=0) + 1)
        a, b = firsts(np.where(q[0][:, None] == x[0][None], np.nan, far), k)
        return [pa.array(q[0][a]), pa.array(x[0][b]), pa.array(same[a, b]), pa.array(d[a, b])]

    found = searched(queries, rows, best, "query_id long, vec_id long, qualified boolean, distance double")
    return top(found, "query_id", k, F.desc("qualified"), F.round("distance", 6), F.col("vec_id"))


def least_by(queries: DataFrame, rows: DataFrame, group: Callable[[Side], np.ndarray], by_query: bool) -> DataFrame:
    """The least cosine distance of each query (or of each label of rows, if not by_query) to the rows of each group: key, value, distance."""

    def best(q: Side, x: Side) -> list[pa.Array]:
        d = 1 - cosines(q[2], x[2])
        d[(q[0][:, None] == x[0][None]) | np.isnan(d)] = np.inf
        if by_query:
            values, own = np.unique(group(x), return_inverse=True)
            order = np.argsort(own, kind="stable")
            least = np.minimum.reduceat(d[:, order], np.searchsorted(own[order], np.arange(len(values))), axis=1) if len(values) else d
            a, b = np.nonzero(np.isfinite(least))
            return [pa.array(q[0][a].astype(np.int64)), pa.array(values[b].astype(np.int64)), pa.array(least[a, b])]
        least, keys = d.min(axis=0, initial=np.inf), np.stack([x[1].astype(np.int64), group(x).astype(np.int64)], axis=1)
        some = np.isfinite(least)
        return [pa.array(keys[some, 0]), pa.array(keys[some, 1]), pa.array(least[some])]

    return searched(queries, rows, best, "key long, value long, distance double").groupBy("key", "value").agg(F.min("distance").alias("distance"))


def merged(found: DataFrame, lookup: list[str], value: str, distance: str, k: int) -> DataFrame:
    """The k nearest distinct values of each lookup, merged over its queries: a value counts once, at its least distance."""
    best = found.groupBy(*lookup, value).agg(F.min(distance).alias(distance))
    w = Window.partitionBy(*lookup).orderBy(distance, value)
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
