"""Quality of whole texts by a factorisation machine over hashed words and statistics of structure.

A text's features are the buckets of its words (2**BUCKETS of them; each distinct bucket weighs 1 / sqrt(their number)) and, for each
statistic, the bin it falls into by edges that the training rows' quantiles give (weight 1). The score is the logistic
function of w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)**2 - sum (v_if x_i)**2), which takes time linear in the features.

It is trained on at most SAMPLE labelled rows outside the held-out fold, those of the smallest hash of doc_id; labels, lang, source and
doc_id are never features, and the only metadata left are lengths, taken from the text itself. Every row is scored. Null
texts are empty and have a score like any other; without any label all scores are 0.5. Several labels of one doc_id count as
their mean, rounded up. A null doc_id counts as held out. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import raw_text, sliced

BUCKETS, FACTORS, BINS = 15, 8, 12
#: Labelled rows that the machine is trained on, at most.
SAMPLE = 8_000
EPOCHS, RATE, DECAY, SEED = 8, 0.08, 1e-4, 7
FOLDS, THRESHOLD = 5, 0.3
_SIGNS = b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~"
_UPPER, _DIGITS, _LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HIGH = bytes(range(128, 256))


def statistics(raw: bytes, words: list[bytes]) -> list[float]:
    """Structure of a text: lengths, shares of kinds of characters, repetition of words and lines."""
    size, n = max(1, len(raw)), max(1, len(words))
    share = lambda kind: 1 - len(raw.translate(None, kind)) / size
    counts = Counter(words)
    top = counts.most_common(1)[0][1] if words else 0
    lines = [x.strip() for x in raw.split(b"\n")]
    lines = [x for x in lines if x]
    same = sum(a == b for a, b in zip(words, words[1:]))
    pairs = len(set(zip(words, words[1:]))) if len(words) > 1 else 1
    bare = sum(1 for w in counts if not w.translate(None, _DIGITS + _SIGNS + b".,"))
    return [
        float(np.log1p(len(raw))), float(np.log1p(len(words))), sum(map(len, words)) / n,
        share(_SIGNS), share(b".,"), share(_UPPER), share(_DIGITS), share(_LETTERS), share(_HIGH), share(b"|"), share(b"!"),
        len(counts) / n, top / n, same / n, pairs / max(1, n - 1), bare / max(1, len(counts)),
        len(set(lines)) / max(1, len(lines)), float(np.log1p(len(lines))), n / max(1, len(lines)),
    ]


def features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word buckets of a text and its statistics."""
    words = raw.split()
    low = raw.lower().split()
    buckets = np.unique(np.fromiter(map(zlib.crc32, low), np.uint32, len(low)) & np.uint32((1 << BUCKETS) - 1))
    return buckets.astype(np.int32), np.array(statistics(raw, words), np.float32)


@dataclass
class Machine:
    edges: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def ids(self, buckets: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers and weights."""
        bins = (stats[:, None] > self.edges).sum(1) + (1 << BUCKETS) + BINS * np.arange(len(stats))
        weights = np.concatenate([np.full(len(buckets), 1 / np.sqrt(max(1, len(buckets))), np.float32), np.ones(len(bins), np.float32)])
        return np.concatenate([buckets, bins]).astype(np.int64), weights

    def score(self, raw: bytes) -> float:
        ids, x = self.ids(*features(raw))
        vx = self.factors[ids] * x[:, None]
        z = self.bias + float(self.linear[ids] @ x) + 0.5 * float((vx.sum(0) ** 2 - (vx**2).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def train(buckets: list[np.ndarray], stats: np.ndarray, labels: np.ndarray) -> Machine:
    """Minibatch AdaGrad on the logistic loss; the order of rows is drawn from a fixed seed."""
    draw = np.random.default_rng(SEED)
    width = stats.shape[1] if len(stats) else len(statistics(b"", []))
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if len(stats) else np.zeros((width, BINS - 1))
    total = (1 << BUCKETS) + BINS * width
    m = Machine(edges.astype(np.float32), 0.0, np.zeros(total, np.float32), draw.normal(0, 0.02, (total, FACTORS)).astype(np.float32))
    if not len(labels):
        m.factors[:] = 0
        return m
    rate = np.clip(labels.mean(), 0.01, 0.99)
    m.bias = float(np.log(rate / (1 - rate)))
    rows = [m.ids(b, s) for b, s in zip(buckets, stats)]
    g1, g2, g0 = np.full(total, 1e-6, np.float32), np.full((total, FACTORS), 1e-6, np.float32), 1e-6
    for _ in range(EPOCHS):
        order = draw.permutation(len(rows))
        for at in range(0, len(order), 64):
            own = order[at : at + 64]
            ids = np.concatenate([rows[k][0] for k in own])
            x = np.concatenate([rows[k][1] for k in own])
            sizes = np.array([len(rows[k][0]) for k in own])
            first, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(own)), sizes)
            v = m.factors[ids]
            vx = v * x[:, None]
            total_vx = np.add.reduceat(vx, first, axis=0)
            z = m.bias + np.add.reduceat(m.linear[ids] * x, first) + 0.5 * (total_vx**2 - np.add.reduceat(vx**2, first, axis=0)).sum(1)
            wrong = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels[own]).astype(np.float32) / len(own)
            d = (wrong[owner] * x)[:, None]
            seen, where = np.unique(ids, return_inverse=True)
            d1 = np.bincount(where, d[:, 0], len(seen)).astype(np.float32) + DECAY * m.linear[seen]
            each = d * (total_vx[owner] - vx)
            d2 = np.stack([np.bincount(where, each[:, f], len(seen)) for f in range(FACTORS)], axis=1).astype(np.float32) + DECAY * m.factors[seen]
            g1[seen] += d1**2
            g2[seen] += d2**2
            g0 += float(wrong.sum()) ** 2
            m.linear[seen] -= RATE * d1 / np.sqrt(g1[seen])
            m.factors[seen] -= RATE * 0.3 * d2 / np.sqrt(g2[seen])
            m.bias -= RATE * float(wrong.sum()) / g0**0.5
    return m


def held_out(name: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text") -> Machine:
    """The machine of the labelled rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).dropna()
    known = known.where(~held_out()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    # a document missing from docs has no text to learn from; of several rows of a doc_id, that of the smallest hash of its text
    there = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    chosen = known.join(there, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text(text)).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min_by("raw", F.struct(F.xxhash64("raw"), "raw")).alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            found = [features(x) for x in part.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))], names=["doc_id", "label", "buckets", "stats"])

    made = rows.select("doc_id", "label", "raw").mapInArrow(run, "doc_id long, label int, buckets array<int>, stats array<float>")
    got = made.toArrow().sort_by([("doc_id", "ascending")])  # `sample` rows at most
    buckets = [np.array(x, np.int32) for x in got.column("buckets").to_pylist()]
    stats = np.array(got.column("stats").to_pylist(), np.float32).reshape(len(buckets), len(statistics(b"", [])))
    return train(buckets, stats, np.array(got.column("label").to_pylist(), np.float32))


def scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            found = pa.array([shared.value.score(x) for x in part.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([part.column(0), found], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text(text)).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text") -> DataFrame:
    """docs whose predicted quality is 1, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample, text))
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            texts = [(x or "").encode() for x in part.column(place).to_pylist()]
            yield part.filter(pa.array([shared.value.score(x) >= THRESHOLD for x in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
