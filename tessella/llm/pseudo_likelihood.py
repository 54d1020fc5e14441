"""Masked pseudo-likelihood: a network predicts every word of a text from the REACH words on either side.

Of N words in the corpus, those that occur sqrt(N) / OWN times or more have ids of their own (2 * sqrt(N) at most, whatever the
corpus), all others share buckets. The network adds an embedding for each place of the window, takes tanh, and predicts first
the id's class, then the id within it. A word in a bucket has the bucket's probability times its share of the bucket: by its
own count if it occurs sqrt(N) / COUNTED times, else the mean share of the rarer words of that bucket, the chance of an unseen
one included. So the probabilities of all words sum to 1, and vocabulary, counts and network grow with the corpus.
A text's score is the sum of the log-probabilities of all its words; the mean is per word.

It is trained in numpy on every text, in ROUNDS rounds. Rows are dealt into shards by a hash of doc_id and text, as many as the
number of words and the size of the network ask for; in a shard they are in the order of that hash. Each shard of a round learns from the same
weights, and the weights are averaged by the shards' words, as sums of integers, in a tree of fixed fan-in. So the scores
don't depend on how the table is laid out, on tasks or on their order.

Null and empty texts have no words, score 0.0 and a null mean. Repeated rows are scored row by row and counted as often, but learnt
from once. An empty table leaves the weights as they begin. Other columns are ignored. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_text, sliced, stored

#: Divisors of sqrt(N): from how many occurrences a word has an id of its own, and a count of its own.
OWN, COUNTED = 2, 32
#: Words with ids for each bucket.
PER_BUCKET = 4
REACH, WIDTH = 2, 16
BATCH, RATE, SEED = 8192, 0.25, 11
#: Rounds, words of a shard at least, and words for each number of the network at least.
ROUNDS, SHARD, PER_WEIGHT = 2, 1 << 20, 8
#: Numbers in a row of weights, and rows that are added at a time.
CHUNK, FAN = 4096, 64
PLACES = [o for o in range(-REACH, REACH + 1) if o]
#: Distinct words, and bytes of text, after which a task hands on its counts.
HELD, SEEN = 200_000, 1 << 26


@dataclass
class Vocabulary:
    """ids by hash of word: 0 ... for own words, from len(own) on for buckets."""

    own: np.ndarray  # sorted hashes of words with ids
    ids: np.ndarray  # theirs
    counted: np.ndarray  # sorted hashes of the other words with counts
    logs: np.ndarray  # their log share of a bucket
    rest: np.ndarray  # the log share of any other word, by bucket

    @property
    def size(self) -> int:
        return len(self.own) + len(self.rest)

    def encode(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and the log share of the id that each has: 0 for ids of their own."""
        ids, logs = np.zeros(len(hashes), np.int32), np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.own, hashes), max(0, len(self.own) - 1))
        known = self.own[at] == hashes if len(self.own) else np.zeros(len(hashes), bool)
        ids[known] = self.ids[at[known]]
        other = hashes[~known]
        bucket = (other % np.uint64(len(self.rest))).astype(np.int64)
        share = self.rest[bucket]
        if len(self.counted):
            at = np.minimum(np.searchsorted(self.counted, other), len(self.counted) - 1)
            share = np.where(self.counted[at] == other, self.logs[at], share)
        ids[~known], logs[~known] = len(self.own) + bucket, share
        return ids, logs


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))


def vocabulary(rows: DataFrame) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary of all rows (raw), and every id's count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        seen = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(hashes_of(list(counts)).view(np.int64)), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for part in sliced(batches):
            for raw in part.column(0).to_pylist():
                counts.update(raw.lower().split())
                seen += len(raw)
                if len(counts) > HELD or seen > SEEN:
                    yield out()
                    counts.clear()
                    seen = 0
        yield out()

    counted = stored(rows.select("raw").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    root = float(counted.agg(F.sum("n")).first()[0] or 0) ** 0.5
    # at most COUNTED * sqrt(N) rows: no more words can occur so often
    top = counted.where(F.col("n") >= root / COUNTED).toArrow()
    words, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.lexsort((words, -n))
    words, n = words[order], n[order]
    k = int((n >= root / OWN).sum())
    buckets = max(16, k // PER_BUCKET)
    # a hash as an unsigned number, by its high and low halves
    half = lambda x: F.pmod(x, F.lit(buckets))
    high, low = F.shiftrightunsigned("word", 32), F.col("word").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    place = half(half(high) * F.lit((1 << 32) % buckets) + half(low))
    few = F.col("n") < root / COUNTED
    total, rest, kinds = np.zeros(buckets), np.zeros(buckets), np.zeros(buckets)
    found = counted.where(F.col("n") < root / OWN).groupBy(place.cast("int").alias("b")).agg(F.sum("n").alias("total"), F.sum(F.when(few, F.col("n")).otherwise(0)).alias("rest"), F.count_if(few).alias("kinds"))
    for r in found.collect():  # a row a bucket
        total[r["b"]], rest[r["b"]], kinds[r["b"]] = r["total"], r["rest"], r["kinds"]
    # an unseen word is one more kind that occurs once
    own_of = words[k:] % np.uint64(buckets)
    logs = np.log(n[k:] / (total + 1)[own_of.astype(np.int64)])
    by, more = np.argsort(words[:k]), np.argsort(words[k:])
    made = Vocabulary(words[:k][by], by.astype(np.int32), words[k:][more], logs[more], np.log((rest + 1) / (kinds + 1) / (total + 1)))
    return made, np.concatenate([n[:k], total + 1]).astype(float)


@dataclass
class Network:
    """Weights of the window, and of classes and members of classes; id = class * side + member."""

    inner: np.ndarray  # place, id (size: outside the text), WIDTH
    top: np.ndarray  # WIDTH + 1, side
    member: np.ndarray  # class, WIDTH + 1, side

    @property
    def side(self) -> int:
        return self.top.shape[1]

    @property
    def size(self) -> int:
        return self.inner.shape[1] - 1

    @staticmethod
    def start(counts: np.ndarray) -> Network:
        """The counts' own distribution; places of the last class that no id has are as good as impossible."""
        draw, size = np.random.default_rng(SEED), len(counts)
        side = int(np.ceil(size**0.5))
        p = np.full(side * side, -50.0)
        p[:size] = np.log((counts + 1.0) / (counts + 1.0).sum())
        p = p.reshape(side, side)
        top, member = draw.normal(0, 0.1, (WIDTH + 1, side)), draw.normal(0, 0.1, (side, WIDTH + 1, side))
        top[-1] = np.logaddexp.reduce(p, axis=1)
        member[:, -1] = p - top[-1][:, None]
        inner = draw.normal(0, 0.1, (len(PLACES), size + 1, WIDTH))
        return Network(*(x.astype(np.float32) for x in (inner, top, member)))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.inner.ravel(), self.top.ravel(), self.member.ravel()])

    @staticmethod
    def of(flat: np.ndarray, size: int) -> Network:
        side = int(np.ceil(size**0.5))
        a, b = len(PLACES) * (size + 1) * WIDTH, (WIDTH + 1) * side
        parts = flat[:a].reshape(len(PLACES), size + 1, WIDTH), flat[a : a + b].reshape(WIDTH + 1, side), flat[a + b :].reshape(side, WIDTH + 1, side)
        return Network(*(x.astype(np.float32) for x in parts))

    def hidden(self, near: np.ndarray) -> np.ndarray:
        h = np.empty((len(near), WIDTH + 1), np.float32)
        h[:, :-1] = np.tanh(sum(self.inner[o][near[:, o]] for o in range(len(PLACES))))
        h[:, -1] = 1
        return h

    def logs(self, near: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Log-probability of each id, given its neighbours."""
        h = self.hidden(near)
        own, member = ids // self.side, ids % self.side
        out = _logs(h @ self.top, own)
        order = np.argsort(own, kind="stable")
        ends = np.searchsorted(own[order], np.arange(self.side + 1))
        for c in range(self.side):
            at = order[ends[c] : ends[c + 1]]
            if len(at):
                out[at] += _logs(h[at] @ self.member[c], member[at])
        return out

    def learn(self, near: np.ndarray, ids: np.ndarray, rate: float) -> None:
        """One step on the mean loss of a batch; an embedding moves by its own share's mean."""
        order = np.argsort(ids, kind="stable")  # a class is then a slice
        near, ids = near[order], ids[order]
        h = self.hidden(near)
        own, member = ids // self.side, ids % self.side
        d = _wrong(h @ self.top, own)
        back = d @ self.top.T
        ends = np.searchsorted(own, np.arange(self.side + 1))
        for c in range(self.side):
            at = slice(ends[c], ends[c + 1])
            n = int(ends[c + 1] - ends[c])
            if n:
                dc = _wrong(h[at] @ self.member[c], member[at])
                back[at] += dc @ self.member[c].T
                self.member[c] -= rate * (h[at].T @ dc) / float(n * len(ids) / self.side) ** 0.5
        self.top -= rate * (h.T @ d) / len(ids)
        step = back[:, :-1] * (1 - h[:, :-1] ** 2)
        for o in range(len(PLACES)):
            order = np.argsort(near[:, o], kind="stable")
            seen, first = np.unique(near[order, o], return_index=True)
            sums = np.add.reduceat(step[order], first, axis=0)
            sizes = np.diff(np.append(first, len(order)))
            self.inner[o][seen] -= rate * sums / (sizes[:, None] + 8).astype(np.float32)


def _logs(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-softmax at a column of each row; weights stay far from where the clip or float32 would matter."""
    np.clip(z, -60, 60, out=z)
    return z[np.arange(len(z)), at] - np.log(np.exp(z) @ np.ones(z.shape[1], np.float32))


def _wrong(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    np.clip(z, -60, 60, out=z)
    p = np.exp(z, out=z)
    p /= (p @ np.ones(z.shape[1], np.float32))[:, None]
    p[np.arange(len(z)), at] -= 1
    return p


def windows(each: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours and id of every word of the texts, from their ids."""
    # small numbers: numpy sorts them by radix
    kind = np.uint16 if size < 1 << 16 else np.int32
    gap = np.full(REACH, size, kind)
    line = np.concatenate([gap, *(y for x in each for y in (x.astype(kind), gap))])
    inside = np.flatnonzero(line != size)
    return np.stack([line[inside + o] for o in PLACES], axis=1) if len(inside) else np.zeros((0, len(PLACES)), kind), line[inside]


def encoded(rows: DataFrame, words: Vocabulary) -> DataFrame:
    """doc_id, key (of doc_id and text), n_words, share (the sum of log shares), ids (32-bit) of every row (doc_id, raw)."""
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            sizes, shares, ids = [], [], []
            for raw in part.column(2).to_pylist():
                found, logs = shared.value.encode(hashes_of(raw.lower().split()))
                sizes.append(len(found))
                shares.append(float(logs.sum()))
                ids.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(shares, pa.float64()), pa.array(ids, pa.binary())], names=["doc_id", "key", "n_words", "share", "ids"])

    keyed = rows.select("doc_id", F.xxhash64("doc_id", "raw").alias("key"), "raw")
    return stored(keyed.mapInArrow(run, "doc_id long, key long, n_words long, share double, ids binary"), "ids")


def train(rows: DataFrame, start: Network, rate: float = RATE) -> Network:
    """The network of all rows that encoded() gives."""
    spark, size = rows.sparkSession, start.size
    known = rows.where("n_words > 0").select("key", "n_words", "ids")
    if not known.groupBy("key").count().where("count > 1").isEmpty():
        known = known.dropDuplicates(["key"])
    total = int(known.agg(F.sum("n_words")).first()[0] or 0)
    flat = start.flat().astype(np.float64)
    shards = max(1, total // max(SHARD, PER_WEIGHT * len(flat)) // ROUNDS) * ROUNDS
    #: sums of integers are the same in any order; a weight stays below 2**6
    scale = 2.0 ** np.floor(62 - 6 - np.log2(total + 1))
    kind = pa.schema([("chunk", pa.int32()), ("at", pa.int64()), ("n", pa.int64()), ("w", pa.list_(pa.int64()))])
    shape = "chunk int, at long, n long, w array<long>"
    dealt = known.withColumn("shard", F.pmod("key", F.lit(shards)))

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        return pd.DataFrame({"chunk": [first["chunk"]], "at": [rows["at"].min() // FAN], "n": [rows["n"].sum()], "w": [np.sum(np.stack(rows["w"].to_numpy()), axis=0)]})

    for turn in range(ROUNDS):
        own = dealt.where(F.col("shard") % ROUNDS == turn).withColumn("shard", (F.col("shard") / ROUNDS).cast("int"))
        shared = spark.sparkContext.broadcast(flat.astype(np.float32))
        before = turn * total / shards

        def learnt(batches: Iterator[pa.RecordBatch], shared=shared, before=before) -> Iterator[pa.RecordBatch]:
            shard, seen, waiting = None, 0, 0
            held: list[np.ndarray] = []

            def step() -> None:
                """Learn from the texts held, which are whole: the last batch may be short."""
                nonlocal held, waiting, seen
                near, at = windows(held, size)
                for k in range(0, len(at), BATCH):
                    net.learn(near[k : k + BATCH], at[k : k + BATCH], rate / (1 + (before + seen) / 4e6) ** 0.5)
                    seen += len(at[k : k + BATCH])
                held, waiting = [], 0

            def handed_on() -> Iterator[pa.RecordBatch]:
                if held:
                    step()
                whole = np.rint(net.flat().astype(np.float64) * seen * scale).astype(np.int64)
                for k in range(0, len(whole), CHUNK):
                    yield pa.RecordBatch.from_pydict({"chunk": [k // CHUNK], "at": [shard], "n": [seen], "w": [whole[k : k + CHUNK]]}, schema=kind)

            for part in batches:
                for number, ids in zip(part.column(0).to_pylist(), part.column(1)):
                    if number != shard:
                        if shard is not None:
                            yield from handed_on()
                        net, shard, seen = Network.of(shared.value, size), number, 0
                    held.append(np.frombuffer(ids.as_py(), np.int32))
                    waiting += len(held[-1])
                    if waiting >= BATCH:
                        step()
            if shard is not None:
                yield from handed_on()

        count = shards // ROUNDS
        # a shard is a task; its rows have an order of their own
        made = own.repartitionById(count, "shard").sortWithinPartitions("shard", "key").select("shard", "ids").mapInArrow(learnt, shape)
        while True:
            made = made.groupBy("chunk", F.floor(F.col("at") / FAN).alias("team")).applyInPandas(added, shape)
            count = -(-count // FAN)
            if count == 1:
                break
        found = made.orderBy("chunk").collect()  # the network itself
        if found:
            flat = np.concatenate([np.array(r["w"]) / r["n"] for r in found]) / scale
    return Network.of(flat, size)


def scores(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, log_prob, mean_log_prob of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text(text))
    words, counts = vocabulary(rows)
    made = encoded(rows, words)
    net = train(made, Network.start(counts))
    shared = rows.sparkSession.sparkContext.broadcast((net.flat(), net.size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Network.of(*shared.value)
        for part in sliced(batches):
            sizes, shares = part.column(1).to_numpy(), part.column(2).to_numpy()
            near, at = windows([np.frombuffer(x, np.int32) for x in part.column(3).to_pylist()], model.size)
            logs = np.concatenate([[0.0], *(model.logs(near[k : k + (1 << 15)], at[k : k + (1 << 15)]).astype(np.float64) for k in range(0, len(at), 1 << 15))])
            ends = np.cumsum(sizes)
            sums = np.cumsum(logs)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sums[ends] - sums[ends - sizes] + shares)], names=["doc_id", "n_words", "log_prob"])

    found = made.select("doc_id", "n_words", "share", "ids").mapInArrow(run, "doc_id long, n_words long, log_prob double")
    return found.withColumn("mean_log_prob", F.try_divide("log_prob", "n_words"))
