"""A query reads all lists within NEAR, however many there are."""

from __future__ import annotations

import numpy as np

from tessella.llm import neighbours


def test_no_fixed_number_of_lists():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    c = np.append(x, np.zeros((len(x), 1)), axis=1)
    near = np.argsort(neighbours._square(c, c), axis=1)[:, 1 : neighbours.DEGREE + 1]
    graph = np.concatenate([near, (np.arange(len(c))[:, None] + 1) % len(c)], axis=1)
    index = neighbours.Index(1.0, c, graph, np.full(len(c), 2000))
    wanted = got = most = 0
    for q in draw.normal(size=(40, 64)):
        q /= np.linalg.norm(q)
        d = np.sqrt(((x - q) ** 2).sum(1))
        own = set(np.flatnonzero(d <= neighbours.NEAR * d.min()).tolist())
        wanted, got, most = wanted + len(own), got + len(own & set(index.search(q, 2048).tolist())), max(most, len(own))
    assert most > neighbours.BEAM and got >= 0.99 * wanted, (most, got, wanted)


def test_best_of_a_block():
    """The k best vec_ids by their best rows; ties to the smaller; a query's own vec_id left out; repeated rows."""
    draw = np.random.default_rng(2)
    ids = draw.integers(0, 60, 300)
    x = draw.integers(-2, 3, (300, 4)).astype(float)
    asked = np.array([3, 59, 1000])
    q = draw.integers(-2, 3, (3, 4)).astype(float)
    for k in (1, 7, 59, 100):
        got = list(zip(*(c.tolist() for c in neighbours.best_of(ids, x, asked, q, k))))
        want = []
        for a, v in zip(asked, q):
            best = {int(i): max(float((y * v).sum()) for j, y in zip(ids, x) if j == i) for i in set(ids.tolist()) if i != a}
            want += [(int(a), i, s) for s, i in sorted((-s, i) for i, s in best.items())[:k] for s in [-s]]
        assert got == want


def test_two_levels():
    x = np.random.default_rng(3).normal(size=(9000, 8))
    c = neighbours.centroids_of(x, 1000)
    assert 900 <= len(c) <= 1100
    near = neighbours._square(x, c).min(1).mean()
    assert near < 0.9 * neighbours._square(x, x[:1000]).min(1)[1000:].mean()


def test_odd_columns(spark):
    """Columns of clashing names don't matter, a vec_id that repeats counts once, and an empty table has no rows."""
    rows = [(i, [float(i % 7), 1.0], 0.5, "a", 3, [9.0]) for i in range(60)] + [(5, [100.0, 1.0], 0.1, "b", 2, [8.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double, list string, part int, v array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in neighbours.nearest(df, df.where("vec_id % 20 = 0"), 3).collect()}
    assert len(got) == 9 and got[20, 1] == (5, 601.0) and got[40, 1] == (5, 501.0) and got[20, 2] == (6, 37.0) and got[20, 3] == (13, 37.0)
    assert neighbours.nearest(df.limit(0), df.limit(0), 3).count() == 0 and neighbours.nearest(df, df.limit(0), 3).count() == 0
