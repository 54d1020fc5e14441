"""The pipeline's near-duplicate stage against the Jaccard similarity of all pairs."""

from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from tessella.llm import near_copies


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    """The row of the smallest doc_id, nulls last, of each component of rows with a 5-word Jaccard similarity of 0.8 or more."""
    each = [grams(t) for _, t in rows]
    own = list(range(len(rows)))
    for i, x in enumerate(each):
        for j in range(i):
            if own[i] != own[j] and 5 * len(x & each[j]) >= 4 * len(x | each[j]):
                own = [own[j] if o == own[i] else o for o in own]
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    return [min((order(i) for i in range(len(rows)) if own[i] == o)) for o in set(own)]


def kept(docs):
    return [(r.doc_id is None, r.doc_id or 0) for r in corpus_pipeline.near_dedup(docs.sparkSession, docs, "").collect()]


def test_all_near_copies_go(spark, documents, rows):
    draw = random.Random(5)
    more = []
    for k in range(40):
        words = [str(draw.randrange(10**6)) for _ in range(draw.randrange(30, 300))]
        more.append((10**6 + 10 * k, " ".join(words)))
        for c in range(1, 4):  # copies on either side of the similarity
            other = list(words)
            for _ in range(c * len(words) // 60):
                other[draw.randrange(len(words))] = "changed"
            more.append((10**6 + 10 * k + c, " ".join(other)))
    docs = spark.createDataFrame(more, "doc_id long, text string")
    every = documents.select("doc_id", "text").union(docs)
    assert sorted(kept(every)) == sorted(brute_kept(rows + more))


def test_rounds_agree(spark):
    """A run of copies in which each is near the next only: the smallest set that all meet links few."""
    words = [str(k) for k in range(100)]
    texts = [(k, " ".join(words[:60] + [f"x{j}" if j < 2 * k else words[j] for j in range(60, 100)][::-1])) for k in range(20)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(kept(docs)) == sorted(brute_kept(texts))


def test_a_group_of_near_copies_costs_a_few_pairs_a_set(spark, monkeypatch):
    """Two groups of similar sets meet at one run, whose smallest and largest set are similar to none and whose fingerprints are far apart."""
    draw, made, compared = np.random.default_rng(11), [], []
    one, two = draw.permutation(1000)[:400].reshape(2, 200) * 1_000_003
    own = iter(range(3_000_000_000, 4_000_000_000, 7919))
    kinds = [(one, 190, 200)] * 120 + [(two, 190, 200)] * 40 + [(one, 150, 190), (two, 150, 210)]
    for node, (whole, of, n) in enumerate(kinds):
        x = np.sort(np.array([*draw.choice(whole, of, replace=False), *(next(own) for _ in range(n - of))], np.uint32))
        made.append((node, n, x.tobytes(), np.array([7], np.int64).tobytes(), near_copies.parities(x).tolist(), int(draw.integers(-(2**63), 2**63 - 1))))
    rows = spark.createDataFrame(made, "node long, n long, runs binary, first binary, bits array<long>, fp long").cache()
    whole = near_copies._alike
    monkeypatch.setattr(near_copies, "_alike", lambda pairs, rows: compared.append(pairs.count()) or whole(pairs, rows))
    got = {frozenset((r.a, r.b)) for r in near_copies.links(rows).collect()}
    each = [set(np.frombuffer(r[2], np.uint32).tolist()) for r in made]
    want = list(range(len(made)))
    for i, x in enumerate(each):
        for j in range(i):
            if 5 * len(x & each[j]) >= 4 * len(x | each[j]):
                want = [want[j] if o == want[i] else o for o in want]
            else:
                assert frozenset((i, j)) not in got
    linked = list(range(len(made)))
    for i, j in map(tuple, got):
        linked = [linked[j] if o == linked[i] else o for o in linked]
    parts = lambda roots: {frozenset(i for i, o in enumerate(roots) if o == root) for root in roots}
    assert parts(linked) == parts(want)
    assert sum(compared) < 10 * len(made)


def test_order_is_no_matter():
    assert len(near_copies.runs(b"A b  c\td e F g")) == 3 and len(near_copies.runs(b"a B")) == 1 and not len(near_copies.runs(b" \n"))


def test_fingerprints_come_first(spark, monkeypatch):
    """Texts that differ by a word of many are linked by their fingerprints, before any runs are met."""
    words = [str(k * k) for k in range(4000)]
    texts = [(k, " ".join([*words[:500], f"x{k}", *words[500:]])) for k in range(6)] + [(9, "of another kind")]
    rows = near_copies.sets(spark.createDataFrame(texts, "doc_id long, text string")).cache()
    node = {r.doc_id: r.node for r in rows.collect()}
    linked = near_copies.simhash.components(near_copies._alike(near_copies.near_fingerprints(rows), rows)).collect()
    assert {r.node for r in linked} == {node[k] for k in range(6)} and len({r.root for r in linked}) == 1
    want = near_copies.simhash.fingerprint(texts[0][1].encode(), near_copies.SHINGLE)
    assert rows.where("doc_id = 0").first().fp % 2**64 == want


def test_meeting_rows_are_those_of_pairs_that_may_be_similar():
    draw = np.random.default_rng(3)
    for sets, keys in ((40, 30), (300, 4)):  # keys that few have and that more than FEW have
        rows = [(k, s) for s in range(sets) for k in draw.choice(keys, 3)]
        key, node = (np.array(x) for x in zip(*rows))
        n = draw.integers(1, 60, sets)[node]
        place = draw.integers(0, n // 5 + 1)
        got = set(zip(*(x.tolist() for x in near_copies._meeting(key, node, n, place)[:2])))
        may = lambda i, j: key[i] == key[j] and node[i] != node[j] and min(n[i] - place[i], n[j] - place[j]) * 9 >= (n[i] + n[j]) * 4
        first = {(int(key[i]), int(node[i])): i for i in reversed(range(len(rows)))}
        want = {r for r, i in first.items() if any(may(i, j) for j in first.values())}
        assert want == got if sets == 40 else want <= got


def test_runs_that_sets_share_come_last(spark):
    """Among two million runs passages that four texts share are told from runs that one has, so that no texts meet by them."""
    draw = np.random.default_rng(7)
    texts = []
    for k in range(400):
        if k % 4 == 0:
            passage = " ".join(map(str, draw.integers(0, 2**40, 204)))
        own = list(map(str, draw.integers(0, 2**40, 5000)))
        texts.append((k, " ".join([*own[:2500], passage, *own[2500:]])))
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).cache()
    assert near_copies.prefixes(near_copies.sets(docs)).count() == 0
    docs.unpersist()


def test_frequent_runs_are_those_of_many_sets(spark, monkeypatch):
    texts = [(k, f"a b c d e {k}") for k in range(9)] + [(9 + k, "v w x y z") for k in range(50)]  # equal sets count once
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    run, level = near_copies._frequent(docs, "text")
    shared, other = near_copies.runs(b"a b c d e"), near_copies.runs(b"v w x y z")
    assert run.tolist() == shared.tolist() and level.tolist() == [3]
    assert near_copies._level(np.sort(np.concatenate([shared, other])), (run, level)).sum() == 3
    monkeypatch.setattr(near_copies, "LISTED", 0)
    assert not len(near_copies._frequent(docs, "text")[0]) and not near_copies._level(shared, near_copies._frequent(docs, "text")).any()


def test_rows_of_runs_are_kept_without_parities(spark, monkeypatch):
    """Between turns a set's parities aren't written with each of its runs."""
    draw, kept_with, whole = np.random.default_rng(2), {}, near_copies.stored
    made = []
    for node in range(100):
        x = np.sort(draw.choice(2**32 - 1, 100, replace=False).astype(np.uint32))
        made.append((node, 100, x.tobytes(), np.array([7], np.int64).tobytes(), near_copies.parities(x).tolist(), int(draw.integers(-(2**63), 2**63 - 1))))
    rows = spark.createDataFrame(made, "node long, n long, runs binary, first binary, bits array<long>, fp long").cache()
    monkeypatch.setattr(near_copies, "stored", lambda df, tag: kept_with.setdefault(tag, []).append("bits" in df.columns) or whole(df, tag))
    assert not near_copies.links(rows).count()
    assert any(kept_with["parities"]) and not any(kept_with["moved"] + kept_with["prefixes"])
