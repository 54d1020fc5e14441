"""Nulls, empty and very long texts, repeated rows, clashing columns and empty tables, for operators and stages."""

from __future__ import annotations

import public_tokenizers
import pytest

import corpus_pipeline
from tessella.llm import byte_bpe, neighbours, pseudo_likelihood, quality, rans, secrets, simhash, substrings, token_counts
from tessella.llm.common import scratch
from tessella.llm.queries import BYTES, WORDS

LONG = " ".join(f"word{k % 5003} {k}" for k in range(150_000))


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, "a"), (1, 0, "b"), (2, None, "c"), (None, 1, "d"), (900002, 1, "e"), (900003, 0, "f")] + [(k, k % 2, "g") for k in range(3, 120)]
    return spark.createDataFrame(rows, "doc_id long, quality int, text string")


def test_quality_on_odd_rows(documents, labels):
    twice = documents.union(documents)
    one = sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in quality.scores(twice, labels).collect())
    two = sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in quality.scores(twice.repartition(13), labels).collect())
    assert one == two and len(one) == 2 * documents.count()
    kept = quality.accepted(documents, labels)
    assert kept.columns == documents.columns and kept.count() == quality.scores(documents, labels).where("predicted = 1").count()


def test_empty_tables(spark, documents, labels):
    none = documents.limit(0)
    path = scratch(spark, "rans")
    rans.write(none, path, public_tokenizers.path(WORDS))
    made = [
        simhash.near_duplicates(none), rans.read_ids(spark, path), byte_bpe.digests(none, public_tokenizers.path(BYTES), public_tokenizers.PATTERN), secrets.digests(none), substrings.digests(none), substrings.factors(none),
        pseudo_likelihood.scores(none), token_counts.token_counts(none, public_tokenizers.path(WORDS)), quality.scores(none, labels), quality.accepted(none, labels),
    ]
    assert [df.count() for df in made] == [0] * len(made)
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(vectors, vectors).count() == 0


def test_very_long_text(spark, labels):
    docs = spark.createDataFrame([(1, LONG), (2, "short"), (3, LONG + " end"), (4, "x" * 200_000)], "doc_id long, text string")
    n = len(LONG.split())
    words = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.digests(docs).collect()}
    assert words == {1: (n, 0), 2: (1, 0), 3: (n + 1, n), 4: (1, 0)}
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1, 4: 4}
    assert {r.doc_id: r.n_words for r in pseudo_likelihood.scores(docs).collect()} == {1: n, 2: 1, 3: n + 1, 4: 1}
    assert quality.scores(docs, labels).count() == 4
    path = scratch(spark, "rans")
    rans.write(docs, path, public_tokenizers.path(WORDS))
    counts = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, public_tokenizers.path(WORDS)).collect()}
    assert {r.doc_id: len(r.ids) // 4 - 1 for r in rans.read_ids(spark, path).collect()} == counts
    back = byte_bpe.encode(docs, public_tokenizers.path(BYTES), public_tokenizers.PATTERN).select("doc_id", "decoded").collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in back} == {r.doc_id: r.text for r in docs.collect()}


def test_segments_close(spark, monkeypatch):
    """Several segments in a part, one of a single document that is longer than a segment."""
    monkeypatch.setattr(rans, "SEGMENT", 50)
    docs = spark.createDataFrame([(k, f"some words of text {k}" * (30 if k == 7 else 1)) for k in range(40)], "doc_id long, text string").coalesce(1)
    path = scratch(spark, "rans")
    rans.write(docs, path, public_tokenizers.path(WORDS))
    files = spark.read.parquet(path)
    assert files.groupBy("part").count().agg({"count": "max"}).first()[0] > 1
    found = sorted(rans.read_ids(spark, path).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in found] == list(range(40))
    ends = 0
    for r in found:
        assert r.start == ends
        ends += len(r.ids) // 4


def test_stages_on_odd_rows(spark, documents, sf):
    """Every stage takes nulls, repeats and clashing columns; all but the last give the columns back."""
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "tokens":
            assert out.columns == documents.columns, name
        path = scratch(spark, name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    assert docs.count() > 0
