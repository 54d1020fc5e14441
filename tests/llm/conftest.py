from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    """The small documents with nulls, empty texts, repeated rows and ids, and clashing columns."""
    rows = [
        (-1, None), (-2, ""), (None, "a b c d e f g h i j k l m n o p"), (900001, "a b c d e f g h i j k l m n o p"), (900002, "x a b c d e f g h i j k l m n o p y"),
        (900002, "a b c d e f g h i j k l m q"), (900003, "r " * 40), (900003, "r " * 40), (900004, "R " * 13), (900005, "Zürich's 🎉 <|endoftext|> token = abcdefghijklmnop"),
    ]
    more = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'xx' as lang", "'s' as source", "cast(0 as bigint) as n_chars")
    own = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    return own.union(more).selectExpr("*", "1 as fp", "2 as h", "3 as raw", "'z' as words")


@pytest.fixture(scope="session")
def rows(documents):
    return [(r.doc_id, r.text) for r in documents.collect()]
