"""Joins that assert, and what they refuse."""

from __future__ import annotations

import pytest

from tessella.operators import evaluation


def test_faults_are_named(spark):
    make = lambda rows: spark.createDataFrame(rows, "k int, db string")
    a = make([(1, "x"), (2, "y")])
    assert evaluation.joined_one_to_one(a, make([(2, "y"), (1, "x"), (3, "z")]), ["k"], ["db"]).count() == 2
    for other, word in (([(1, "x")], "missing 2"), ([(1, "x"), (2, "y"), (2, "y")], "repeated 2"), ([(1, "x"), (2, "n")], "db differs 2"), ([(1, "x"), (2, None)], "db differs 2")):
        with pytest.raises(Exception, match=word):
            evaluation.joined_one_to_one(a, make(other), ["k"], ["db"]).collect()


def test_offline_runs_each_text_once(spark):
    asked = []

    def run(text):
        asked.append(text)
        return ("success", spark.sql(text)) if "broken" not in text else ("execution_error", None)

    gold = [("a", "select 1"), ("b", "broken"), ("c", None)]
    tried = [("a", 0, "select 1"), ("a", 1, "select 2"), ("a", 2, "select 2"), ("b", 0, "select 1"), ("c", 0, "select 1"), ("d", 0, "select 2")]
    got = {(r["item"], r.slot): (r.bag_equal, r.pool) for r in evaluation.offline(spark, gold, tried, run, ("success",)).collect()}
    assert got == {("a", 0): (True, "has_match"), ("a", 1): (False, "has_match"), ("a", 2): (False, "has_match"), ("b", 0): (None, "unknown"), ("c", 0): (None, "unknown"), ("d", 0): (None, "unknown")}
    assert sorted(asked) == ["broken", "select 1", "select 2"]
