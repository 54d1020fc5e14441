"""No text that changes something passes the guard, and none changes a catalog."""

from __future__ import annotations

import pytest

from tessella.plans import execute, lineage, registry


@pytest.mark.parametrize("text", [t.replace("''", "'") for t in registry._CHANGES])
def test_nothing_changes(spark, tmp_path, text):
    spark.range(3).createOrReplaceTempView("t")
    before = sorted(t.name for t in spark.catalog.listTables())
    assert not lineage.read_only(spark, text)
    done = execute.execute(spark, text, str(tmp_path))
    assert done.state == "execution_error" and done.error == "not one query that only reads"
    assert sorted(t.name for t in spark.catalog.listTables()) == before and spark.table("t").columns == ["id"]


def test_analysed_commands(spark):
    assert lineage.changes_nothing(spark.sql("select 1")) and not lineage.changes_nothing(spark.sql("show tables"))
