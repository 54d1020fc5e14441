"""Readers and sinks on small files."""

from __future__ import annotations

import json

import pytest

from tessella.sources import catalogs, sinks


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_json_records(spark, tmp_path):
    (tmp_path / "a.json").write_text(' \n[{"id": 1}, {"id": 2}]')
    (tmp_path / "b.json").write_text('{"id": 1}\n\n{"id": 2}\n')
    for name in "ab":
        assert rows(catalogs.json_records(spark, str(tmp_path / f"{name}.json"), "id int", ["id"])) == [(1,), (2,)]
    (tmp_path / "c.json").write_text('[{"id": 1}, {"id": 1}]')
    with pytest.raises(ValueError):
        catalogs.json_records(spark, str(tmp_path / "c.json"), "id int", ["id"])


HEAD = "﻿original_column_name,column_name,column_description,data_format,value_description,primary_key,foreign_keys\n"


def test_strict_metadata(spark, tmp_path):
    (tmp_path / "t.csv").write_text(HEAD + 'id,,Key,integer,,Yes,\nu_id,the u,"two\nlines",bigint,a; b,,"[[""u"", ""id""]]"\n')
    got = {r.column_name: r for r in catalogs.strict_metadata(spark, str(tmp_path)).collect()}
    assert (got["id"].primary_key, got["id"].foreign_keys, got["id"].description) == (True, [], "Column Description: Key")
    assert (got["u_id"].table_name, got["u_id"].primary_key, got["u_id"].foreign_keys) == ("t", False, [["u", "id"]])
    assert got["u_id"].description == "Expanded Column Name: the u | Column Description: two\nlines | Value Description: a; b"


@pytest.mark.parametrize("bad", ["x,,,,,,", "x,,,int,,maybe,", 'x,,,int,,,"[[""a""]]"', "x,,,int,,,nope", "x,,,int,,,\nX,,,int,,,"])
def test_strict_metadata_refuses(spark, tmp_path, bad):
    (tmp_path / "t.csv").write_text(HEAD + bad + "\n")
    with pytest.raises(Exception, match="t|repeats"):
        catalogs.strict_metadata(spark, str(tmp_path)).collect()


def test_column_meanings(spark, tmp_path):
    said = {"db|T|A": " plain ", "db|T|b": {"column_meaning": "main", "fields_meaning": {"z": "1", "a": {"q": 2}}}}
    (tmp_path / "m.json").write_text(json.dumps(said))
    got = rows(catalogs.column_meanings(spark, str(tmp_path / "m.json")))
    assert got == [("t", "a", "db|T|A", "plain"), ("t", "b", "db|T|b", 'main\nFields: {"a":{"q":2},"z":"1"}')]


def test_cloud_tables(spark, tmp_path):
    one = {
        "table_name": " t ", "table_fullname": "p . d . t", "column_names": ["a", "r . x"], "column_types": ["INT"], "description": [None, "told"],
        "sample_rows": [{"a": 1, "r.x": "y" * 101}, {"a": None}, {"a": 1, "r.x": {"k": 2}}], "nested_column_names": ["r.x", "r.y"], "nested_column_types": ["S", "T"],
    }
    (tmp_path / "t.json").write_text(json.dumps(one))
    got = rows(catalogs.cloud_tables(spark, str(tmp_path)).drop("position"))
    assert got == [
        ("t", "p.d.t", "a", "INT", "", ["1", "NULL"], False), ("t", "p.d.t", "r.x", "UNKNOWN", "told", ['{"k": 2}'], False), ("t", "p.d.t", "r.y", "T", "", [], True),
    ]


def test_references(spark):
    bindings = spark.createDataFrame([(f"k{i}", str(i), "d") for i in range(7)], "task_key string, external_id string, database_id string")
    records = spark.createDataFrame(
        [("0", "d", {"sol_sql": '["select 1"]'}), ("1", "d", {"sol_sql": '["a", "b"]'}), ("2", "e", {"sol_sql": "select 2"}), ("3", "d", {"sol_sql": "x", "Clean_Up_sql": '["drop"]'}), ("4", "d", {}), ("4", "d", {}), ("5", "d", {"sol_sql": "select 5", "preprocess_sql": "[]"})],
        "external_id string, database_id string, record map<string,string>",
    )
    got = [(s, q) for _, _, s, q in rows(catalogs.references(bindings, records))]
    assert got == [("available", "select 1"), ("invalid_reference_sql", None), ("reference_database_mismatch", None), ("unsupported_reference_setup", None), ("duplicate_reference", None), ("available", "select 5"), ("missing_reference", None)]


def test_versions_and_caches(spark, tmp_path):
    path = str(tmp_path / "v")
    sinks.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), path, 1)
    sinks.upsert(spark.createDataFrame([(2, None)], "id int, v string"), path, 2)
    assert rows(sinks.current(spark.read.parquet(path), ["id"])) == [(1, "a"), (2, None)]
    assert rows(sinks.without_known(spark.range(4), spark.read.parquet(path), "id")) == [(0,), (3,)]
    keyed = str(tmp_path / "k")
    for batch in ([(1, "a"), (1, "a")], [(1, "z"), (2, "b")]):
        sinks.append_new(spark.createDataFrame(batch, "id int, v string"), keyed, ["id"])
    assert rows(spark.read.parquet(keyed)) == [(1, "a"), (2, "b")]
    for _ in range(2):
        assert rows(sinks.cached_result(spark, str(tmp_path / "cache"), "s", "select 1 as a")) == [(1,)]
    assert len(list((tmp_path / "cache").iterdir())) == 1


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a", "select 1"), ("b", "select 2")], "item string, sql string")
    sinks.export_texts(df, str(tmp_path / "out"), "item", "sql")
    assert rows(spark.read.text(str(tmp_path / "out")).select("item", "value")) == rows(df)
    sinks.exclusive(df, str(tmp_path / "once"))
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.exclusive(df, str(tmp_path / "once"))
    assert sinks.markdown(spark.createDataFrame([("a|b", 0.5, None)], "x string, y double, z int")) == "| x | y | z |\n| --- | --- | --- |\n| a\\|b | 0.50 |  |"
    sealed = sinks.checksummed(df)
    assert sinks.verified(sealed).count() == 0 and sinks.verified(sealed.withColumn("sql", df.item)).count() == 2
