"""SQLite files, backends and queries with a time limit."""

from __future__ import annotations

import sqlite3

import pytest

from tessella.plans.execute import execute
from tessella.sources import backends, sqlite


@pytest.fixture
def path(tmp_path):
    p = str(tmp_path / "a.sqlite")
    c = sqlite3.connect(p)
    c.executescript("""create table u (id integer primary key, name varchar(9)); create table "odd t" (a INT, b REAL, c blob, u_id integer references u, "x y" text);
        create table w (k text primary key, v numeric) without rowid; create table empty (a int);""")
    c.executemany("insert into u values (?, ?)", [(i, f"n{i}") for i in range(1, 101)])
    c.execute('insert into "odd t" values (1, 2, x\'00ff\', 7, \'é\'), (\'word\', \'word\', \'t\', null, cast(x\'ff41\' as text))')
    c.execute("insert into w values ('a', 1.5)")
    c.commit()
    c.close()
    return p


def test_tables(spark, path):
    assert sqlite.views(spark, path) == ["u", "odd t", "w", "empty"]
    assert spark.sql("select count(*), sum(id), count(distinct name) from u").first() == (100, 5050, 100)
    got = sorted(map(tuple, spark.sql("select * from `odd t`").collect()), key=str)
    assert got == [(1, 2.0, b"\x00\xff", 7, "é"), (None, None, b"t", None, "�A")]
    assert spark.sql("select k, v, (select count(*) from empty) from w").collect() == [("a", 1.5, 0)]
    assert spark.sql("select name from u join `odd t` on id = u_id").collect() == [("n7",)]


def test_catalog(spark, path):
    columns, fks = sqlite.catalog(spark, path)
    assert [tuple(r) for r in fks.collect()] == [("odd t", "u_id", "u", "id")]
    assert {(r.table_name, r.column_name) for r in columns.where("is_pk").collect()} == {("u", "id"), ("w", "k")}


def test_query(spark, path):
    got = backends.reader(spark, {"kind": "sqlite", "path": path}, "select id % 2 as odd, count(*) n, max(name) from u group by 1 order by 1")
    assert [tuple(r) for r in got.collect()] == [(0, 50, "n98"), (1, 50, "n99")]
    with pytest.raises(Exception, match="readonly|read-only|attempt to write"):
        backends.reader(spark, {"kind": "sqlite", "path": path}, "delete from u").collect()
    with pytest.raises(ValueError):
        backends.reader(spark, {"kind": "other"}, "select 1")


def test_execute(spark, path, tmp_path):
    run = lambda sql, **kind: execute(spark, sql, str(tmp_path / "out"), **kind)
    assert (run("select 1 as a, 1 as a").state, run("select 1 where false").state, run("select null, null union all select null, null").state) == ("success", "empty_result", "all_null_result")
    assert run("drop table x").state == run("select nothing").state == "execution_error"
    done = run("select name from u where id < 3", backend={"kind": "sqlite", "path": path})
    assert done.state == "success" and done.rows.count() == 2
    slow = run("select sum(a.id * b.id % 7) from range(4000000) a, range(4000000) b", timeout=3)
    assert slow.state == "timeout" and slow.seconds < 60
    assert run("select count(*) from range(10)").state == "success"
