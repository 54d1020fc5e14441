"""SQLite files as a Spark source: tables in ranges of row ids or any one query, read-only, and their catalog.

The file must lie where every executor can open it. SQLite has no types of columns but only of cells, so columns are read by
their declared affinity; a cell that doesn't fit is null in strict numbers and text elsewhere. Broken UTF-8 is replaced.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DataType, DoubleType, LongType, StringType, StructField, StructType


def plain(path: str) -> str:
    """A path as SQLite opens it; the shared folder may be named by a file: URI."""
    if not path.startswith("file:"):
        return path
    return unquote(urlsplit(path).path)


def opened(path: str) -> sqlite3.Connection:
    c = sqlite3.connect(f"file:{quote(plain(path))}?mode=ro", uri=True)
    c.text_factory = lambda raw: raw.decode("utf-8", "replace")
    return c


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def spark_type(declared: str) -> DataType:
    """By SQLite's rules of affinity; dates and other words are text, since SQLite keeps them so."""
    kind = declared.upper()
    if "INT" in kind:
        return LongType()
    if any(w in kind for w in ("REAL", "FLOA", "DOUB", "NUMERIC", "DECIMAL")):
        return DoubleType()
    return BinaryType() if "BLOB" in kind else StringType()


def cell(value, kind: DataType):
    if value is None or isinstance(kind, BinaryType):
        return value if value is None or isinstance(value, bytes) else str(value).encode()
    if isinstance(kind, (LongType, DoubleType)):
        if isinstance(value, (int, float)) and (isinstance(kind, DoubleType) or float(value).is_integer()):
            return float(value) if isinstance(kind, DoubleType) else int(value)
        return None
    return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)


class Range(InputPartition):
    def __init__(self, low: int | None, high: int | None) -> None:
        self.low, self.high = low, high


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, table: str | None, query: str | None, parts: int) -> None:
        self.schema, self.path, self.table, self.query, self.parts = schema, path, table, query, parts

    def partitions(self) -> list[InputPartition]:
        if self.query or self.parts < 2:
            return [Range(None, None)]
        c = opened(self.path)
        try:
            low, high = c.execute(f"select min(rowid), max(rowid) from {quoted(self.table)}").fetchone()
        except sqlite3.OperationalError:  # a table without row ids
            return [Range(None, None)]
        finally:
            c.close()
        if low is None:
            return [Range(None, None)]
        width = (high - low) // self.parts + 1
        return [Range(at, min(at + width, high + 1)) for at in range(low, high + 1, width)]

    def read(self, part: Range) -> Iterator[tuple]:
        names = ", ".join(quoted(f.name) for f in self.schema)
        sql = self.query or f"select {names} from {quoted(self.table)}"
        if part.low is not None:
            sql += f" where rowid >= {part.low} and rowid < {part.high}"
        kinds = [f.dataType for f in self.schema]
        c = opened(self.path)
        try:
            for row in c.execute(sql):
                yield tuple(map(cell, row, kinds))
        finally:
            c.close()


class Sqlite(DataSource):
    """Options: path; table or query; partitions (ranges of row ids, 8)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        c = opened(self.options["path"])
        try:
            if table := self.options.get("table"):
                found = [(n, spark_type(t or "")) for _, n, t, *_ in c.execute(f"pragma table_info({quoted(table)})")]
                if not found:
                    raise ValueError(f"no table {table}")
            else:
                # a query's columns have no declared types: its first rows tell, mixed ones are text
                rows = c.execute(self.options["query"])
                names, seen = [d[0] for d in rows.description], [set() for _ in rows.description]
                for row in rows.fetchmany(1000):
                    for s, x in zip(seen, row):
                        if x is not None:
                            s.add(type(x))
                one = lambda s: LongType() if s == {int} else DoubleType() if s and s <= {int, float} else BinaryType() if s == {bytes} else StringType()
                found = [(n, one(s)) for n, s in zip(names, seen)]
        finally:
            c.close()
        return StructType([StructField(n, t) for n, t in found])

    def reader(self, schema: StructType) -> Reader:
        o = self.options
        return Reader(schema, o["path"], o.get("table"), o.get("query"), int(o.get("partitions", 8)))


def tables(path: str) -> list[str]:
    c = opened(path)
    try:
        return [n.strip() for (n,) in c.execute("select name from sqlite_master where type = 'table' and name <> 'sqlite_sequence' order by rowid")]
    finally:
        c.close()


def views(spark: SparkSession, path: str) -> list[str]:
    """A temporary view of every table, so that Spark runs what was written for the file."""
    spark.dataSource.register(Sqlite)
    found = tables(path)
    for name in found:
        spark.read.format("sqlite").option("path", path).option("table", name).load().createOrReplaceTempView(f"`{name}`")
    return found


def catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """columns (table_name, ordinal, column_name, data_type, is_pk) and foreign keys (table_name, column_name, ref_table,
    ref_column) of a file. A reference without a column means the other table's primary key, of several the one of its name."""
    c = opened(path)
    try:
        info = {t: c.execute(f"pragma table_info({quoted(t)})").fetchall() for t in tables(path)}
        links = {t: {(r[3], r[2], r[4]) for r in c.execute(f"pragma foreign_key_list({quoted(t)})")} for t in info}
    finally:
        c.close()
    columns = [(t, r[0], r[1].strip(), r[2].strip(), r[5] != 0) for t, rows in info.items() for r in rows]
    by_name = {t.lower(): t for t in info}
    fks = []
    for t, found in links.items():
        for own, other, ref in sorted(found, key=str):
            if ref is None:
                keys = [r[1] for r in info.get(by_name.get(other.lower(), other), []) if r[5]]
                same = [k for k in keys if k.lower() == own.lower()]
                ref = keys[0] if len(keys) == 1 else same[0] if same else None
                if ref is None:
                    raise ValueError(f"{t}.{own} refers to {other}, which has no key to stand for it")
            fks.append((t, own.strip(), other.strip(), ref.strip()))
    return (
        spark.createDataFrame(columns, "table_name string, ordinal int, column_name string, data_type string, is_pk boolean"),
        spark.createDataFrame(fks, "table_name string, column_name string, ref_table string, ref_column string"),
    )
