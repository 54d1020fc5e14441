"""Queries over SQL texts and recorded answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as T
from ..sources import table
from .registry import query

SQLS = [
    "SELECT a, b FROM t", "select  A,B  from T", "SELECT * FROM t JOIN u ON t.id = u.id", "SELECT count(*) FROM (SELECT x FROM t) s", "WITH c AS (SELECT 1) SELECT * FROM c",
    "SELECT x FROM t UNION SELECT 'join' FROM u", "SELECT sum(x) OVER (PARTITION BY y) FROM t", "SELECT n FROM t WHERE strftime('%Y', d) = 2020", "SELECT n FROM t WHERE strftime ('%Y', d) >= 19991",
    "SELECT n FROM t WHERE strftime('%Y', d) = 99", "SELECT t.a FROM t JOIN u AS v ON v.id = t.id OR v.id = t.other", "SELECT t.a FROM t JOIN u ON u.id IN (1, 2)", "SELECT a FROM t WHERE b = (SELECT MAX(b) FROM t)",
    "SELECT a FROM t WHERE b = (SELECT b FROM u ORDER BY c DESC LIMIT 1)", "SELECT a, MAX(b) FROM t ORDER BY a LIMIT 1", "SELECT a FROM t GROUP BY a ORDER BY MIN(b) ASC LIMIT 3", "SELECT a FROM t ORDER BY b LIMIT 5",
    "SELECT a FROM t ORDER BY b DESC LIMIT 5", "SELECT a FROM t ORDER BY SUM(b) LIMIT 5;", "SELECT t.* FROM t", "SELECT a || ' ' || b FROM t", "SELECT a || ', ' || b FROM t", "SELECT \"a\" FROM main.t -- join",
    "SELECT a /* union\n select */ FROM t NATURAL JOIN u", "SELECT j -> 'k' FROM t, unnest(x)", "SELECT 'it''s a join' FROM [select] WHERE `join` = 1", "SELECT a FROM t WHERE b = 'unclosed select", "",
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda x: "null" if x is None else _quoted(x) if isinstance(x, str) else str(x)
    return "(values " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") v({names})"


LITERAL = _values(list(enumerate(SQLS)), "id, s")
#: DuckDB's patterns go without possessive repetition, which changes nothing here.
BARE = f"regexp_replace(s, {_quoted(T.QUOTED.replace('*+', '*'))}, ' ', 'g')"


def _sqls(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SQLS)), "id int, s string")


@query(rf"""select cast(id as int) as id, lower(trim(regexp_replace(s, '\s+', ' ', 'g'))) as normal,
    case when len(regexp_extract_all(b, '(?i)\bselect\b')) > 1 or regexp_matches(b, '(?i)\b(union|intersect|except)\b') then 'NESTED' when regexp_matches(b, '(?i)\bjoin\b') then 'NON-NESTED' else 'EASY' end as difficulty
    from (select *, {BARE} as b from {LITERAL})""")
def sql_difficulty_label(spark, sf_dir):
    return _sqls(spark).select("id", T.normalised(F.col("s")).alias("normal"), T.difficulty(F.col("s")).alias("difficulty"))


@query(f"select cast(id as int) as id, {BARE} as bare from {LITERAL}")
def sql_without_quotes(spark, sf_dir):
    return _sqls(spark).select("id", T.without_quotes(F.col("s")).alias("bare"))


_TAGS = " union all ".join(f"select id, {_quoted(name)} as tag from x where regexp_matches(lower(s), {_quoted(p)})" for name, p in T.FEATURES)


@query(f"""with x as (select * from {LITERAL}), t as ({_TAGS} union all select id, 'sqlite_double_quote_ambiguity' from x where contains(s, '"')), a as (select id, tag from t union all select id, 'ordinary' from x where id not in (select id from t))
    select tag as feature, count(*) as n, cast(min(id) as int) as first_id from a group by tag""")
def sql_feature_tags(spark, sf_dir):
    return _sqls(spark).select("id", F.explode(T.features(F.col("s"))).alias("feature")).groupBy("feature").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


_CUT = "regexp_extract_all(replace(s, 'DESC LIMIT', 'DESC ~'), 'ORDER BY .*?LIMIT +\\d+')"


@query("select cast(id as int) as id, " + ", ".join(f"regexp_matches(s, {_quoted(p)}) as {name}" for name, p in T.CHECKS.items())
       + rf", len({_CUT}) > 0 and len(list_filter({_CUT}, lambda x: regexp_matches(x, 'SUM\(|COUNT\('))) = 0 as order_by_null from {LITERAL}")
def sql_checks(spark, sf_dir):
    return _sqls(spark).select("id", *[c.alias(name) for name, c in T.checks(F.col("s")).items()])


@query(rf"""select cast(id as int) as id, regexp_replace(s, {_quoted(T.YEAR)}, '\1''\2''', 'g') as year_quoted,
    case when regexp_matches(s, {_quoted(T.JOINED_NAMES)}) then replace(replace(s, '|| '' '' ||', ', '), '|| '', '' ||', ', ') else s end as separate from {LITERAL}""")
def sql_rewrites(spark, sf_dir):
    return _sqls(spark).select("id", T.quoted_year(F.col("s")).alias("year_quoted"), T.separate_names(F.col("s")).alias("separate"))


_ANSWERS = [
    (0, "so <result>```sql\nSELECT 1\n```</result>"), (1, "<result> SELECT 2 </result> <result>no</result>"), (2, "<result>```\nSELECT 3```</result>"), (3, "<result>  </result>"), (4, "nothing"),
    (5, "<result>['big apple', \"it\", 'it ']</result>"), (6, '<result>["x y z"]</result>'),
    (7, "<result><table table_name=\"a\"><column column_name=\"id\"/><column column_name='v'></table><table table_name = 'b' x><column column_name=\"w\" /></table></result>"),
]


def _answers(spark) -> DataFrame:
    return spark.createDataFrame(_ANSWERS, "id int, answer string")


_SQL_OF = [(0, "SELECT 1"), (1, "SELECT 2"), (2, "```\nSELECT 3```"), (5, "['big apple', \"it\", 'it ']"), (6, '["x y z"]'), (7, _ANSWERS[7][1][8:-9])]


@query(f"select cast(id as int) as id, sql from {_values(_SQL_OF, 'id, sql')}")
def answer_sql(spark, sf_dir):
    return _answers(spark).select("id", T.tagged(F.col("answer"), "result").alias("sql")).where("sql is not null")


@query(f"select cast(id as int) as id, keyword from {_values([(5, 'apple'), (5, 'big'), (5, 'big apple'), (5, 'it'), (6, 'x'), (6, 'x y z'), (6, 'y'), (6, 'z')], 'id, keyword')}")
def answer_keywords(spark, sf_dir):
    return _answers(spark).where("id in (4, 5, 6)").select("id", F.explode(T.keywords(F.col("answer"))).alias("keyword"))


@query(f"select cast(id as int) as id, table_name, column_name from {_values([(7, 'a', 'id'), (7, 'a', 'v'), (7, 'b', 'w')], 'id, table_name, column_name')}")
def answer_selections(spark, sf_dir):
    return _answers(spark).select("id", F.explode(T.selections(F.col("answer"))).alias("x")).select("id", "x.*")


_TEXTS = [(0, 'take a.id and "a"."Name"'), (1, "[b] . * or xa.id"), (2, "a.idx, `b`.`v`"), (3, "b.v.w a . ID;"), (4, None)]
_NAMES = [("a", "id"), ("a", "name"), ("b", "v"), ("b", "w")]
_FORMS = lambda c: f"'(?:' || {c} || '|\"' || {c} || '\"|`' || {c} || '`|\\[' || {c} || '\\])'"


@query(rf"""select cast(id as int) as id, table_name, column_name from {_values(_TEXTS, 'id, body')}, {_values(_NAMES, 'table_name, column_name').replace(') v(', ') n(')}
    where regexp_matches(body, '(?i)(?:^|\W)' || {_FORMS('table_name')} || '\s*\.\s*(?:\*|' || {_FORMS('column_name')} || ')(?:\W|$)')""")
def column_references(spark, sf_dir):
    names = spark.createDataFrame(_NAMES, "table_name string, column_name string")
    texts = spark.createDataFrame(_TEXTS, "id int, body string")
    return texts.join(F.broadcast(names), T.names_column(F.col("body"), F.col("table_name"), F.col("column_name"))).select("id", "table_name", "column_name")


_USAGE = [(0, '{"prompt_tokens": 3, "completion_tokens": 4}'), (1, '{"input_tokens": 5, "output_tokens": 6, "total_tokens": 20}'), (2, '{"prompt_tokens": "x"}'), (3, None), (4, '{"prompt_tokens": -1, "completion_tokens": 2}')]


@query(f"select cast(id as int) as id, prompt_tokens, completion_tokens, total_tokens from (values (0, 3.0::double, 4.0::double, 7.0::double), (1, 5, 6, 20), (2, null, null, null), (3, null, null, null), (4, null, 2, null)) v(id, prompt_tokens, completion_tokens, total_tokens)")
def usage_normalised(spark, sf_dir):
    return spark.createDataFrame(_USAGE, "id int, payload string").select("id", T.usage(F.col("payload")).alias("u")).select("id", "u.*")


_ERRORS = [(0, "failed", "openai.APITimeoutError: late", 1, None), (1, "failed", "x limit_requests", 5, None), (2, "parse_rejected", "ValueError: no", None, "42601"), (3, "failed", "KeyError: k: v", None, "08006"), (4, "failed", None, None, None), (5, "failed", "APIConnectionError", 23, "22000")]


@query("""select cast(id as int) as id, reason, own_error from (values (0, 'timeout', false), (1, 'rate_limit', null), (2, 'parse_rejected', false), (3, 'failed:KeyError', null), (4, 'failed', null), (5, 'connection', false)) v(id, reason, own_error)""")
def failure_reasons(spark, sf_dir):
    e = spark.createDataFrame(_ERRORS, "id int, status string, error string, code int, state string")
    return e.select("id", T.failure_reason(F.col("status"), F.col("error")).alias("reason"), T.query_error(F.col("code"), F.col("state")).alias("own_error"))


@query(r"""select doc_id, md5(trim(regexp_replace(replace(replace(replace(text, chr(13), ' '), chr(10), ' '), 'commonsense evidence:', ''), '  +', ' ', 'g'))) as plain_hash,
    case when length(text) > 100 then substr(text, 1, 100) || '...' else text end as shown from documents""")
def description_normalised(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(T.plain_description(F.col("text"))).alias("plain_hash"), T.display(F.col("text")).alias("shown"))
