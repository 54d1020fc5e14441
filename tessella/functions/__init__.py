"""Text functions over SQL and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Feature tags and the patterns, on lower-cased SQL, that give them; `ordinary` if none does.
FEATURES = [
    ("cte_or_subquery", r"\bwith\b|\(\s*select\b"),
    ("set_operation", r"\b(?:union(?:\s+all)?|intersect|except)\b"),
    ("wildcard", r"\b(?:select|,)\s*(?:distinct\s+)?(?:[\w`\"]+\s*\.\s*)?\*"),
    ("json", r"->|\b(?:jsonb?_(?:each|array_elements|extract)|json_extract)\b"),
    ("lateral_or_table_function", r"\blateral\b|\b(?:jsonb?_each|unnest|generate_series)\s*\("),
    ("using_or_natural_join", r"\b(?:using\s*\(|natural\s+(?:left\s+|right\s+|full\s+|inner\s+|cross\s+)?join)\b"),
    ("schema_qualified", r"\b(?:from|join|update|into)\s+[\w`\"]+\s*\.\s*[\w`\"]+"),
]
#: What a checker looks for. An identifier is bare, or in backquotes, brackets or double quotes.
NAME = r"(?:`[^`]+`|\[[^\]]+\]|\"[^\"]+\"|[\w\.]+)"
CHECKS = {
    "join_or_in": rf"(?is)JOIN\s+{NAME}(\s+AS\s+{NAME}){{0,1}}\s+ON(\s+{NAME}\.{NAME}\s*(=\s*{NAME}\.{NAME}(?:\s+OR\s+{NAME}\.{NAME}\s*=\s*{NAME}\.{NAME})+|IN\s+\(.*?\)))",
    "extreme_subquery": rf"(?is)=\s*\(\s*SELECT\s*(MAX|MIN)\s*\(\s*({NAME})\s*\)\s*FROM\s*({NAME})",
    "limit_subquery": r"(?is)= (\(SELECT .* LIMIT \d\))",
    "extreme_with_limit": rf"(?ism)^SELECT[^\(\)]*? ((MIN|MAX)\(\s*{NAME}\s*\)).*?LIMIT 1",
    "order_by_extreme": rf"(?is)ORDER BY ((MIN|MAX)\(\s*({NAME})\s*\)).*? LIMIT \d+",
    "qualified_wildcard": rf"(?ism)^SELECT.*? ({NAME}\.\*).*?FROM",
}
#: An ordered limit, totals in it, columns joined into one text, and a year compared with.
ORDERED, TOTALS = r"ORDER BY .*?(?<!DESC )LIMIT +\d+;{0,1}", r"SUM\(|COUNT\("
JOINED_NAMES = r"(?ism)^SELECT.*?\|\| ' ' \|\| .*?FROM"
YEAR = r"(strftime *\([^\(]*?\) *[>=<]+ *)(\d{4,})"
QUOTED = r"'[^']*+(?:'|\z)|\"[^\"]*+(?:\"|\z)|`[^`]*+(?:`|\z)|\[[^\]]*+(?:\]|\z)|--[^\n]*+(?:\n|\z)|(?s:/\*.*?(?:\*/|\z))"


def normalised(sql: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(sql, r"\s+", " ")))


def without_quotes(sql: Column) -> Column:
    """SQL without comments and quoted text; what isn't closed goes on to the end. A doubled quote ends one text and begins the next."""
    return F.regexp_replace(sql, QUOTED, " ")


def features(sql: Column, dialect: str = "sqlite") -> Column:
    """The tags of a query. In SQLite double quotes may be a name or a string, which is a tag too."""
    low = F.lower(sql)
    tags = [F.when(low.rlike(p), F.lit(name)) for name, p in FEATURES]
    if dialect.lower() == "sqlite":
        tags.append(F.when(F.contains(sql, F.lit('"')), F.lit("sqlite_double_quote_ambiguity")))
    found = F.array_compact(F.array(*tags))
    return F.when(F.size(found) == 0, F.array(F.lit("ordinary"))).otherwise(found)


def difficulty(sql: Column, tables: Column | None = None) -> Column:
    """NESTED of several SELECTs or a set operation, NON-NESTED of several tables or a join, else EASY."""
    bare = without_quotes(sql)
    nested = (F.regexp_count(bare, F.lit(r"(?i)\bSELECT\b")) > 1) | bare.rlike(r"(?i)\b(?:INTERSECT|UNION|EXCEPT)\b")
    joined = bare.rlike(r"(?i)\bJOIN\b")
    if tables is not None:
        joined = joined | (F.size(tables) > 1)
    return F.when(nested, "NESTED").when(joined, "NON-NESTED").otherwise("EASY")


def checks(sql: Column) -> dict[str, Column]:
    """Whether each checker finds what it looks for; an ordered limit that isn't descending counts unless it sums or counts."""
    found = {name: sql.rlike(pattern) for name, pattern in CHECKS.items()}
    cut = F.regexp_extract_all(sql, F.lit(ORDERED), F.lit(0))
    found["order_by_null"] = (F.size(cut) > 0) & ~F.exists(cut, lambda x: x.rlike(TOTALS))
    return found


def separate_names(sql: Column) -> Column:
    """A select that joins columns into one text gives them one by one."""
    parts = F.replace(F.replace(sql, F.lit("|| ' ' ||"), F.lit(", ")), F.lit("|| ', ' ||"), F.lit(", "))
    return F.when(sql.rlike(JOINED_NAMES), parts).otherwise(sql)


def quoted_year(sql: Column) -> Column:
    """strftime(...) compared with a bare number of four digits or more: the number is quoted."""
    return F.regexp_replace(sql, YEAR, "$1'$2'")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def tagged(text: Column, tag: str) -> Column:
    """What stands between <tag> and </tag>, without a ```sql fence around it; null if the tag is missing or holds nothing."""
    pattern = rf"(?s)<{tag}>(.*?)</{tag}>"
    inner = stripped(F.regexp_extract(text, pattern, 1))
    bare = stripped(F.when(inner.rlike(r"(?s)^```sql.*```\z"), F.regexp_replace(inner, r"(?s)^```sql|```\z", "")).otherwise(inner))
    return F.when(text.rlike(pattern) & (bare != ""), bare)


def keywords(text: Column) -> Column:
    """The tagged list of keywords, each trimmed and also cut at blanks, without repetitions and in order; null unless it is a list."""
    inner = stripped(F.regexp_extract(text, r"(?s)<result>(.*?)</result>", 1))
    asked = F.from_json(inner, "array<string>", {"allowSingleQuotes": "true"})
    each = F.transform(asked, stripped)
    return F.array_sort(F.array_distinct(F.flatten(F.transform(each, lambda x: F.concat(F.array(x), F.split(x, " "))))))


def selections(text: Column) -> Column:
    """array of struct(table_name, column_name) that a tagged answer of <table> and <column> elements names."""
    inner = F.regexp_extract(text, r"(?s)<result>(.*?)</result>", 1)
    table, column = r"<table\s+table_name\s*=\s*[\"']([^\"']+)[\"'][^>]*>", r"<column\s+column_name\s*=\s*[\"']([^\"']+)[\"']\s*/?>"
    tables = F.regexp_extract_all(inner, F.lit(rf"(?s){table}.*?</table>"), F.lit(0))
    return F.flatten(F.transform(tables, lambda t: F.transform(
        F.regexp_extract_all(F.regexp_replace(t, rf"^{table}", ""), F.lit(column), F.lit(1)),
        lambda c: F.struct(F.regexp_extract(t, table, 1).alias("table_name"), c.alias("column_name")),
    )))


def plain_description(text: Column) -> Column:
    """A column's description on one line."""
    one = F.regexp_replace(F.regexp_replace(text, "[\r\n]", " "), "commonsense evidence:", "")
    return stripped(F.regexp_replace(one, "  +", " "))


def name_pattern(name: Column) -> Column:
    """A pattern of an identifier, bare or quoted in any of three ways."""
    quoted = F.concat(F.lit("\\Q"), F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.concat(F.lit("(?:"), quoted, F.lit('|"'), quoted, F.lit('"|`'), quoted, F.lit("`|\\["), quoted, F.lit("\\])"))


def names_column(text: Column, table: Column, column: Column) -> Column:
    """Whether a text refers to table.column, or to table.*."""
    pattern = F.concat(F.lit(r"(?iU)(?<![\w])"), name_pattern(table), F.lit(r"\s*\.\s*(?:\*|"), name_pattern(column), F.lit(r")(?![\w])"))
    return F.rlike(text, pattern)


def usage(payload: Column) -> Column:
    """struct(prompt_tokens, completion_tokens, total_tokens) of a JSON record under either of its names: unknown is null, and a
    total that isn't given is the sum, if both parts are known."""

    def number(*names: str) -> Column:
        given = F.coalesce(*[F.get_json_object(payload, f"$.{n}") for n in names])
        value = F.when(given.rlike(r"^[0-9]+(?:\.[0-9]+)?\z"), F.expr("1.0D") * given.try_cast("double"))
        return value

    prompt, completion = number("prompt_tokens", "input_tokens"), number("completion_tokens", "output_tokens")
    total = F.coalesce(number("total_tokens"), prompt + completion)
    return F.struct(prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), total.alias("total_tokens"))


def query_error(code: Column, state: Column) -> Column:
    """false of an error that the query itself caused, null of any other."""
    own = code.isin(1, 19, 20, 23) | F.substring(state, 1, 2).isin("22", "23", "42")  # fixed values
    return F.when(F.coalesce(own, F.lit(False)), F.lit(False))


def failure_reason(status: Column, error: Column) -> Column:
    """Why a request failed, from its status and the text of its error."""
    text = F.coalesce(error, F.lit(""))
    return (
        F.when(F.contains(text, F.lit("APITimeoutError")), F.lit("timeout"))
        .when(text.rlike("RateLimitError|limit_requests"), F.lit("rate_limit"))
        .when(F.contains(text, F.lit("APIConnectionError")), F.lit("connection"))
        .when(status.isin("parse_rejected", "empty") | (text == ""), status)
        .otherwise(F.concat_ws(":", status, F.substring_index(text, ":", 1)))
    )


def sample_text(value: Column, kind: str) -> Column:
    """A sample value as text: bytes as 0x and hex digits."""
    return F.concat(F.lit("0x"), F.lower(F.hex(value))) if kind == "binary" else value.cast("string")


def display(value: Column, most: int = 100) -> Column:
    """A text to be shown, cut after so many characters."""
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most), F.lit("..."))).otherwise(value)


def raw_sql(answer: Column) -> Column:
    """The query in a raw answer: after the last `SQL:`, else in the last fence, else from the first SELECT or WITH on; quotes around all of it go.
    Null if what is left doesn't begin with SELECT or WITH."""
    text = F.trim(answer)
    marked = F.regexp_extract(text, r"(?is)^.*\bSQL\s*:\s*(.*)$", 1)
    fences = F.regexp_extract_all(text, F.lit(r"(?is)```(?:sql)?\s*(.*?)```"), F.lit(1))
    begun = F.regexp_extract(text, r"(?is)\b((?:SELECT|WITH)\b.*)$", 1)
    found = F.when(text.rlike(r"(?i)\bSQL\s*:\s*"), marked).when(F.size(fences) > 0, F.element_at(fences, -1)).otherwise(begun)
    found = F.regexp_replace(F.regexp_replace(_stripped(found), r"(?i)^```(?:sql)?\s*", ""), r"\s*```\s*$", "")
    found = _stripped(found)
    quoted = (F.length(found) >= 2) & found.startswith('"') & found.endswith('"')
    found = F.when(quoted, _stripped(F.substring(found, F.lit(2), F.length(found) - 2))).otherwise(found)
    return F.when(found.rlike(r"(?i)^(?:SELECT|WITH)\b"), found)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def selection(answer: Column) -> Column:
    """tables (name, columns) of an answer that is one JSON object of exactly that shape, in a fence or not; null for any other."""
    text = _stripped(answer)
    fenced = text.rlike(r"(?is)^```(?:json)?\s*.*?\s*```$")
    body = F.when(fenced, F.regexp_extract(text, r"(?is)^```(?:json)?\s*(.*?)\s*```$", 1)).otherwise(text)
    whole = F.try_parse_json(body)
    raw = F.from_json(body, "tables array<string>")["tables"]
    kind = lambda v, path, name: F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith(name)
    listed = (F.json_object_keys(body) == F.array(F.lit("tables"))) & kind(whole, "$.tables", "ARRAY")
    shaped = F.forall(raw, lambda t: F.coalesce((F.array_sort(F.json_object_keys(t)) == F.array(F.lit("columns"), F.lit("name"))) & t.rlike(r"^\{") & _texts(t), F.lit(False)))
    read = F.from_json(body, "tables array<struct<name:string,columns:array<string>>>")["tables"]
    return F.when(F.coalesce(listed & shaped, F.lit(False)), read)


def _texts(table: Column) -> Column:
    """Whether a table's name is a text and its columns are a list of texts."""
    v = F.try_parse_json(table)
    kinds = F.schema_of_variant(F.try_variant_get(v, "$.columns", "variant"))
    return (F.schema_of_variant(F.try_variant_get(v, "$.name", "variant")) == "STRING") & kinds.isin("ARRAY<STRING>", "ARRAY<VOID>")


def without_distinct(sql: Column) -> Column:
    """SQL without the word DISTINCT outside quotes and comments, but for IS [NOT] DISTINCT FROM."""
    kept = rf"({QUOTED}|\bIS\s+(?:NOT\s+)?DISTINCT\s+FROM\b)"
    return F.regexp_replace(sql, rf"(?is){kept}|\bDISTINCT\b", "$1")


def glob(pattern: Column) -> Column:
    """A regular expression for a name with `*` for any run of characters; all else stands for itself, in lower case."""
    return F.concat(F.lit(r"^"), F.replace(F.regexp_replace(F.lower(pattern), r"([\\.\[\]{}()+?^$|])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit("$"))


def quoted_name(name: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))


def bare_name(name: Column) -> Column:
    """A name without its double quotes, in lower case if it had none."""
    inner = F.replace(F.substring(name, F.lit(2), F.length(name) - 2), F.lit('""'), F.lit('"'))
    return F.when(name.rlike('^".*"$'), inner).otherwise(F.lower(name))


#: What a type's name holds makes it a number or a time.
NUMBERS, TIMES = "int|real|number|numeric|double|float|decimal", "date|time"


def kind_of_type(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.rlike(NUMBERS), "number").when(low.rlike(TIMES), "time").otherwise("text")


def flag(text: Column) -> Column:
    """A primary-key flag: true, false (also if empty), or null if it is neither."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "1", "yes", "y"), True).when(low.isin("", "false", "0", "no", "n"), False)


#: Words of SQL that a skeleton keeps.
KEPT = "select|from|where|group|by|order|having|limit|join|inner|left|right|full|on|and|or|not|in|is|null|like|between|union|all|intersect|except|distinct|as|case|when|then|else|end|count|sum|avg|min|max|asc|desc|exists"


def skeleton(sql: Column) -> Column:
    """The words of a query's shape: its keywords and signs, with `_` for each name, text or number."""
    bare = F.regexp_replace(sql, r"'[^']*'|\"[^\"]*\"|`[^`]*`", " _ ")
    words = F.regexp_extract_all(F.lower(bare), F.lit(r"[a-z_][a-z_0-9.]*|\d+(?:\.\d+)?|[<>=!]+|[(),*+/-]"), F.lit(0))
    return F.transform(words, lambda w: F.when(w.rlike(rf"^(?:{KEPT})$") | ~w.rlike("^[a-z_0-9]"), w).otherwise("_"))


def alike(a: Column, b: Column) -> Column:
    """The Jaccard similarity of two arrays as sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def with_hint(question: Column, evidence: Column) -> Column:
    given = F.trim(F.coalesce(evidence, F.lit(""))) != ""
    return F.when(given, F.concat(question, F.lit("\nHint: "), evidence)).otherwise(question)


def specified(prompt: Column, specification: Column, before: str = "Question:") -> Column:
    """A prompt with a specification block before its last `before`, or at its end; once only."""
    block = F.concat(F.lit("[Specification]\n"), specification, F.lit("\n[/Specification]\n"))
    at = F.length(prompt) - F.length(F.substring_index(prompt, before, -1)) - len(before)
    put = F.when(F.contains(prompt, F.lit(before)), F.concat(F.substring(prompt, F.lit(1), at), block, F.substring(prompt, at + 1, F.length(prompt)))).otherwise(F.concat(prompt, F.lit("\n"), block))
    return F.when(F.contains(prompt, F.lit("[Specification]")), prompt).otherwise(put)


def canonical_hash(*columns: str) -> Column:
    """The SHA-256 of a row as compact JSON, fields by name, nulls included."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
