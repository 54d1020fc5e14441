"""Queries of an evaluation's steps as wholes, over tables derived from the test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as T
from ..operators import evaluation, profile
from ..operators import vectors as search
from ..sources import catalogs, sinks, sqlite, table, views, workspace
from . import execute as runs
from .registry import query


def _view(spark, sf_dir, names: str, text: str) -> DataFrame:
    views(spark, sf_dir, names)
    return spark.sql(text)


@query("select d.doc_id, l.quality, d.lang from documents d join labels l on l.doc_id = d.doc_id")
def asserted_one_to_one(spark, sf_dir):
    """Labels with their documents, which each must have once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return evaluation.joined_one_to_one(table(spark, sf_dir, "labels").select("doc_id", "quality"), docs, ["doc_id"]).select("doc_id", "quality", "lang")


@query("select o_orderkey, o_totalprice, o_orderstatus from orders")
def gold_by_index(spark, sf_dir):
    """Records with their reference by index, after a check that both sides name the same customer."""
    o = table(spark, sf_dir, "orders")
    return evaluation.joined_one_to_one(o.select("o_orderkey", "o_custkey", "o_totalprice"), o.select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderkey"], ["o_custkey"]).drop("o_custkey")


@query("""with a as (select doc_id from documents), b as (select doc_id from labels), s as (select a.doc_id as x, b.doc_id as y from a full join b on a.doc_id = b.doc_id)
    select count(*) filter (y is null) as only_a, count(*) filter (x is null) as only_b, count(*) filter (x is not null and y is not null) as shared, cast(0 as bigint) as repeated, count(*) filter (x is null or y is null) = 0 as equal from s""")
def membership_audit(spark, sf_dir):
    return evaluation.membership(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query("""select label, count(*) as n, cast(min(len(embedding)) as int) as width, round(sum(list_dot_product(cast(embedding as double[]), cast(embedding as double[])) / list_dot_product(cast(embedding as double[]), cast(embedding as double[]))), 6) as squares,
    round(sum(embedding[1] / sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[])))), 4) as firsts from embeddings group by label""")
def vector_index_build(spark, sf_dir):
    """Vectors of unit length, written by label and read back."""
    path = workspace(spark, "index")
    evaluation.normalised(table(spark, sf_dir, "embeddings")).write.partitionBy("label").parquet(path)
    v = spark.read.parquet(path)
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    return v.groupBy("label").agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("width"), F.round(F.sum(square), 6).alias("squares"), F.round(F.sum(F.get("embedding", F.lit(0))), 4).alias("firsts"))


_COS = "list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[]))"


@query(f"""with f as (select q.vec_id as query_id, e.vec_id, row_number() over (partition by q.vec_id order by round({_COS}, 6) desc, e.vec_id) as r from embeddings e, embeddings q where q.vec_id % 20 = 0 and e.vec_id <> q.vec_id),
    got as (select query_id, vec_id as value, r as place from f where r <= 3),
    was as (select q.vec_id as query_id, (q.vec_id + s.s) as value, 10 + s.s as place from embeddings q, (select unnest([1, 2, 3]) as s) s where q.vec_id % 20 = 0),
    one as (select query_id, value, min(place) as place from (select * from got union all select * from was) group by query_id, value),
    top as (select *, row_number() over (partition by query_id order by place) as rank from one)
    select query_id, string_agg(cast(value as varchar), ',' order by rank) as examples from top where rank <= 4 group by query_id""")
def value_examples_retrieved(spark, sf_dir):
    """The three nearest values of each query, then those that were there, four in all."""
    e = table(spark, sf_dir, "embeddings")
    found = search.nearest_cosine(e.where("vec_id % 20 = 0"), e, 3).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"]).alias("got"))
    was = F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda s: F.col("query_id") + s)
    return found.select("query_id", F.array_join(evaluation.merged_examples(F.col("got"), was, 4), ",").alias("examples"))


_LINKS = """select p_size as item, 'direct' as linker, true as ok, p_type as table_name, p_brand as column_name from part where p_partkey % 3 = 0
    union all select p_size, 'reversed', true, p_type, p_brand from part where p_partkey % 5 = 0
    union all select distinct p_size, 'value', p_size % 10 <> 0, cast(null as {string|varchar}), cast(null as {string|varchar}) from part"""


def _links(engine: str) -> str:
    return _LINKS.replace("{string|varchar}", "string" if engine == "spark" else "varchar")


@query(f"""with l as ({_links('duckdb')}), w as (select item, bool_and(ok) and count(distinct linker) = 3 as whole from l group by item)
    select distinct l.item, table_name, column_name, false as failed from l join w on w.item = l.item where whole and table_name is not null union all select item, null, null, true from w where not whole""")
def schema_linking_union(spark, sf_dir):
    return evaluation.linked_union(_view(spark, sf_dir, "part", _links("spark")), 3)


_CATALOG = "select distinct p_type as table_name, p_brand as column_name, p_brand = (select min(p_brand) from part q where q.p_type = p.p_type) as is_pk from part p"


@query(f"""with l as ({_links('duckdb')}), w as (select item from l group by item having bool_and(ok) and count(distinct linker) = 3), k as (select item, table_name, column_name from l semi join w using (item) where table_name is not null), c as ({_CATALOG})
    select * from k union select t.item, c.table_name, c.column_name from c join (select distinct item, table_name from k) t on t.table_name = c.table_name where c.is_pk""")
def schema_after_linking(spark, sf_dir):
    """Each item's crop by the union of its linkers, with the primary keys of its tables."""
    columns = _view(spark, sf_dir, "part", _CATALOG)
    none = spark.createDataFrame([], "table_name string, column_name string, ref_table string, ref_column string")
    return evaluation.linked_crops(_view(spark, sf_dir, "part", _links("spark")), 3, columns, none)


_IDS = "select n_regionkey % 2 as db, n_regionkey as table_id, n_nationkey as column_id from nation"


@query(f"select db, column_id, dense_rank() over (partition by db order by table_id) - 1 as new_table, dense_rank() over (partition by db order by column_id) - 1 as new_column from ({_IDS}) where column_id % 3 <> 0")
def schema_crop_remapped(spark, sf_dir):
    columns = _view(spark, sf_dir, "nation", _IDS)
    kept, _ = evaluation.remapped(columns, columns.where("column_id % 3 <> 0"), spark.createDataFrame([], "db int, column_id int, ref_id int"))
    return kept.select("db", "column_id", F.col("new_table").cast("long").alias("new_table"), F.col("new_column").cast("long").alias("new_column"))


_EDGES = f"select a.db, a.column_id, b.column_id as ref_id from ({_IDS}) a join ({_IDS}) b on a.db = b.db and b.column_id = a.column_id + 2"


@query(f"with c as (select db, column_id, dense_rank() over (partition by db order by column_id) - 1 as i from ({_IDS}) where column_id % 3 <> 0) select e.db, x.i as new_id, y.i as new_ref from ({_EDGES}) e join c x on x.db = e.db and x.column_id = e.column_id join c y on y.db = e.db and y.column_id = e.ref_id")
def schema_edges_remapped(spark, sf_dir):
    columns = _view(spark, sf_dir, "nation", _IDS)
    _, edges = evaluation.remapped(columns, columns.where("column_id % 3 <> 0"), spark.sql(_EDGES))
    return edges.select("db", F.col("new_id").cast("long").alias("new_id"), F.col("new_ref").cast("long").alias("new_ref"))


@query("""with m as (select n_regionkey as item, case n_nationkey % 4 when 0 then 'q_tab_match' when 1 then 'q_col_match' when 2 then 'cell_match' else 'num_date_match' end as name, n_nationkey % 5 as place from nation),
    c as (select r_regionkey as column_id, r_regionkey % 2 as table_id, case r_regionkey % 2 when 0 then 'even' else 'odd' end as table_name, lower(r_name) as column_name from region),
    k as (select distinct m.item, c.* from m join c on c.column_id = m.place where m.name <> 'q_tab_match' and m.place <> 0),
    t as (select item, table_name from k union select m.item, c.table_name from m join (select distinct table_id, table_name from c) c on c.table_id = m.place where m.name = 'q_tab_match')
    select item, table_name, null as column_name from t union all select item, table_name, column_name from k""")
def native_links_normalised(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    name = F.when(F.col("n_nationkey") % 4 == 0, "q_tab_match").when(F.col("n_nationkey") % 4 == 1, "q_col_match").when(F.col("n_nationkey") % 4 == 2, "cell_match").otherwise("num_date_match")
    matches = n.select(F.col("n_regionkey").alias("item"), F.lit("sc_link").alias("channel"), name.alias("name"), F.concat(F.lit("3,"), (F.col("n_nationkey") % 5).cast("string")).alias("place"))
    r = table(spark, sf_dir, "region")
    columns = r.select(F.col("r_regionkey").alias("column_id"), (F.col("r_regionkey") % 2).alias("table_id"), F.when(F.col("r_regionkey") % 2 == 0, " even ").otherwise("odd").alias("table_name"), F.concat(F.lit(" "), F.lower("r_name")).alias("column_name"))
    return evaluation.native_links(matches, columns)


_TEXT = "'SELECT c FROM t WHERE strftime(''%Y'', d) = ' || cast(2000 + l_linenumber as {s}) || case when l_linenumber % 2 = 0 then ' ORDER BY b LIMIT 5' else '' end"


@query(f"""select l_orderkey as item, l_linenumber as slot, 'SELECT c FROM t WHERE strftime(''%Y'', d) = ''' || cast(2000 + l_linenumber as varchar) || '''' || case when l_linenumber % 2 = 0 then ' ORDER BY b LIMIT 5' else '' end as revised,
    case when l_linenumber % 2 = 0 then 'order_by_null' else '' end as checks from lineitem""")
def revision_chain(spark, sf_dir):
    """Texts of an order's lines through the chain, each distinct one once, back in their slots."""
    rows = _view(spark, sf_dir, "lineitem", f"select l_orderkey as item, l_linenumber as slot, {_TEXT.format(s='string')} as sql from lineitem")
    return evaluation.revised(rows).select("item", "slot", "revised", F.array_join("checks", ",").alias("checks"))


_CANDS = "select o_custkey as item, cast(row_number() over (partition by o_custkey order by o_orderkey) as int) as slot, case when o_orderkey % 7 = 0 then null else o_orderpriority end as result_hash from orders"
_VOTES = "select a.item, a.slot as a, b.slot as b, 1 + (a.slot * 7 + b.slot) % 3 as n_a, (a.slot + b.slot) % 2 as n_b, a.slot % 2 as n_tie from c a join c b on a.item = b.item and a.slot < b.slot"


@query(f"""with c as ({_CANDS}), g as (select item, result_hash, min(slot) as rep, count(*) as n from c where result_hash is not null group by 1, 2),
    s as (select item, rep, n / sum(n) over (partition by item) as score, row_number() over (partition by item order by n desc, rep) as rank from g),
    k as (select *, count(*) over (partition by item) as m, max(score) over (partition by item) as top, score / sum(score) over (partition by item) as w from s where rank <= 3),
    v as ({_VOTES}), x as (select item, a as slot, b as other, n_a as own, n_b as their, n_tie from v union all select item, b, a, n_b, n_a, n_tie from v),
    win as (select x.item, x.slot, sum((own + 0.5 * n_tie) / (own + their + n_tie)) as wins from x join k on k.item = x.item and k.rep = x.other group by 1, 2),
    p as (select k.item, k.rep, k.rank, case when m = 1 then 'single' when top >= 0.6 then 'shortcut' else 'pairwise' end as branch, coalesce(wins, 0) / m * w as points from k left join win on win.item = k.item and win.slot = k.rep),
    q as (select *, row_number() over (partition by item order by case when branch = 'pairwise' then -round(points, 9) else rank end, rank) as o from p)
    select item, branch, rep as slot from q where o = 1 union all select item, 'no_valid', min(slot) from c group by item having count(result_hash) = 0""")
def selection_final(spark, sf_dir):
    """The chosen slot of each customer: shortlist of three, shortcut from 0.6 on, else pairwise."""
    c = _view(spark, sf_dir, "orders", _CANDS)
    a, b = c.alias("a"), c.alias("b")
    votes = a.join(b, (F.col("a.item") == F.col("b.item")) & (F.col("a.slot") < F.col("b.slot"))).select(
        "a.item", F.col("a.slot").alias("a"), F.col("b.slot").alias("b"), (1 + (F.col("a.slot") * 7 + F.col("b.slot")) % 3).alias("n_a"), ((F.col("a.slot") + F.col("b.slot")) % 2).alias("n_b"), (F.col("a.slot") % 2).alias("n_tie"),
    )
    return evaluation.selected(c, votes, 3, 0.6).select("item", "branch", "slot")


_GOLD = [
    ("by region", "select n_regionkey, count(*) from nation group by n_regionkey"), ("names", "select r_name from region"), ("none", "select n_name from nation where n_nationkey < 0"), ("lost", None), ("broken", "select x from nation"),
]
_TRIED = [
    ("by region", 0, "select n_regionkey, count(n_name) from nation group by 1"), ("by region", 1, "select n_regionkey, 1 from nation"), ("by region", 2, "selec"), ("by region", 3, "drop table nation"),
    ("names", 0, "select r_name from region, nation where r_regionkey = n_regionkey"), ("names", 1, "select r_name from region limit 2"), ("names", 2, None), ("none", 0, "select n_name from nation where n_name is null"),
    ("lost", 0, "select 1"), ("broken", 0, "select n_name from nation"), ("names", 3, "select r_name from region limit 2"),
]


def _judged() -> str:
    """SQL that compares each text with its reference as a bag and as a set."""
    able = {"by region": (0, 1), "names": (0, 1, 3), "none": (0,), "lost": (), "broken": ()}
    parts = []
    for item, slot, text in _TRIED:
        gold = dict(_GOLD)[item]
        state = "missing_sql" if text is None else "empty_result" if item == "none" else "execution_error" if slot > 1 and slot not in able[item] else "success"
        if slot in able[item]:
            off = lambda way, a=text, b=gold: f"not exists (from (({a}) {way} ({b}))) and not exists (from (({b}) {way} ({a})))"
            parts.append(f"select '{item}' as item, {slot} as slot, '{state}' as state, true as comparable, {off('except all')} as bag_equal, {off('except')} as set_equal")
        else:
            parts.append(f"select '{item}', {slot}, '{state}', false, null, null")
    pool = "case when bool_or(coalesce(bag_equal, false)) over (partition by item) then 'has_match' when bool_or(bag_equal is null) over (partition by item) then 'unknown' else 'no_match' end as pool"
    return f"select *, {pool} from (" + " union all ".join(parts) + ")"


@query(_judged())
def offline_evaluation(spark, sf_dir):
    """Candidates against references, each distinct text run once, through the read-only guard."""
    views(spark, sf_dir, "nation region")
    folder = workspace(spark, "results")

    def run(text: str):
        done = runs.execute(spark, text, folder)
        return done.state, done.rows

    return evaluation.offline(spark, _GOLD, _TRIED, run, runs.COMPARABLE)


_RAW = [
    "so I think ```sql\nSELECT {}\n``` fits", "The answer. SQL: SELECT {}", "first ```select 0``` then ```SQL\nSELECT {}```", "we WITHOUT it select SELECT {}", 'SQL: "SELECT {}"', "no query {}",
]


@query("select conv_id, turn, case conv_id % 6 when 3 then 'select SELECT ' || conv_id when 5 then null else 'SELECT ' || conv_id end as sql from conversations")
def raw_sql_extract(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    raw = F.get(F.array(*[F.lit(r) for r in _RAW]), (F.col("conv_id") % len(_RAW)).cast("int"))
    return c.select("conv_id", "turn", T.raw_sql(F.replace(raw, F.lit("{}"), F.col("conv_id").cast("string"))).alias("sql"))


_SHAPES = [
    ('{"tables": [{"name": "t%", "columns": ["a", "b"]}]}', True), ('```json\n{"tables": [{"columns": [], "name": "t%"}]}\n```', True), ('{"tables": [{"name": "t%"}]}', False), ('{"tables": [{"name": %, "columns": []}]}', False),
    ('{"tables": [{"name": "t%", "columns": ["a"], "x": 1}]}', False), ('{"tables": [], "more": "t%"}', False), ("nothing t%", False), ('{"tables": [{"name": "t%", "columns": [1]}]}', False),
]


@query("select doc_id, case when doc_id % 8 < 2 then 't' || doc_id end as name, case doc_id % 8 when 0 then 'a,b' when 1 then '' end as columns from documents")
def json_selection_parse(spark, sf_dir):
    shape = F.get(F.array(*[F.lit(s) for s, _ in _SHAPES]), (F.col("doc_id") % len(_SHAPES)).cast("int"))
    read = table(spark, sf_dir, "documents").select("doc_id", T.selection(F.replace(shape, F.lit("%"), F.col("doc_id").cast("string"))).alias("s"))
    return read.select("doc_id", F.get("s", F.lit(0))["name"].alias("name"), F.array_join(F.get("s", F.lit(0))["columns"], ",").alias("columns"))


@query("""select item_id, 'SELECT  a FROM t WHERE b IS NOT DISTINCT FROM ''distinct ' || item_id || ''' AND ( c) > 1' as sql from benchmark""")
def distinct_removed(spark, sf_dir):
    text = F.concat(F.lit("SELECT DISTINCT a FROM t WHERE b IS NOT DISTINCT FROM 'distinct "), F.col("item_id").cast("string"), F.lit("' AND (distinct c) > 1"))
    return table(spark, sf_dir, "benchmark").select("item_id", T.without_distinct(text).alias("sql"))


@query("select p as query, min(n_name) as name, count(n_name) as n from (values ('*IN*'), ('united*'), ('*.a*'), ('C*A')) v(p) left join nation on regexp_full_match(lower(n_name), replace(replace(lower(p), '.', '\\.'), '*', '.*')) group by p")
def name_resolution_glob(spark, sf_dir):
    asked = spark.createDataFrame([("*IN*",), ("united*",), ("*.a*",), ("C*A",)], "query string")
    return evaluation.resolved_by_glob(asked, table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")))


@query("""with w as (select doc_id, lang, source, len(text) as n from documents) select lang, cast(count(*) as bigint) as n, round(avg(cast(2 as double) / 3), 6) as similarity, count(*) filter (doc_id % 2 = 0) as same from w group by lang""")
def skeleton_similarity(spark, sf_dir):
    """Queries of one shape are alike whatever their names; those of half the documents differ by one word."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    a = F.concat(F.lit("SELECT x"), F.col("doc_id").cast("string"), F.lit(" FROM t"))
    b = F.when(F.col("doc_id") % 2 == 0, F.lit("SELECT 'y' FROM u.v")).otherwise("SELECT y FROM u ORDER 12")
    both = d.select("lang", "doc_id", T.alike(T.skeleton(a), T.skeleton(b)).alias("s"), T.alike(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("fixed"))
    return both.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("fixed"), 6).alias("similarity"), F.count_if(F.col("s") == 1).alias("same"))


@query("select doc_id, lang, n, least(n, 5) as taken, n = 1 as alone from (select doc_id, lang, count(*) over (partition by lang) as n, row_number() over (partition by lang order by doc_id) as turn from documents) where turn <= 5")
def fair_turns(spark, sf_dir):
    """The first five turns of a round robin over languages."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    n = d.groupBy("lang").agg(F.count("*").alias("n"))
    return evaluation.fair_order(d, "lang", "doc_id").where("turn <= 5").join(n, "lang").select("doc_id", "lang", "n", F.least("n", F.lit(5)).alias("taken"), (F.col("n") == 1).alias("alone"))


@query("select l_orderkey, max(case when l_linenumber % 3 = 0 then l_linenumber end) as restored, max(l_linenumber) as last, case when bool_or(l_linenumber % 3 = 0) then 'restore' else 'retry' end as action from lineitem group by l_orderkey")
def attempts_restored(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("attempt"), (F.col("l_linenumber") % 3 == 0).alias("ok"))
    return evaluation.resumed(rows, ["l_orderkey"])


_TYPES = [("INTEGER", "number"), ("varchar(20)", "text"), ("TIMESTAMP", "time"), ("Decimal(10,2)", "number"), ("BLOB", "text"), ("double precision", "number"), ("birthdate", "time")]
_FLAGS = [("Yes", True), (" 0 ", False), ("", False), ("maybe", None), ("TRUE", True)]


@query("select n_nationkey, ['number', 'text', 'time', 'number', 'text', 'number', 'time'][n_nationkey % 7 + 1] as kind, [true, false, false, null, true][n_nationkey % 5 + 1] as is_key, lower(n_name) as bare, '\"' || n_name || '\"\"x\"' as quoted from nation")
def type_kinds(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    at = lambda values, k: F.get(F.array(*[F.lit(v) for v, _ in values]), (F.col("n_nationkey") % k).cast("int"))
    kind, key = T.kind_of_type(at(_TYPES, 7)), T.flag(at(_FLAGS, 5))
    return n.select("n_nationkey", kind.alias("kind"), key.alias("is_key"), T.bare_name(F.col("n_name")).alias("bare"), T.quoted_name(F.concat("n_name", F.lit('"x'))).alias("quoted"))


@query("""select item_id, case when item_id % 2 = 0 then 'About ' || item_id || chr(10) || '[Specification]' || chr(10) || 'one row' || chr(10) || '[/Specification]' || chr(10) || 'Question: which' else 'About ' || item_id || chr(10) || '[Specification]' || chr(10) || 'one row' || chr(10) || '[/Specification]' || chr(10) end as prompt,
    cast(1 as bigint) as blocks from benchmark""")
def specification_blocks(spark, sf_dir):
    """A block goes before the question, or to the end, and a second time nothing is put in."""
    plain = F.concat(F.lit("About "), F.col("item_id").cast("string"))
    prompt = F.when(F.col("item_id") % 2 == 0, F.concat(plain, F.lit("\nQuestion: which"))).otherwise(plain)
    once = table(spark, sf_dir, "benchmark").select("item_id", T.specified(T.specified(prompt, F.lit("one row")), F.lit("another")).alias("prompt"))
    return once.withColumn("blocks", F.regexp_count("prompt", F.lit(r"\[Specification\]")).cast("long"))


# What sinks write and sources read again.


@query("select n_nationkey, upper(n_name) as n_name, n_regionkey from nation where n_nationkey % 2 = 0 union all select n_nationkey, n_name, n_regionkey from nation where n_nationkey % 2 = 1")
def upserted_current(spark, sf_dir):
    path, rows = workspace(spark, "upsert"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    sinks.upsert(rows, path, 1)
    sinks.upsert(rows.where("n_nationkey % 2 = 0").withColumn("n_name", F.upper("n_name")), path, 2)
    return sinks.current(spark.read.parquet(path), ["n_nationkey"])


@query("select c_custkey, c_name from customer")
def appended_once(spark, sf_dir):
    path, rows = workspace(spark, "append"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    sinks.append_new(rows.where("c_custkey % 2 = 0"), path, ["c_custkey"])
    sinks.append_new(rows, path, ["c_custkey"])
    sinks.append_new(rows.withColumn("c_name", F.lit("other")), path, ["c_custkey"])
    return spark.read.parquet(path)


@query("select count(*) as n, cast(1 as bigint) as torn from orders")
def checksums_hold(spark, sf_dir):
    """Rows with checksums through a JSON file; one that is changed on the way is found."""
    path, rows = workspace(spark, "events"), sinks.checksummed(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey"))
    sinks.exclusive(rows, path)
    back = spark.read.schema(rows.schema).json(path)
    least = back.agg(F.min("o_orderkey").alias("k"))
    torn = back.join(F.broadcast(least), F.col("o_orderkey") == F.col("k"), "left").withColumn("o_orderstatus", F.when(F.col("k").isNotNull(), "?").otherwise(F.col("o_orderstatus"))).drop("k")
    return back.agg((F.count("*") - F.lit(0)).alias("n")).join(sinks.verified(torn).agg(F.count("*").alias("torn")))


@query("select cast(2 as bigint) as files, true as sealed, cast(1 as bigint) as changed")
def sealed_manifest(spark, sf_dir):
    """Length and SHA-256 of a package's files, held against a later look at them."""
    path = workspace(spark, "package")
    table(spark, sf_dir, "region").select("r_name").coalesce(1).write.text(f"{path}/a")
    table(spark, sf_dir, "nation").select("n_name").coalesce(1).write.text(f"{path}/b")
    look = lambda: sinks.seal(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path))
    sealed = spark.createDataFrame(look().collect(), look().schema)  # a row a file of one package
    table(spark, sf_dir, "nation").select("n_name").limit(3).coalesce(1).write.mode("overwrite").text(f"{path}/b")
    both = sealed.alias("x").join(look().alias("y"), "sha256", "left")
    return both.agg(F.count("*").alias("files"), F.bool_and(F.length("sha256") == 64).alias("sealed"), F.count_if(F.col("y.path").isNull()).alias("changed"))


@query("select s_suppkey, s_name, s_nationkey from supplier")
def json_lines_and_array(spark, sf_dir):
    """Half of the rows as JSON lines, half as one array, each read by its shape."""
    from ..sources import json_array, json_lines

    path, rows = workspace(spark, "json"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    rows.where("s_suppkey % 2 = 0").write.json(f"{path}/lines")
    whole = rows.where("s_suppkey % 2 = 1").agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))  # one file of a small catalog
    whole.coalesce(1).write.text(f"{path}/array")
    return json_lines(spark, f"{path}/lines", rows.schema, ["s_suppkey"]).union(json_array(spark, f"{path}/array", rows.schema, ["s_suppkey"]))


@query("select 'nation' as table_name, cast(n_nationkey as varchar) as original_column_name, trim(n_name) || chr(10) || 'é, \"x\"' as column_description from nation")
def metadata_csv_scan(spark, sf_dir):
    """Column descriptions with quotes, line ends and letters of Latin-1, from a file in that encoding, which is guessed."""
    from ..sources import described

    path = workspace(spark, "csv")
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("original_column_name"), F.concat(F.trim("n_name"), F.lit('\né, "x"')).alias("column_description"))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    text = F.concat(F.lit("original_column_name,column_description\n"), F.array_join(F.sort_array(F.collect_list(F.concat(quoted(F.col("original_column_name")), F.lit(","), quoted(F.col("column_description"))))), "\n"))
    rows.agg(text.alias("value")).coalesce(1).write.option("encoding", "ISO-8859-1").text(path)
    return described(spark, path).select(F.lit("nation").alias("table_name"), "original_column_name", "column_description")


@query("select l_orderkey, count(*) as n from lineitem group by l_orderkey")
def cached_query_result(spark, sf_dir):
    """The second call reads what the first has kept: its view is empty by then."""
    folder, text = workspace(spark, "cache"), "select l_orderkey, count(*) as n from cached_lines group by l_orderkey"
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("cached_lines")
    sinks.cached_result(spark, folder, "lines", text)
    table(spark, sf_dir, "lineitem").limit(0).createOrReplaceTempView("cached_lines")
    return sinks.cached_result(spark, folder, "lines", text)


@query("select r_regionkey, 'SELECT ''' || r_name || '''' as sql from region")
def exported_predictions(spark, sf_dir):
    path = workspace(spark, "export")
    sinks.export_texts(table(spark, sf_dir, "region").select("r_regionkey", F.concat(F.lit("SELECT '"), F.col("r_name"), F.lit("'")).alias("sql")), path, "r_regionkey", "sql")
    return spark.read.text(path).select(F.col("r_regionkey").cast("int").alias("r_regionkey"), F.col("value").alias("sql"))


@query("select count(*) as n, cast(sum(case when version = 2 then 1 else 0 end) as bigint) as of_second, true as complete from (select doc_id, 1 + doc_id % 2 as version from documents)")
def versioned_facts(spark, sf_dir):
    """Facts by version in an append-only store; a version is sealed only when every document has one."""
    path, d = workspace(spark, "facts"), table(spark, sf_dir, "documents").select("doc_id")
    for version in (1, 2):
        d.where(F.col("doc_id") % 2 == version - 1).withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").json(path)
    facts = spark.read.schema("doc_id long, version int").json(path)
    whole = evaluation.membership(facts.select("doc_id"), d, "doc_id").select(F.col("equal").alias("complete"))
    return facts.agg(F.count("*").alias("n"), F.count_if(F.col("version") == 2).alias("of_second")).join(whole)


@query("select 'manifest' as kind, count(*) as items, min(doc_id) as first_id, max(doc_id) as last_id from documents")
def snapshot_round_trip(spark, sf_dir):
    """A snapshot's manifest beside its items, and the items held against it."""
    path, d = workspace(spark, "snapshot"), table(spark, sf_dir, "documents").select("doc_id", "lang")
    d.write.json(f"{path}/items")
    d.agg(F.lit("manifest").alias("kind"), F.count("*").alias("items")).write.json(f"{path}/manifest")
    items, manifest = spark.read.schema(d.schema).json(f"{path}/items"), spark.read.schema("kind string, items long").json(f"{path}/manifest")
    found = items.agg(F.count("*").alias("items"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    return manifest.join(found, "items").select("kind", "items", "first_id", "last_id")


@query("select lang, doc_id, 'train_' || (row_number() over (order by doc_id) - 1) as example_id from documents where source is not null and text <> '' and doc_id % 3 = 0 qualify row_number() over (partition by lang order by doc_id) <= 4")
def training_examples(spark, sf_dir):
    """Examples that are whole, numbered over all, four of each language."""
    from ..operators.ranks import global_rank

    d = table(spark, sf_dir, "documents").where("source is not null and text <> '' and doc_id % 3 = 0").select("doc_id", "lang")
    numbered = global_rank(d, "doc_id").withColumn("example_id", F.concat(F.lit("train_"), (F.col("rank") - 1).cast("string")))
    return evaluation.fair_order(numbered, "lang", "doc_id").where("turn <= 4").select("lang", "doc_id", "example_id")


@query("select table_name, r as place, value from (select 'region' as table_name, r_name as value, row_number() over (order by r_regionkey) as r from region union all select 'nation', n_name, row_number() over (order by n_nationkey) from nation) where r <= 3")
def sample_context(spark, sf_dir):
    """The first three rows of each table by key, as context."""
    rows = lambda name, key, value: table(spark, sf_dir, name).orderBy(key).limit(3).select(F.lit(name).alias("table_name"), F.row_number().over(Window.orderBy(key)).cast("long").alias("place"), F.col(value).alias("value"))
    return profile.union_all([rows("region", "r_regionkey", "r_name"), rows("nation", "n_nationkey", "n_name")])


@query("select n_nationkey, n_name, upper(n_name) as loud from nation")
def sqlite_scan(spark, sf_dir):
    """A query that SQLite runs in a file of its own in the shared folder, read-only; a second that writes is refused."""
    import os
    import sqlite3

    folder = sqlite.plain(workspace(spark, "nation"))
    if "://" in folder:
        raise ValueError(f"SQLite can't open a file in {folder}")
    os.makedirs(folder)
    path = f"{folder}/nation.sqlite"
    with sqlite3.connect(path) as own:
        own.execute("create table nation (n_nationkey integer, n_name text)")
        own.executemany("insert into nation values (?, ?)", (tuple(r) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").toLocalIterator()))
    own.close()
    where = {"kind": "sqlite", "path": path}
    refused = runs.execute(spark, "insert into nation values (99, 'x')", workspace(spark, "sqlite"), where)
    done = runs.execute(spark, "select n_nationkey, n_name, upper(n_name) as loud from nation", workspace(spark, "sqlite"), where)
    if refused.state != "execution_error" or done.rows is None:
        raise ValueError(f"{refused.state}, {done.error}")
    return done.rows.toDF("n_nationkey", "n_name", "loud")


@query("select 'nation' as table_name, n_name as column_name, case when n_nationkey % 2 = 0 then 'int' else 'text' end as column_type, n_nationkey % 3 = 0 as primary_key, case when n_nationkey % 5 = 0 then 1 else 0 end as n_keys, 'Column Description: of ' || n_regionkey as description from nation")
def strict_metadata_scan(spark, sf_dir):
    """Metadata with types, flags and pairs of keys, written as CSV and read with all its checks."""
    path = workspace(spark, "strict")
    n = table(spark, sf_dir, "nation")
    rows = n.select(
        F.col("n_name").alias("original_column_name"), F.when(F.col("n_nationkey") % 2 == 0, "int").otherwise("text").alias("data_format"), F.when(F.col("n_nationkey") % 3 == 0, "Yes").otherwise("no").alias("primary_key"),
        F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit('[["region", "'), F.col("n_regionkey").cast("string"), F.lit('"]]'))).otherwise("").alias("foreign_keys"), F.concat(F.lit("of "), F.col("n_regionkey").cast("string")).alias("column_description"),
    )
    rows.coalesce(1).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    found = catalogs.strict_metadata(spark, path)
    return found.select(F.lit("nation").alias("table_name"), "column_name", "column_type", "primary_key", F.size("foreign_keys").alias("n_keys"), "description")


@query("select lower(n_name) as column_key, 'geo|T' || n_regionkey || '|' || n_name as source_key, 't' || n_regionkey as table_key, 'name ' || n_nationkey as description from nation")
def column_meaning_scan(spark, sf_dir):
    path = workspace(spark, "meanings")
    key = F.concat(F.lit("geo|T"), F.col("n_regionkey").cast("string"), F.lit("|"), F.col("n_name"))
    rows = table(spark, sf_dir, "nation").agg(F.map_from_entries(F.collect_list(F.struct(key, F.concat(F.lit("name "), F.col("n_nationkey").cast("string"))))).alias("m"))  # a small catalog's one object
    rows.select(F.to_json("m").alias("value")).coalesce(1).write.text(path)
    return catalogs.column_meanings(spark, path).select("column_key", "source_key", "table_key", "description")


@query("select 'r' || n_regionkey as table_name, n_name as column_name, case when n_nationkey % 2 = 0 then 'INT64' else 'STRING' end as column_type, 'about ' || n_nationkey as description, 'v' || n_nationkey as examples from nation")
def cloud_table_scan(spark, sf_dir):
    """A JSON file a table, its columns in lists and its rows as samples."""
    path = workspace(spark, "cloud")
    n = table(spark, sf_dir, "nation")
    own = F.sort_array(F.collect_list(F.struct("n_nationkey", F.col("n_name").alias("c"), F.when(F.col("n_nationkey") % 2 == 0, "INT64").otherwise("STRING").alias("k"))))
    lists = n.groupBy("n_regionkey").agg(own.alias("x")).select(
        F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("table_name"), F.concat(F.lit("geo.r"), F.col("n_regionkey").cast("string")).alias("table_fullname"),
        F.transform("x", lambda c: c["c"]).alias("column_names"), F.transform("x", lambda c: c["k"]).alias("column_types"), F.transform("x", lambda c: F.concat(F.lit("about "), c["n_nationkey"].cast("string"))).alias("description"),
        F.array(F.map_from_entries(F.transform("x", lambda c: F.struct(c["c"], F.concat(F.lit("v"), c["n_nationkey"].cast("string")))))).alias("sample_rows"),
    )
    lists.select("table_name", F.to_json(F.struct(*lists.columns)).alias("value")).withColumn("table", F.col("table_name")).select("table", "value").write.partitionBy("table").text(path)
    found = catalogs.cloud_tables(spark, path)
    return found.select("table_name", "column_name", "column_type", "description", F.array_join("value_examples", ",").alias("examples"))


@query("select c.conv_id as task_key, case when c.conv_id % 4 = 3 then 'missing_reference' when c.conv_id % 4 = 2 then 'duplicate_reference' else 'available' end as status, case when c.conv_id % 4 < 2 then 'select ' || c.conv_id end as sql from (select distinct conv_id from conversations) c")
def reference_bindings(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    bindings = c.select(F.col("conv_id").alias("task_key"), F.col("conv_id").cast("string").alias("external_id"), F.lit("db").alias("database_id"))
    one = c.where("conv_id % 4 < 3").select(F.col("conv_id").cast("string").alias("external_id"), F.lit("db").alias("database_id"), F.create_map(F.lit("sol_sql"), F.concat(F.lit('["select '), F.col("conv_id").cast("string"), F.lit('"]'))).alias("record"))
    return catalogs.references(bindings, one.union(one.where("cast(external_id as int) % 4 = 2"))).select("task_key", "status", "sql")


@query("select cast(r_regionkey as varchar) as file, r_name || chr(10) || 'second line' as text from region")
def external_documents(spark, sf_dir):
    path = workspace(spark, "documents")
    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("file"), F.concat("r_name", F.lit("\nsecond line")).alias("value"))
    rows.repartition("file").write.partitionBy("file").text(path)
    found = catalogs.whole_text(spark, path)
    return found.select(F.regexp_extract("path", "file=(\\d+)", 1).alias("file"), F.regexp_replace("text", "\\n$", "").alias("text"))


@query("select item_id as id, text from benchmark")
def knowledge_lines(spark, sf_dir):
    """JSON lines by an integer id, which may not repeat."""
    path, rows = workspace(spark, "knowledge"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    rows.write.json(path)
    return catalogs.json_records(spark, path, "id long, text string", ["id"])


@query("select upper(n_name) as name, cast(1 as bigint) as lines from nation where n_nationkey < 3")
def markdown_report(spark, sf_dir):
    """A small report as a Markdown table, a row a line."""
    text = sinks.markdown(table(spark, sf_dir, "nation").where("n_nationkey < 3").select(F.upper("n_name").alias("name"), F.lit(0.5).alias("share")))
    lines = spark.createDataFrame([(x,) for x in text.split("\n")[2:]], "line string")
    return lines.groupBy(F.regexp_extract("line", r"^\| (.+) \| 0\.50 \|$", 1).alias("name")).agg(F.count("*").alias("lines"))
