"""Queries by name, each with SQL that DuckDB runs to the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tagged
from ..functions.ddl import ParseDdl
from ..operators import catalog, compare, events, metrics, profile, schema_text, vectors, vote
from ..operators.ranks import global_rank
from ..sources import table, views
from ..streaming import first_seen, windowed
from . import lineage as lineages
from .sql import TEXTS, spelt

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _text(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = spelt(name, "spark")
        views(spark, sf_dir, text)
        return spark.sql(text)

    run.__name__ = name
    return run


for _name in TEXTS:
    QUERIES[_name], ORACLES[_name] = _text(_name), spelt(_name, "duckdb")


def _profile_sql(name: str, columns: str) -> str:
    return " union all ".join(f"select '{c}' as column_name, count({c}) as total_count, count(distinct {c}) as distinct_count, count(*) - count({c}) as null_count from {name}" for c in columns.split())


@query(_profile_sql("orders", "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority"))
def column_profile_orders(spark, sf_dir):
    return profile.column_profile(table(spark, sf_dir, "orders"))


@query(_profile_sql("customer", "c_custkey c_name c_nationkey c_acctbal c_mktsegment"))
def column_profile_customer(spark, sf_dir):
    return profile.column_profile(table(spark, sf_dir, "customer"))


_VALUES = "(select distinct column_name, value from (select 'p_name' as column_name, p_name as value from part union all select 'p_brand', p_brand from part union all select 'p_type', p_type from part) where length(value) between 1 and 100)"


@query(f"select column_name, value, cast(rank as int) as rank from (select *, row_number() over (partition by column_name order by md5(value), value) as rank from {_VALUES}) where rank <= 20")
def value_dictionary_md5_sample(spark, sf_dir):
    return profile.dictionary(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"], 20)


@query(rf"""select column_name, count(*) as n_values, case when bool_and(regexp_matches(value, '{profile.UUID}')) then 'uuid'
    when bool_and(regexp_matches(value, '{profile.NUMBER}')) then 'numeric' else 'collected' end as status
    from (select distinct column_name, value from (select 'page_id' as column_name, cast(page_id as varchar) as value from pages union all select 'url', url from pages) where length(value) between 1 and 100) group by column_name""")
def value_column_classification(spark, sf_dir):
    return profile.column_status(profile.values(table(spark, sf_dir, "pages"), ["page_id", "url"]))


_A = "select l_orderkey, l_linenumber, l_quantity from lineitem where l_discount >= 0.05"
_B = "select l_orderkey, l_linenumber, l_quantity from lineitem where l_discount > 0.04"


def _bag(a: str, b: str, keys: str, test: str) -> str:
    on = " and ".join(f"x.{k} is not distinct from y.{k}" for k in keys.split(", "))
    return f"with x as (select {keys}, count(*) as n from ({a}) group by {keys}), y as (select {keys}, count(*) as n from ({b}) group by {keys}), z as (select x.n as a, y.n as b from x full join y on {on}) select true as comparable, count(*) filter ({test}) = 0 as equal, count(*) filter ({test}) as n_differing from z"


def _two(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    views(spark, sf_dir, "lineitem")
    return spark.sql(_A), spark.sql(_B)


@query(_bag(_A, _B, "l_orderkey, l_linenumber, l_quantity", "a is distinct from b"))
def exec_bag_equal(spark, sf_dir):
    return compare.bag_equal(*_two(spark, sf_dir))


@query(_bag("select l_orderkey from lineitem", "select distinct l_orderkey from lineitem", "l_orderkey", "a is null or b is null"))
def exec_set_equal(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey")
    return compare.set_equal(rows, rows.distinct())


@query(_bag("select o_orderkey, o_orderstatus, row_number() over (order by o_orderkey) as r from orders", "select o_orderkey, o_orderstatus, row_number() over (order by o_orderdate, o_orderkey) as r from orders", "o_orderkey, o_orderstatus, r", "a is distinct from b"))
def exec_ordered_equal(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    place = lambda *key: global_rank(rows.withColumn("k", F.struct(*key)), "k").select("o_orderkey", "o_orderstatus", "rank")
    return compare.bag_equal(place("o_orderkey"), place("o_orderdate", "o_orderkey"))


#: Pairs of cells, and whether they are equal; null: they can't be compared.
_CASES = [
    ("double and integer", "1e15D", "1000000000000000L", True), ("double and decimal tenth", "0.1D", "0.1BD", False), ("double and decimal half", "0.5D", "0.5BD", True),
    ("decimals in the eleventh place", "0.12345678901BD", "0.12345678902BD", False), ("38 digits", "99999999999999999999999999999999999999BD", "99999999999999999999999999999999999999BD", True),
    ("boolean and binary", "true", "cast('true' as binary)", False), ("timestamps with and without a zone", "timestamp'2020-01-01'", "timestamp_ntz'2020-01-01'", False),
    ("not a number", "double('NaN')", "double('NaN')", None), ("arrays of integers and doubles", "array(1)", "array(1.0D)", True), ("arrays in another order", "array(1, 2)", "array(2, 1)", False),
    ("objects of any order", "named_struct('b', 1, 'a', null)", "named_struct('a', null, 'b', 1BD)", True), ("object and map", "named_struct('k', 'v')", "map('k', 'v')", True),
    ("signed zero", "-0.0D", "0", True), ("large power of two", "double('1267650600228229401496703205376')", "1267650600228229401496703205376BD", True),
    ("neighbours beyond 2**53", "9007199254740993L", "9007199254740992D", False), ("text and number", "'1'", "1", False), ("nulls", "null", "cast(null as int)", True),
    ("array that holds no number", "array(double('NaN'))", "array(1)", None), ("float and double tenth", "float('0.1')", "0.1D", False), ("binary", "X'00'", "X'00'", True),
]


@query("select * from (values " + ", ".join(f"('{n}', {'false' if w is None else 'true'}, {'cast(null as boolean)' if w is None else str(w).lower()})" for n, _, _, w in _CASES) + ") v(pair, comparable, equal)")
def exec_cell_equality(spark, sf_dir):
    each = [compare.bag_equal(spark.sql(f"select {a} as x"), spark.sql(f"select {b} as x")).select(F.lit(n).alias("pair"), "comparable", "equal") for n, a, b, _ in _CASES]
    return profile.union_all(each)


_MIXED = "l_orderkey, l_linenumber, l_quantity, l_shipdate"


@query(f"""with a as (select {_MIXED}, count(*) as n from lineitem group by all), b as (select {_MIXED}, count(*) as n from lineitem where l_linenumber <> 3 group by all)
    select true as comparable, count(*) filter (a.n is distinct from b.n) = 0 as equal, count(*) filter (a.n is distinct from b.n) as n_differing
    from a full join b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber and a.l_quantity = b.l_quantity and a.l_shipdate = b.l_shipdate""")
def exec_mixed_types_equal(spark, sf_dir):
    """One side's numbers are of other types, which doesn't matter, and a line number's rows are missing, which does."""
    rows = table(spark, sf_dir, "lineitem").select(*_MIXED.split(", "))
    other = rows.where("l_linenumber <> 3").select(F.col("l_orderkey").cast("decimal(30,4)"), F.col("l_linenumber").cast("double"), F.col("l_quantity").cast("decimal(20,6)"), "l_shipdate")
    return compare.bag_equal(rows, other)


#: A column as a multiset, whatever its order: its count, and the sum of 60 bits of each cell's MD5.
_CELLS = "select item, col, count(*) || ':' || cast(sum(cast(('0x' || substr(md5(cell), 1, 15)) as bigint)) as varchar) as h from cells group by item, col"
_E4 = f"""with cells as (
    select 'by_nation' as item, 0 as col, printf('%.2f', cast(s_nationkey as double)) as cell from supplier union all select 'by_nation', 1, printf('%.2f', round(s_acctbal, 2)) from supplier
    union all select 'swapped', 0, printf('%.2f', round(s_acctbal, 2)) from supplier union all select 'swapped', 1, printf('%.2f', cast(s_nationkey as double)) from supplier
    union all select 'keys', 0, printf('%.2f', cast(s_suppkey as double)) from supplier union all select 'keys', 1, printf('%.2f', cast(s_nationkey as double)) from supplier),
  h as ({_CELLS}), i as (select item, sha256(string_agg(h, ',' order by h)) as result_hash from h group by item)
  select result_hash, count(*) as n_items, min(item) as first_item from i group by result_hash"""


@query(_E4)
def exec_spider2_hash_groups(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    two = lambda c: F.format_string("%.2f", F.coalesce(F.round(F.col(c).cast("double"), 2), F.lit(0.0)))
    shape = lambda item, cols: s.select(F.lit(item).alias("item"), F.explode(F.array(*[F.struct(F.lit(i).alias("col"), two(c).alias("cell")) for i, c in enumerate(cols)])).alias("x")).select("item", "x.*")
    cells = profile.union_all([shape("by_nation", ["s_nationkey", "s_acctbal"]), shape("swapped", ["s_acctbal", "s_nationkey"]), shape("keys", ["s_suppkey", "s_nationkey"])])
    bits = F.conv(F.substring(F.md5(F.col("cell").cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    per = cells.groupBy("item", "col").agg(F.concat_ws(":", F.count("*").cast("string"), F.sum(bits).cast("string")).alias("h"))
    whole = F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ","), 256)  # a hash a column
    return per.groupBy("item").agg(whole.alias("result_hash")).groupBy("result_hash").agg(F.count("*").alias("n_items"), F.min("item").alias("first_item"))


@query("""with items as (select r_regionkey as item from region), r as (select n_regionkey as item, case when n_regionkey = 1 then null else n_name end as v, 1 as has_row from nation where n_regionkey <> 0)
    select i.item, count(has_row) as n_rows, case when count(has_row) = 0 then 'empty_result' when count(v) = 0 then 'all_null_result' else 'success' end as status from items i left join r on r.item = i.item group by i.item""")
def exec_status_classify(spark, sf_dir):
    n = table(spark, sf_dir, "nation").where("n_regionkey <> 0").select(F.col("n_regionkey").alias("item"), F.when(F.col("n_regionkey") != 1, F.col("n_name")).alias("v"), F.lit(1).alias("has_row"))
    return compare.result_status(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("item")).join(n, "item", "left"), "item", ["v"])


_SLOTS = "select source as item, doc_id as slot, case when length(text) > 200 then substr(md5(text), 1, 1) end as result_hash from documents"


@query(f"""with v as ({_SLOTS}), c as (select item, result_hash, min(slot) as representative, count(*) as cluster_size from v where result_hash is not null group by item, result_hash)
    select item, representative, cluster_size, cluster_size / sum(cluster_size) over (partition by item) as score, cast(row_number() over (partition by item order by cluster_size desc, representative) as int) as rank from c""")
def vote_consistency_shortlist(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    seen = F.when(F.length("text") > 200, F.substring(F.md5("text"), 1, 1))
    return vote.consistency(d.select(F.col("source").alias("item"), F.col("doc_id").alias("slot"), seen.alias("result_hash")))


_VOTES = """select a.event_type as item, a.g as a, b.g as b, a.n as n_a, b.n as n_b, 1 as n_tie from (select event_type, user_id % 5 as g, count(*) as n from events group by all) a
    join (select event_type, user_id % 5 as g, count(*) as n from events group by all) b on a.event_type = b.event_type and a.g < b.g"""


@query(f"""with v as ({_VOTES}), s as (select item, a as candidate, (n_a + 0.5::double * n_tie) / (n_a + n_b + n_tie) as w from v union all select item, b, (n_b + 0.5::double * n_tie) / (n_a + n_b + n_tie) from v),
    g as (select item, candidate, sum(w) as w from s group by item, candidate), r as (select item, candidate, w / count(*) over (partition by item) as win_rate from g)
    select item, candidate, round(win_rate, 6) as win_rate, cast(row_number() over (partition by item order by round(win_rate, 9) desc, candidate) as int) as rank from r""")
def vote_pairwise_ranking(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("item"), (F.col("user_id") % 5).alias("g")).agg(F.count("*").alias("n"))
    a, b = g.select("item", F.col("g").alias("a"), F.col("n").alias("n_a")), g.select("item", F.col("g").alias("b"), F.col("n").alias("n_b"))
    return vote.pairwise_ranking(a.join(b, "item").where("a < b").withColumn("n_tie", F.lit(1))).withColumn("win_rate", F.round("win_rate", 6))


def _assessed(spark, sf_dir) -> DataFrame:
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(l, "doc_id", "left").select("doc_id", "lang", "source", "n_chars", (F.col("quality") == 1).alias("native"), (F.col("toxic") == 0).alias("variant"))


_ASSESSED = "(select d.doc_id, d.lang, d.source, d.n_chars, l.quality = 1 as native, l.toxic = 0 as variant from documents d left join labels l on d.doc_id = l.doc_id)"
_LABEL = "case when native is null or variant is null then 'unknown' when not native and variant then 'repair' when native and not variant then 'harm' when native then 'unchanged_correct' else 'unchanged_incorrect' end"


@query(f"select {_LABEL} as label, count(*) as n, cast(sum(n_chars) as bigint) as chars from {_ASSESSED} group by 1")
def transition_labels(spark, sf_dir):
    return _assessed(spark, sf_dir).groupBy(metrics.transition("native", "variant").alias("label")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(f"""select lang, case when bool_or(native) then true when count(*) > count(native) then null else false end as native, case when bool_or(native) then 'has_match' when count(*) > count(native) then 'unknown' else 'no_match' end as state
    from {_ASSESSED} group by lang""")
def kleene_pool(spark, sf_dir):
    return _assessed(spark, sf_dir).groupBy("lang").agg(metrics.kleene_or("native").alias("native"), metrics.pool_state("native").alias("state")).select("lang", "native", "state")


_GAINS = f"(select source, count(*) filter (not native and variant) as gains, count(*) filter (native and not variant) as losses from {_ASSESSED} group by source)"
_P = "least(1.0, 2 * list_sum(list_transform(range(0, least(gains, losses) + 1), lambda i: exp(lgamma(gains + losses + 1) - lgamma(i + 1) - lgamma(gains + losses - i + 1) - (gains + losses) * ln(2)))))"


@query(f"select source, gains, losses, round(case when gains + losses = 0 then 1.0 else {_P} end, 8) as p from {_GAINS}")
def paired_gain_loss_mcnemar(spark, sf_dir):
    found = _assessed(spark, sf_dir).groupBy("source").agg(F.count_if(~F.col("native") & F.col("variant")).alias("gains"), F.count_if(F.col("native") & ~F.col("variant")).alias("losses"))
    return found.withColumn("p", F.round(metrics.mcnemar("gains", "losses"), 8))


@query("""with p as (select lang, count(*) as n, 1.0::double / (1 + sum(n_chars) % 97) as p from documents group by lang), s as (select *, least(1.0, p * (count(*) over () - row_number() over (order by p, lang) + 1)) as step from p)
    select lang, n, round(p, 8) as p, round(max(step) over (order by p, lang rows unbounded preceding), 8) as holm from s""")
def holm_adjusted(spark, sf_dir):
    p = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), (F.lit(1.0) / (1 + F.sum("n_chars") % 97)).alias("p"))
    return metrics.holm(p, "p", ["lang"]).select("lang", "n", F.round("p", 8).alias("p"), F.round("holm", 8).alias("holm"))


_SETS = r"""(select item_id, list_distinct(string_split(lower(text), ' ')) as gold, list_distinct(list_filter(string_split(lower(text), ' '), lambda x: length(x) % 2 = 0) || ['the']) as found from benchmark)"""


@query(f"""with s as (select item_id, len(list_intersect(gold, found)) as tp, len(found) - len(list_intersect(gold, found)) as fp, len(gold) - len(list_intersect(gold, found)) as fn from {_SETS})
    select item_id, tp, fp, fn, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1, fp = 0 and fn = 0 as exact, fn = 0 as full_recall from s""")
def set_metrics(spark, sf_dir):
    return _set_scores(spark, sf_dir).select("item_id", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "exact", "full_recall")


def _set_scores(spark, sf_dir) -> DataFrame:
    words = F.array_distinct(F.split(F.lower("text"), " "))
    b = table(spark, sf_dir, "benchmark").select("item_id", words.alias("gold"))
    return metrics.set_scores(b.withColumn("found", F.array_distinct(F.concat(F.filter("gold", lambda x: F.length(x) % 2 == 0), F.array(F.lit("the"))))), "gold", "found")


@query(f"""with s as (select item_id, len(list_intersect(gold, found)) as tp, len(found) - len(list_intersect(gold, found)) as fp, len(gold) - len(list_intersect(gold, found)) as fn from {_SETS})
    select round(sum(tp) / (sum(tp) + sum(fp)), 6) as micro_precision, round(sum(tp) / (sum(tp) + sum(fn)), 6) as micro_recall, round(avg(tp / (tp + fp)), 6) as macro_precision, round(avg(tp / (tp + fn)), 6) as macro_recall, count(*) as n from s""")
def set_metrics_micro_macro(spark, sf_dir):
    s = F.sum
    return _set_scores(spark, sf_dir).agg(
        F.round(s("tp") / (s("tp") + s("fp")), 6).alias("micro_precision"), F.round(s("tp") / (s("tp") + s("fn")), 6).alias("micro_recall"),
        F.round(F.avg("precision"), 6).alias("macro_precision"), F.round(F.avg("recall"), 6).alias("macro_recall"), F.count("*").alias("n"),
    )


@query("""with s as (select user_id, avg(value) as mu, stddev_pop(value) as sd from events group by user_id)
    select e.user_id, count(*) as n, round(avg(value) + 1e-9, 4) as trimmed_mean from events e join s on e.user_id = s.user_id where abs(value - mu) <= 3 * sd + 1e-12 group by e.user_id""")
def trimmed_mean_3sigma(spark, sf_dir):
    return metrics.trimmed(table(spark, sf_dir, "events"), "user_id", "value").withColumn("trimmed_mean", F.round(F.col("trimmed_mean") + 1e-9, 4))


@query()
def bootstrap_ratio_ci(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("words", F.size(F.split("text", " ")))
    return metrics.bootstrap_ratio(d, "lang", "words", "n_chars", rounds=200)


@query("select conv_id, max(turn) as turn, arg_max(role, turn) as role, arg_max(md5(text), turn) as text_hash from conversations group by conv_id")
def latest_version_per_key(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.md5("text").alias("text_hash"))
    return events.latest(c, ["conv_id"], ["turn"])


@query("select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) where r = 1")
def last_write_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return events.latest(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("select o_custkey, coalesce(max(o_orderkey), 0) + 1 as next_no from orders group by o_custkey")
def next_attempt_no(spark, sf_dir):
    return events.next_number(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


@query("select event_id, user_id, count(*) over (partition by user_id order by cast(floor(epoch(ts)) as bigint) range between 3599 preceding and current row) as n_recent from events")
def sliding_window_count(spark, sf_dir):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return events.trailing_count(table(spark, sf_dir, "events").withColumn("s", seconds), "user_id", F.col("s"), 3600).select("event_id", "user_id", "n_recent")


@query("select event_type, n, k, opened from (select event_type, count(*) over (partition by event_type) as n, row_number() over (partition by event_type order by ts, event_id) as k, event_id as opened from events) where k = ceil(0.95 * n)")
def cohort_gate(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "ts", "event_id")
    return events.gate(e, "event_type", "ts", "event_id", 0.95).join(e.select("event_type", F.col("ts").alias("opened"), "event_id"), ["event_type", "opened"]).groupBy("event_type", "n", F.col("k").cast("long").alias("k")).agg(F.min("event_id").alias("opened"))


@query("""select v.user_id, count(*) as requests, count(*) filter (not exists (select 1 from events c where c.user_id = v.user_id and c.event_type = 'click' and c.ts > v.ts)) as unanswered from events v where v.event_type = 'view' group by v.user_id""")
def request_ledger_unanswered(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = e.where("event_type = 'click'").groupBy("user_id").agg(F.max("ts").alias("last_click"))
    v = e.where("event_type = 'view'").join(last, "user_id", "left")
    open_ = F.col("last_click").isNull() | (F.col("last_click") <= F.col("ts"))
    return v.groupBy("user_id").agg(F.count("*").alias("requests"), F.count_if(open_).alias("unanswered"))


_KNN = "list_cosine_similarity(cast(e.embedding as double[]), cast(q.qv as double[]))"


def _asked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The vectors whose vec_id is divisible by 20, and all vectors."""
    e = table(spark, sf_dir, "embeddings")
    return e.where("vec_id % 20 = 0"), e


_ASK = "(select label as query_label, vec_id as query_id, embedding as qv from embeddings where vec_id % 20 = 0)"


@query(f"""select query_id, vec_id, round(s, 5) as score, cast(rank as int) as rank from (
    select *, row_number() over (partition by query_id order by round(s, 6) desc, vec_id) as rank from (
      select q.query_id, e.vec_id, {_KNN} as s from embeddings e, {_ASK} q where e.vec_id <> q.query_id)) where rank <= 10""")
def knn_topk_cosine(spark, sf_dir):
    found = vectors.nearest_cosine(*_asked(spark, sf_dir), 10)
    return found.select("query_id", "vec_id", F.round("score", 5).alias("score"), "rank")


@query(f"""select query_id, vec_id, round(s, 5) as score, cast(rank as int) as rank from (
    select *, row_number() over (partition by query_id order by round(s, 6) desc, vec_id) as rank from (
      select q.query_id, e.vec_id, 0.7 * {_KNN} + 0.3 * (1.0 / (1 + abs(e.vec_id - q.query_id))) as s from embeddings e, {_ASK} q where e.label <> q.query_label)) where rank <= 5""")
def dual_vector_retrieval_excluding_db(spark, sf_dir):
    found = vectors.nearest_combined(*_asked(spark, sf_dir), 5)
    return found.select("query_id", "vec_id", F.round("score", 5).alias("score"), "rank")


_EUC = "list_distance(cast(e.embedding as double[]), cast(q.qv as double[]))"


@query(f"""select query_id, vec_id, qualified, round(s, 5) as distance, cast(rank as int) as rank from (
    select *, row_number() over (partition by query_id order by qualified desc, round(s, 6), vec_id) as rank from (
      select q.query_id, e.vec_id, e.label = q.query_label as qualified, {_EUC} as s from embeddings e, {_ASK} q where e.vec_id <> q.query_id)) where rank <= 5""")
def euclid_second_round_preferred(spark, sf_dir):
    found = vectors.nearest_preferred(*_asked(spark, sf_dir), 5)
    return found.select("query_id", "vec_id", "qualified", F.round("distance", 5).alias("distance"), "rank")


@query(f"""select q.query_id, e.label, round(min(1 - {_KNN}), 5) as distance, min(1 - {_KNN}) < 0.7 as linked
    from embeddings e, {_ASK} q where e.vec_id <> q.query_id group by q.query_id, e.label""")
def value_linker_threshold(spark, sf_dir):
    found = vectors.least_by(*_asked(spark, sf_dir), lambda x: x[1], by_query=True)
    return found.select(F.col("key").alias("query_id"), F.col("value").cast("int").alias("label"), F.round("distance", 5).alias("distance"), (F.col("distance") < 0.7).alias("linked"))


@query(f"""select label, value, round(distance, 5) as distance, cast(rank as int) as rank from (
    select *, row_number() over (partition by label order by distance, value) as rank from (
      select e.label, e.vec_id % 50 as value, min(round(1 - {_KNN}, 6)) as distance from embeddings e, {_ASK} q where e.vec_id <> q.query_id group by 1, 2)) where rank <= 5""")
def knn_join_merge_dedupe(spark, sf_dir):
    found = vectors.least_by(*_asked(spark, sf_dir), lambda x: x[0] % 50, by_query=False)
    found = found.select(F.col("key").cast("int").alias("label"), "value", vectors.rounded("distance", 6).alias("distance"))
    return vectors.merged(found, ["label"], "value", "distance", 5).withColumn("distance", vectors.rounded("distance", 5))


_COLUMNS = [("a", "id", True), ("a", "name", False), ("a", "b_id", False), ("b", "id", True), ("b", "v", False), ("c", "ID", True), ("c", "V", False), ("d", "x", True)]
_FKS = [("a", "b_id", "b", "id"), ("b", "v", "z", "id"), ("c", "V", "a", "id")]
_PICKED = [("a", "name"), ("a", "b_id"), ("b", "v"), ("b", "id"), ("d", "x")]
_rows = lambda rows: ", ".join(str(tuple(r)).replace("True", "true").replace("False", "false") for r in rows)
_WITH = f"with columns_ as (select * from (values {_rows(_COLUMNS)}) v(table_name, column_name, is_pk)), fks as (select * from (values {_rows(_FKS)}) v(table_name, column_name, ref_table, ref_column)), picked as (select * from (values {_rows(_PICKED)}) v(table_name, column_name)) "


def _catalog(spark) -> tuple[DataFrame, DataFrame, DataFrame]:
    return spark.createDataFrame(_COLUMNS, "table_name string, column_name string, is_pk boolean"), spark.createDataFrame(_FKS, "table_name string, column_name string, ref_table string, ref_column string"), spark.createDataFrame(_PICKED, "table_name string, column_name string")


@query(_WITH + "select f.*, exists (select 1 from columns_ c where c.table_name = f.table_name and c.column_name = f.column_name) and exists (select 1 from columns_ c where c.table_name = ref_table and c.column_name = ref_column) as resolved from fks f")
def fk_edges(spark, sf_dir):
    columns, fks, _ = _catalog(spark)
    return catalog.fk_edges(fks, columns)


@query(_WITH + "select p.table_name, p.column_name, coalesce((select string_agg(ref_table || '.' || ref_column, '; ' order by ref_table) from fks f where f.table_name = p.table_name and f.column_name = p.column_name and exists (select 1 from picked x where x.table_name = ref_table and x.column_name = ref_column)), '') as ref_key from picked p")
def schema_crop_strict(spark, sf_dir):
    columns, fks, picked = _catalog(spark)
    return catalog.crop_strict(columns, picked, fks)


@query(_WITH + ", t as (select distinct table_name from picked), e as (select f.* from fks f where table_name in (select * from t) and ref_table in (select * from t)) select table_name, column_name from picked union select table_name, column_name from columns_ where is_pk and table_name in (select * from t) union select table_name, column_name from e union select ref_table, ref_column from e")
def schema_crop_fk_closed(spark, sf_dir):
    columns, fks, picked = _catalog(spark)
    return catalog.crop_closed(columns, picked, fks)


@query(_WITH + ", s as (select table_name, string_agg(lower(column_name), '||' order by lower(column_name)) as signature from columns_ group by table_name) select signature, count(*) as n_tables, string_agg(table_name, ',' order by table_name) as tables from s group by signature having count(*) > 1")
def catalog_signature_groups(spark, sf_dir):
    return catalog.signature_groups(_catalog(spark)[0])


@query("select * from (values ('b', 'b', 'resolved'), ('ID', 'ID', 'resolved'), ('Id', null, 'ambiguous'), (' v ', null, 'ambiguous'), ('nope', null, 'missing'), ('NAME ', 'name', 'resolved')) v(query, name, status)")
def name_resolution_cascade(spark, sf_dir):
    names = spark.createDataFrame([("id",), ("ID",), ("name",), ("v",), ("V",), ("b",)], "name string")
    asked = spark.createDataFrame([("b",), ("ID",), ("Id",), (" v ",), ("nope",), ("NAME ",)], "query string")
    return catalog.resolve(asked, names)


@query("select n.n_nationkey, n.n_name, count(d.r_regionkey) as n_regions from nation n left join region d on contains(lower(n.n_name), lower(substr(d.r_name, 1, 2))) group by n.n_nationkey, n.n_name")
def containment_theta_join(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    hit = F.contains(F.lower("n_name"), F.lower(F.substring("r_name", 1, 2)))
    return n.join(F.broadcast(r.select("r_regionkey", "r_name")), hit, "left").groupBy("n_nationkey", "n_name").agg(F.count("r_regionkey").alias("n_regions"))


@query("with e as (select user_id, event_type, list(value order by ts, event_id) as v from events group by user_id, event_type), x as (select user_id, unnest(range(1, len(v) + 1)) as slot, unnest(v) as value, event_type from e where event_type in ('view', 'click')) select coalesce(a.user_id, b.user_id) as user_id, cast(coalesce(a.slot, b.slot) as int) as slot, a.value as before_value, b.value as after_value from (select * from x where event_type = 'view') a full join (select * from x where event_type = 'click') b on a.user_id = b.user_id and a.slot = b.slot")
def slot_aligned_before_after(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type in ('view', 'click')")
    v = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"])
    each = e.groupBy("user_id", "event_type").agg(v.alias("v")).select("user_id", "event_type", F.posexplode("v").alias("slot", "value")).withColumn("slot", F.col("slot") + 1)
    side = lambda kind, name: each.where(F.col("event_type") == kind).select("user_id", "slot", F.col("value").alias(name))
    return side("view", "before_value").join(side("click", "after_value"), ["user_id", "slot"], "full")


@query("select doc_id, count(*) as copies from documents group by doc_id")
def streaming_first_seen(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id")
    return first_seen(rows, ["doc_id"]).join(rows.groupBy("doc_id").agg(F.count("*").alias("copies")), "doc_id")


@query("select event_type, cast(epoch(time_bucket(interval '1 hour', ts)) as bigint) as start_s, count(*) as n, round(sum(value), 4) as value from events group by 1, 2")
def streaming_window_totals(spark, sf_dir):
    return windowed(table(spark, sf_dir, "events")).select("event_type", F.unix_seconds("start").alias("start_s"), "n", F.round("value", 4).alias("value"))


@query()
def ddl_columns(spark, sf_dir):
    spark.udtf.register("parse_ddl", ParseDdl)
    text = "CREATE TABLE t (id INT NOT NULL, price DECIMAL(10, 2), name VARCHAR(20) DEFAULT 'x', PRIMARY KEY (id)); create table if not exists \"u\" (a text, FOREIGN KEY (a) REFERENCES t(id))"
    spark.createDataFrame([(text,)], "ddl string").createOrReplaceTempView("ddl_texts")
    return spark.sql("select x.* from ddl_texts, lateral parse_ddl(ddl) x")


@query("""select * from (values ('customer', 'c_custkey'), ('customer', 'c_nationkey'), ('lineitem', 'l_discount'), ('lineitem', 'l_extendedprice'), ('lineitem', 'l_orderkey'),
    ('nation', 'n_name'), ('nation', 'n_nationkey'), ('orders', 'o_custkey'), ('orders', 'o_orderkey')) v(table_name, column_name)""")
def lineage_columns(spark, sf_dir):
    text = spelt("region_revenue", "spark")
    views(spark, sf_dir, text)
    return spark.createDataFrame(lineages.lineage(spark.sql(text)), "table_name string, column_name string")


_SCOPED = [
    ("with a as (select * from orders), b as (select * from a) select * from b join nation on exists (select 1 from a, region)", "nation,orders,region"),
    ("select * from (select * from part) p, supplier", "part,supplier"), ("select 1", ""),
]


@query("select * from (values " + ", ".join(f"('{q}', '{t}')" for q, t in _SCOPED) + ") v(sql, tables)")
def physical_tables(spark, sf_dir):
    return spark.createDataFrame([(q, ",".join(lineages.tables(spark, q))) for q, _ in _SCOPED], "sql string, tables string")


#: Texts, and what of them is in nation (n_name, n_regionkey): status, reason, shares of tables and columns.
_LINKED = [
    ("select n_name from nation", "available", None, 1.0, 1.0), ("select n.n_name, r.r_name from nation n join region r on n.n_regionkey = r.r_regionkey", "available", None, 0.5, 0.5),
    ("select * from nation", "unknown", "unresolved_or_wildcard_column", 1.0, None), ("select n_name from nation join region using (x)", "unknown", "implicit_join_columns_unresolved", 0.5, None),
    ("with a as (select 1 x) select x from a", "unknown", "unresolved_query_lineage", None, None), ("select a from x.y", "unknown", "schema_qualified_table_unresolved", None, None),
    ("select n_name as k from nation order by k", "unknown", "unresolved_or_wildcard_column", 1.0, None), ("values (1)", "unknown", "unsupported_query_structure", None, None), ("selec", "unknown", "parse_unavailable", None, None),
]
_sql = lambda x: "null" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


@query("select sql, status, reason, cast(table_coverage as double) as table_coverage, cast(column_coverage as double) as column_coverage from (values " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in _LINKED) + ") v(sql, status, reason, table_coverage, column_coverage)")
def schema_coverage(spark, sf_dir):
    linked = {"nation": ["n_name", "n_regionkey"]}
    made = [(r[0], *(lineages.coverage(spark, r[0], linked)[c] for c in ("status", "reason", "table_coverage", "column_coverage"))) for r in _LINKED]
    return spark.createDataFrame(made, "sql string, status string, reason string, table_coverage double, column_coverage double")


_READS = [
    "select 1", "with a as (select 1) select * from a", "values (1), (2)", "select a from t union all select b from u except select c from v", "table t", "from t select a",
    "select * from t pivot (sum(x) for y in (1, 2))", "select * from t lateral view explode(a) x as y", "select a, count(*) over (partition by b) from t having a > 1",
]
_CHANGES = [
    "drop table t", "insert into t values (1)", "select 1; select 2", "create table t as select 1", "load data inpath ''/x'' into table t", "analyze table t compute statistics", "msck repair table t",
    "refresh table t", "comment on table t is ''x''", "alter table t rename to u", "alter table t add columns (x int)", "alter table t set tblproperties (''a''=''b'')", "uncache table t", "set var x = 1",
    "execute immediate ''drop table t''", "begin drop table t; end", "call p()", "show tables", "describe t", "select reflect(''java.lang.System'', ''exit'', 1)", "truncate table t", "delete from t",
    "merge into t using u on t.a = u.a when matched then delete", "update t set a = 1", "use x", "from t insert into u select a", "insert overwrite directory ''/x'' using parquet select 1", "selec",
]


@query("select * from (values " + ", ".join(f"('{t}', {x})" for x, texts in (("true", _READS), ("false", _CHANGES)) for t in texts) + ") v(sql, read_only)")
def read_only_guard(spark, sf_dir):
    texts = [t.replace("''", "'") for t in _READS + _CHANGES]
    return spark.createDataFrame([(t, lineages.read_only(spark, t)) for t in texts], "sql string, read_only boolean")


@query("select conv_id, turn, 'SELECT ' || conv_id as answer from conversations")
def tagged_sql_extract(spark, sf_dir):
    wrapped = F.concat(F.lit("noise <result>```sql SELECT "), F.col("conv_id").cast("string"), F.lit("```</result> tail"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tagged(wrapped, "result").alias("answer"))


_PROFILE = """Database ID: `a`
Database Type: SQLITE
Schema:
- Table: `s`
[
(`id`: int | Primary Key | the key | Value Statistics: 0 NULL values, 2 distinct values, 2 total values | Value Examples: ['1', '2']),
(`t_id`: int)
]
Nested Fields (accessible via UNNEST):
  - id.part: string
- Table: `t`
[
(`id`: int | Primary Key)
]
  [Note: The following 1 tables have IDENTICAL schema structure as `t` above:
  `u`
  You can query any of these tables using the same column structure.]

Foreign Keys:
`s`.`t_id` = `t`.`id`"""


_SHORTER = _PROFILE.replace(" | Value Statistics: 0 NULL values, 2 distinct values, 2 total values | Value Examples: ['1', '2']", "")
_FLAT = _SHORTER.replace("Nested Fields (accessible via UNNEST):\n  - id.part: string\n", "")
_BUDGETS = [len(t.strip()) // 4 for t in (_PROFILE, _SHORTER, _FLAT, _FLAT.replace(" | the key", ""))] + [10]
_told = lambda text: "null" if text is None else "'" + text.replace("'", "''") + "'"


@query("select 'a' as db_id, cast(lvl as int) as level, profile from (values " + ", ".join(f"({i}, {_told(t)})" for i, t in ((0, _PROFILE), (1, _SHORTER), (2, _FLAT), (3, _FLAT.replace(" | the key", "")), (4, None))) + ") v(lvl, profile)")
def schema_profile_levels(spark, sf_dir):
    """The text at each level, by budgets that fit just that one."""
    names = "db_id string, table_name string, ordinal int, column_name string, data_type string, is_pk boolean, description string, null_count int, distinct_count int, total_count int, value_examples array<string>"
    rows = [
        ("a", "s", 0, "t_id", "int", False, None, None, None, None, None), ("a", "s", 1, "id", "int", True, "the key", 0, 2, 2, ["1", "2"]), ("a", "s", 2, "old", "int", False, "Value Description: unuseful", None, None, None, None),
        ("a", "t", 0, "id", "int", True, "", None, None, None, []), ("a", "u", 0, "ID", "int", True, None, None, None, None, None),
    ]
    fks = spark.createDataFrame([("a", "s", "t_id", "t", "id"), ("a", "s", "old", "t", "id"), ("a", "s", "id", "z", "id")], "db_id string, table_name string, column_name string, ref_table string, ref_column string")
    columns = spark.createDataFrame(rows, names)
    nested = spark.createDataFrame([("a", "s", "id.part", "string")], "db_id string, table_name string, name string, data_type string")
    return profile.union_all([schema_text.fitting(columns, fks, most, nested) for most in _BUDGETS])
