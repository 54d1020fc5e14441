"""Queries of the reports, over documents in languages (groups) and sources (questions): a label of quality is one condition's
match, of toxicity the other's, and an unlabelled document is unknown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, reports
from ..sources import table
from .registry import query

_ROWS = "(select d.doc_id, d.lang, d.source, d.n_chars, d.text, l.quality = 1 as base, l.toxic = 0 as variant from documents d left join labels l on l.doc_id = d.doc_id)"
_CELLS = f"""cells as (select lang as grp, source as question, 'native' as mode, doc_id as slot, base as match, case when doc_id % 50 <> 0 then n_chars end as tokens from {_ROWS}
      union all select lang, source, 'variant', doc_id, variant, floor(n_chars / 2.0) from {_ROWS}),
    q as (select grp, question, mode, count(*) as n, count(match) as known, count(*) filter (match) as matched, case when count(*) filter (match) > 0 then true when count(match) < count(*) then null else false end as covered,
      first(match order by slot) as final, list(slot order by slot) filter (match) as examples, case when count(*) = count(tokens) then sum(tokens) end as tokens from cells group by grp, question, mode),
    p as (select q.*, b.n as base_n, b.known as base_known, b.matched as base_matched, b.covered as base_covered, b.final as base_final, b.examples as base_examples
      from q join q b on b.grp is not distinct from q.grp and b.question is not distinct from q.question and b.mode = 'native')"""


def _paired(spark, sf_dir) -> DataFrame:
    l = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("base"), (F.col("toxic") == 0).alias("variant"))  # noqa: E741
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text").join(l, "doc_id", "left")


def _cells(spark, sf_dir) -> DataFrame:
    tokens = F.when(F.col("doc_id") % 50 != 0, F.col("n_chars"))
    both = F.array(
        F.struct(F.lit("native").alias("mode"), F.col("base").alias("match"), tokens.alias("tokens")),
        F.struct(F.lit("variant").alias("mode"), F.col("variant").alias("match"), F.floor(F.col("n_chars") / 2).alias("tokens")),
    )
    rows = _paired(spark, sf_dir).select(F.col("lang").alias("grp"), F.col("source").alias("question"), F.col("doc_id").alias("slot"), F.explode(both).alias("x"))
    return rows.select("grp", "question", "slot", "x.*")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"""with {_CELLS} select grp, mode, count(*) as candidate_count, count(*) filter (match) as matched, count(match) as evaluable, count(*) - count(match) as unknown,
    round(cast(count(*) filter (match) as double) / nullif(count(match), 0), 6) as observed_match_ratio from cells group by grp, mode""")
def mode_candidate_matches(spark, sf_dir):
    return _rounded(reports.candidate_matches(_cells(spark, sf_dir)), "observed_match_ratio")


_WHOLE = "coalesce(n = known and base_n = base_known, false)"


@query(f"""with {_CELLS} select grp, mode, count(*) filter ({_WHOLE} and matched * base_n > base_matched * n) as increased, count(*) filter ({_WHOLE} and matched * base_n < base_matched * n) as decreased,
    count(*) filter ({_WHOLE} and matched * base_n = base_matched * n) as unchanged, count(*) filter (not {_WHOLE}) as incomplete from p group by grp, mode""")
def mode_candidate_changes(spark, sf_dir):
    return reports.candidate_changes(_cells(spark, sf_dir))


@query(f"""with {_CELLS} select grp, mode, count(*) as total, count(*) filter (covered) as covered, count(*) filter (covered is null) as unknown, round(cast(count(*) filter (covered) as double) / count(*), 6) as coverage_ratio,
    count(*) filter (not base_covered and covered) as none_to_some, count(*) filter (base_covered and not covered) as some_to_none, count(*) filter (base_covered is null or covered is null) as paired_unknown from p group by grp, mode""")
def mode_coverage(spark, sf_dir):
    return _rounded(reports.coverage(_cells(spark, sf_dir)), "coverage_ratio")


@query(f"""with {_CELLS} select grp, mode, count(*) as total, count(*) filter (final) as matched, count(final) as evaluable, round(cast(count(*) filter (final) as double) / count(*), 6) as match_ratio,
    round(cast(count(*) filter (final) as double) / nullif(count(final), 0), 6) as observed_match_ratio, count(*) filter (not base_final and final) as wrong_to_right,
    count(*) filter (base_final and not final) as right_to_wrong, count(*) filter (base_final is null or final is null) as paired_unknown from p group by grp, mode""")
def mode_final_outputs(spark, sf_dir):
    return _rounded(reports.final_outputs(_cells(spark, sf_dir)), "match_ratio", "observed_match_ratio")


@query(f"""with {_CELLS} select grp, mode, count(*) filter (covered) as correct_available, count(*) filter (covered and final) as selected_correct, count(*) filter (covered and final is null) as selected_unknown,
    round(cast(count(*) filter (covered and final) as double) / nullif(count(*) filter (covered), 0), 6) as selection_ratio, count(*) filter (not covered) as all_incorrect from q group by grp, mode""")
def mode_voting(spark, sf_dir):
    return _rounded(reports.voting(_cells(spark, sf_dir)), "selection_ratio")


@query(f"""with {_CELLS} select grp, mode, count(*) filter (coalesce(examples, []) = coalesce(base_examples, [])) as same, count(*) filter (coalesce(examples, []) <> coalesce(base_examples, [])) as different,
    cast(0 as bigint) as unknown from p group by grp, mode""")
def mode_examples(spark, sf_dir):
    return reports.example_changes(_cells(spark, sf_dir))


@query(f"""with {_CELLS} select grp, mode, cast(sum(tokens) as bigint) as known_tokens, count(*) filter (tokens is null) as unknown_questions, cast(case when count(tokens) = count(*) then sum(tokens) end as bigint) as tokens
    from q group by grp, mode""")
def mode_usage(spark, sf_dir):
    return reports.mode_usage(_cells(spark, sf_dir))


_KNOWN, _SPENT = "(base is not null and variant is not null)", "(base_tokens is not null and variant_tokens is not null)"


@query(f"""with s as (select *, source as stage, n_chars as base_tokens, case when doc_id % 3 <> 0 then length(text) - 1 end as variant_tokens from {_ROWS})
    select stage, count(*) as finished, count(*) filter ({_KNOWN}) as pairs, round(100.0 * count(*) filter ({_KNOWN} and base) / nullif(count(*) filter ({_KNOWN}), 0), 6) as base_pct,
    round(100.0 * count(*) filter ({_KNOWN} and variant) / nullif(count(*) filter ({_KNOWN}), 0), 6) as variant_pct,
    round(100.0 * (count(*) filter ({_KNOWN} and variant) - count(*) filter ({_KNOWN} and base)) / nullif(count(*) filter ({_KNOWN}), 0), 6) as delta_pp,
    count(*) filter (not base and variant) as wrong_to_right, count(*) filter (base and not variant) as right_to_wrong, count(*) filter (not {_KNOWN}) as excluded, count(*) filter ({_SPENT}) as token_pairs,
    round(100.0 * (1 - sum(variant_tokens) filter ({_SPENT}) / nullif(cast(sum(base_tokens) filter ({_SPENT}) as double), 0)), 6) as saving_pct from s group by stage""")
def stage_pair_summary(spark, sf_dir):
    s = _paired(spark, sf_dir).select("base", "variant", F.col("source").alias("stage"), F.col("n_chars").alias("base_tokens"), F.when(F.col("doc_id") % 3 != 0, F.length("text") - 1).alias("variant_tokens"))
    return _rounded(reports.stage_pairs(s), "base_pct", "variant_pct", "delta_pp", "saving_pct")


@query(f"""with g as (select source, case when count(*) filter (base) > 0 then true when count(base) < count(*) then null else false end as pool from {_ROWS} group by source)
    select case when base then 'selected_match' when base is null then 'selected_unresolved' when pool is null then 'input_unresolved' when not pool then 'input_no_match'
      when variant is null then 'shortlist_unresolved' when not variant then 'lost_before_final_choice' when n_chars % 2 = 0 then 'model_miss' else 'rule_miss' end as failure_class, count(*) as n
    from {_ROWS} r join g using (source) group by 1""")
def selection_failure_classes(spark, sf_dir):
    rows = _paired(spark, sf_dir).withColumn("asked", F.col("n_chars") % 2 == 0)
    pools = rows.groupBy("source").agg(metrics.kleene_or("base").alias("pool"))
    return rows.join(pools, "source").groupBy(reports.failure_class("base", "pool", "variant", "asked").alias("failure_class")).agg(F.count("*").alias("n"))


_SETS = "(select list_distinct(string_split(lower(text), ' ')) as gold, list_filter(list_distinct(string_split(lower(text), ' ')), lambda x: length(x) % 2 = 0) as base, list_filter(list_distinct(string_split(lower(text), ' ')), lambda x: length(x) <> 4) as variant from benchmark)"


def _sets(spark, sf_dir) -> DataFrame:
    gold = table(spark, sf_dir, "benchmark").select(F.array_distinct(F.split(F.lower("text"), " ")).alias("gold"))
    return gold.select("gold", F.filter("gold", lambda x: F.length(x) % 2 == 0).alias("base"), F.filter("gold", lambda x: F.length(x) != 4).alias("variant"))


@query(f"with d as (select len(base) - len(variant) as d from {_SETS}) select count(*) as questions, count(*) filter (d < 0) as improvements, count(*) filter (d > 0) as regressions, count(*) filter (d = 0) as unchanged from d")
def paired_symmetric_errors(spark, sf_dir):
    return reports.symmetric_errors(_sets(spark, sf_dir), "gold", "base", "variant")


@query(f"with d as (select case when len(gold) > 0 then len(list_intersect(gold, variant)) - len(list_intersect(gold, base)) end as d from {_SETS}) select count(d) as eligible, count(*) filter (d > 0) as improvements, count(*) filter (d < 0) as regressions, count(*) filter (d = 0) as unchanged from d")
def paired_recall_directions(spark, sf_dir):
    return reports.recall_directions(_sets(spark, sf_dir), "gold", "base", "variant")


@query(f"""with e as (select lang as grp, case when base is null then 'unknown' when base then 'match' else 'no_match' end as status, unnest(case when n_chars > 500 then ['long', 'any'] else ['any'] end) as feature from {_ROWS})
    select grp, status, feature, count(*) as n from e group by grouping sets ((grp, status, feature), (status, feature))""")
def feature_status_counts(spark, sf_dir):
    rows = _paired(spark, sf_dir).select(
        F.col("lang").alias("grp"), F.when(F.col("base").isNull(), "unknown").when(F.col("base"), "match").otherwise("no_match").alias("status"),
        F.when(F.col("n_chars") > 500, F.array(F.lit("long"), F.lit("any"))).otherwise(F.array(F.lit("any"))).alias("tags"),
    )
    return reports.feature_counts(rows, "grp", "status", "tags")


@query("""with c as (select o_custkey as item, o_orderkey as slot, case when o_orderstatus <> 'P' then substr(md5(o_orderpriority), 1, 2) end as h from orders),
    g as (select item, h, count(*) as n, min(slot) as first_slot from c where h is not null group by item, h), m as (select item, max(n) as n from g group by item)
    select c.item, coalesce((select min(first_slot) from g join m using (item, n) where g.item = c.item), min(c.slot)) as winner,
      coalesce((select count(*) from g join m using (item, n) where g.item = c.item), 0) > 1 as tie, count(c.h) = 0 as fallback from c group by c.item""")
def vote_first_equal(spark, sf_dir):
    result = F.when(F.col("o_orderstatus") != "P", F.substring(F.md5("o_orderpriority"), 1, 2))
    return reports.first_equal(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item"), F.col("o_orderkey").alias("slot"), result.alias("result_hash")))


@query("select source, doc_id, cast(place as int) as place from (select source, doc_id, row_number() over (partition by source order by md5('7:' || doc_id), doc_id) as place from documents) where place <= 5")
def stratified_quota_sample(spark, sf_dir):
    return reports.quota(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 5, seed=7)


@query("""select event_id, cast(sum(k) over (partition by event_type order by s range between 59 preceding and current row) as bigint) as spent, cast(sum(k) over (partition by event_type order by s range unbounded preceding) as bigint) as total
    from (select event_id, event_type, cast(floor(epoch(ts) / 60) as bigint) as s, cast(json_extract_string(props, '$.k') as bigint) as k from events)""")
def rolling_minute_budget(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60).alias("s"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    return reports.rolling_budget(e, "event_type", "s", "k", 60).select("event_id", "spent", "total")


@query("""with a as (select distinct p_partkey % 40 as key from part), b as (select distinct s_suppkey + 5 as key from supplier)
    select coalesce(a.key, b.key) as key, case when b.key is null then 'missing' else 'extra' end as side from a full join b on a.key = b.key where a.key is null or b.key is null""")
def full_outer_both_sides(spark, sf_dir):
    a = table(spark, sf_dir, "part").select((F.col("p_partkey") % 40).alias("key"))
    return reports.both_sides(a, table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 5).alias("key")), "key")
