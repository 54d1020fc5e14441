"""Queries whose text both Spark and DuckDB run; {a|b} has Spark's spelling first."""

from __future__ import annotations

import re

TEXTS = {
    "value_examples_top3": """
        select column_name, value, rank from (
          select column_name, value, cast(row_number() over (partition by column_name order by value) as int) as rank
          from (select distinct 'p_brand' as column_name, p_brand as value from part union select distinct 'p_type', p_type from part
                union select distinct 'c_mktsegment', c_mktsegment from customer) v
          where value is not null and length(value) between 1 and 100) r where rank <= 3""",
    "pool_state_three_valued": """
        select d.source, cast(count(*) as bigint) as n, cast(sum(case when l.quality = 1 then 1 else 0 end) as bigint) as n_true,
          cast(sum(case when l.quality is null then 1 else 0 end) as bigint) as n_unknown,
          case when sum(case when l.quality = 1 then 1 else 0 end) > 0 then 'has_match'
               when sum(case when l.quality is null then 1 else 0 end) > 0 then 'unknown' else 'no_match' end as pool_state
        from documents d left join labels l on d.doc_id = l.doc_id group by d.source""",
    "transition_matrix": """
        select d.lang, l.quality = 1 as before_ok, l.toxic = 0 as after_ok, count(*) as n
        from documents d left join labels l on d.doc_id = l.doc_id group by d.lang, l.quality = 1, l.toxic = 0""",
    "group_and_overall": """
        select coalesce(d.lang, 'all') as grp, count(*) as n, round(avg(l.quality), 6) as mean_quality
        from documents d join labels l on d.doc_id = l.doc_id group by rollup(d.lang)""",
    "per_database_delta": """
        select d.source, count(*) as n, round(100.0 * avg(l.quality), 6) as native_pct, round(100.0 * avg(1 - l.toxic), 6) as variant_pct,
          round(100.0 * avg(1 - l.toxic) - 100.0 * avg(l.quality), 6) as delta_pp
        from documents d join labels l on d.doc_id = l.doc_id group by d.source""",
    "evaluation_all_tasks_denominator": """
        select d.source, count(*) as tasks, count(l.quality) as assessed,
          round(cast(sum(case when l.quality = 1 then 1 else 0 end) as double) / count(*), 6) as rate_of_all,
          round(cast(sum(case when l.quality = 1 then 1 else 0 end) as double) / nullif(count(l.quality), 0), 6) as rate_of_assessed
        from documents d left join labels l on d.doc_id = l.doc_id group by d.source""",
    "median_change": """
        select o_orderpriority, round(median(o_totalprice), 4) as median_price,
          round({percentile(o_totalprice, 0.9)|quantile_cont(o_totalprice, 0.9)}, 4) as p90, round({percentile(o_totalprice, 0.95)|quantile_cont(o_totalprice, 0.95)}, 4) as p95
        from orders group by o_orderpriority""",
    "quantile_stats": """
        select event_type, count(*) as n, round(avg(value), 6) as mean, round({percentile(value, 0.5)|quantile_cont(value, 0.5)}, 6) as p50,
          round({percentile(value, 0.95)|quantile_cont(value, 0.95)}, 6) as p95, min(value) as low, max(value) as high
        from events group by event_type""",
    "relative_token_change": """
        select lang, round(100.0 * (cast(sum(n_chars) as double) / nullif(sum(floor(length(text) / 4.0)), 0) / 4 - 1), 4) as change_pct,
          cast(sum(floor(length(text) / 4.0)) as bigint) as tokens
        from documents group by lang""",
    "strict_and_known_sums": """
        select d.source, case when count(*) = count(l.quality) then cast(sum(l.quality) as bigint) end as strict_sum,
          cast(sum(l.quality) as bigint) as known_sum, cast(count(*) - count(l.quality) as bigint) as n_unknown
        from documents d left join labels l on d.doc_id = l.doc_id group by d.source""",
    "status_histogram": "select o_orderstatus, o_orderpriority, count(*) as n, count(distinct o_custkey) as customers from orders group by o_orderstatus, o_orderpriority",
    "first_k_per_group": """
        select o_custkey, o_orderkey, k from (
          select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as int) as k from orders) x where k <= 3""",
    "attempts_left_join_finishes": """
        select o.o_orderkey, count(l.l_orderkey) as n_lines, round(coalesce(sum(l.l_quantity), 0), 4) as quantity
        from orders o left join lineitem l on o.o_orderkey = l.l_orderkey group by o.o_orderkey""",
    "unfinished_anti": "select doc_id, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)",
    "finished_semi": "select doc_id, source from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id)",
    "four_way_left_join": """
        select c.c_custkey, count(distinct o.o_orderkey) as orders, count(l.l_orderkey) as items, max(n.n_name) as nation
        from customer c left join nation n on c.c_nationkey = n.n_nationkey left join orders o on o.o_custkey = c.c_custkey
          left join lineitem l on l.l_orderkey = o.o_orderkey group by c.c_custkey""",
    "representative_min_peer": """
        select doc_id, min(doc_id) over (partition by md5(text)) as representative, count(*) over (partition by md5(text)) as peers from documents""",
    "pairs_theta_self_join": """
        select a.n_regionkey, a.n_nationkey as left_key, b.n_nationkey as right_key
        from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey""",
    "paired_pivot": """
        select user_id, cast(sum(case when event_type = 'view' then 1 else 0 end) as bigint) as views,
          cast(sum(case when event_type = 'click' then 1 else 0 end) as bigint) as clicks from events group by user_id""",
    "json_payload_sum": """
        select event_type, cast(sum(cast({get_json_object(props, '$.k')|json_extract_string(props, '$.k')} as bigint)) as bigint) as k_sum,
          cast(count({get_json_object(props, '$.k')|json_extract_string(props, '$.k')}) as bigint) as known
        from events group by event_type""",
    "json_path_predicate": "select event_id, user_id from events where {get_json_object(props, '$.k')|json_extract_string(props, '$.k')} = '7'",
    "union_distinct_ids": "select o_orderkey as id from orders where o_totalprice > 300000 union select l_orderkey from lineitem where l_quantity >= 49",
    "intersect_except": "(select o_orderkey as id from orders intersect select l_orderkey from lineitem where l_quantity >= 45) except select o_orderkey from orders where o_orderstatus = 'F'",
    "union_all_generators": "select 'orders' as origin, count(*) as n from orders union all select 'lineitem', count(*) from lineitem union all select 'events', count(*) from events",
    "batches_of_twelve": """
        select source, batch, count(*) as n, min(doc_id) as first_id from (
          select source, doc_id, cast(floor((row_number() over (partition by source order by doc_id) - 1) / 12) as bigint) as batch from documents) x
        group by source, batch""",
    "tied_scores": """
        select c_nationkey, c_custkey, c_mktsegment, count(*) over (partition by c_nationkey, c_mktsegment) > 1 as tied from customer""",
    "exhaustion_causes": """
        select user_id, case when n_error = n then 'all' when n_error > 0 then 'any' else 'none' end as cause, n from (
          select user_id, count(*) as n, cast(sum(case when event_type = 'error' then 1 else 0 end) as bigint) as n_error from events group by user_id) x""",
    "shortlist_profile": """
        select lang, source, case when count(l.quality) < count(*) then 'unresolved' when min(l.quality) = 1 then 'all_match'
          when max(l.quality) = 0 then 'all_mismatch' else 'mixed' end as profile
        from documents d left join labels l on d.doc_id = l.doc_id group by lang, source""",
    "named_subsets": """
        select subset, count(*) as n from (
          select 'active' as subset from labels where quality = 1 union all select 'changed' from labels where quality <> 1 - toxic
          union all select 'mixed' from labels where quality = 1 and toxic = 1) x group by subset""",
    "stage_completeness": """
        select cast(sum(case when text is null or lang is null or source is null then 1 else 0 end) as bigint) as incomplete, count(*) as n from documents""",
    "vector_validity": "select label, count(*) as n, cast(min({size|len}(embedding)) as bigint) as low, cast(max({size|len}(embedding)) as bigint) as high from embeddings group by label",
    "dependency_closure": """
        with recursive dep(child, parent) as (select cast(col1 as int), cast(col2 as int) from (values (2, 1), (3, 1), (4, 2), (4, 3), (5, 4), (7, 6)) v(col1, col2)),
        walk(node, ancestor, depth) as (
          select child, parent, 1 from dep union all select w.node, d.parent, w.depth + 1 from walk w join dep d on w.ancestor = d.child where w.depth < 20)
        select node, ancestor, cast(min(depth) as int) as depth from walk group by node, ancestor""",
    "ancestor_candidate": """
        with recursive tree(id, parent, kind) as (
          select cast(a as int), cast(b as int), c from (values (1, null, 'candidate'), (2, 1, 'step'), (3, 2, 'step'), (4, null, 'step'), (5, 4, 'candidate'), (6, 5, 'leaf')) v(a, b, c)),
        walk(start_id, id, kind, depth) as (
          select id, id, kind, 0 from tree union all
          select w.start_id, t.parent, p.kind, w.depth + 1 from walk w join tree t on t.id = w.id join tree p on p.id = t.parent where w.kind <> 'candidate' and w.depth < 20)
        select start_id, id as candidate, cast(depth as int) as depth from walk where kind = 'candidate'""",
    "names_by_region": "select r.r_name, count(*) as nations, min(n.n_name) as first_name from region r left join nation n on n.n_regionkey = r.r_regionkey group by r.r_name having count(*) > 0",
    "sql_normalise_hash": "select doc_id, md5(lower(trim(regexp_replace(text, '\\\\s+', ' '{|, 'g'})))) as text_hash from documents",
    "pricing_summary": """
        select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base,
          round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc, round(avg(l_discount), 6) as avg_disc, count(*) as n
        from lineitem where l_shipdate <= timestamp '1998-09-02' group by l_returnflag, l_linestatus""",
    "region_revenue": """
        select n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) as revenue
        from customer c join orders o on o.o_custkey = c.c_custkey join lineitem l on l.l_orderkey = o.o_orderkey
          join nation n on n.n_nationkey = c.c_nationkey group by n.n_name""",
    "tagged_answer_extract": """
        select conv_id, turn, {regexp_extract(concat('<result>', text, '</result>'), '(?s)<result>(.*?)</result>', 1)|regexp_extract('<result>' || text || '</result>', '(?s)<result>(.*?)</result>', 1)} as answer
        from conversations""",
    "effective_latest_usage": """
        select event_type, count(*) as retained, cast(sum(k) as bigint) as known_tokens, cast(count(*) - count(k) as bigint) as missing, count(k) = count(*) as complete from (
          select event_type, case when event_id % 9 <> 0 then cast({get_json_object(props, '$.k')|json_extract_string(props, '$.k')} as bigint) end as k,
            row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events where event_type <> 'error') x
        where r = 1 group by event_type""",
    "sampling_completeness": """
        select user_id, cast(sum(case when event_type = 'view' then 1 else 0 end) as bigint) as target, cast(sum(case when event_type = 'click' then 1 else 0 end) as bigint) as succeeded,
          sum(case when event_type = 'view' then 1 else 0 end) = sum(case when event_type = 'click' then 1 else 0 end) as complete from events group by user_id""",
    "conflicting_signatures": """
        select l_partkey, count(*) as attempts, count(distinct l_suppkey) as signatures, count(distinct l_suppkey) > 1 as conflict from lineitem group by l_partkey""",
    "byte_totals": "select source, cast(coalesce(sum({octet_length(text)|octet_length(encode(text))}), 0) as bigint) as n_bytes, count(*) as n from documents group by source",
    "latency_stats": """
        select o_orderpriority, count(*) as finished, round(cast(sum(days) as double), 3) as total, round(avg(days), 6) as mean, max(days) as longest from (
          select o.o_orderkey, o.o_orderpriority, max({datediff(l.l_shipdate, o.o_orderdate)|datediff('day', o.o_orderdate, l.l_shipdate)}) as days
          from orders o join lineitem l on l.l_orderkey = o.o_orderkey group by o.o_orderkey, o.o_orderpriority) x group by o_orderpriority""",
    "dictionary_statistics": """
        select column_name, count(*) as documents, cast(sum(length(value)) as bigint) as characters, count(*) filter (where length(value) > 10) as long_values from (
          select distinct 'p_name' as column_name, p_name as value from part union select distinct 'c_mktsegment', c_mktsegment from customer union select distinct 'p_type', p_type from part) v
        where value is not null group by column_name""",
    "mixed_pair_totals": """
        select coalesce(lang, 'TOTAL') as grp, count(*) as pairs, count(*) filter (where gain) as gain, count(*) filter (where loss) as loss, count(*) filter (where gain) - count(*) filter (where loss) as net from (
          select d.lang, l.quality = 0 and l.toxic = 0 as gain, l.quality = 1 and l.toxic = 1 as loss from documents d join labels l on l.doc_id = d.doc_id where l.quality <> 1 - l.toxic) x group by rollup(lang)""",
    "few_shot_inspection": """
        select label, count(*) as n, min(vec_id) as low, round(avg(vec_id), 6) as mean, round({percentile(vec_id, 0.5)|quantile_cont(vec_id, 0.5)}, 6) as p50,
          round({percentile(vec_id, 0.9)|quantile_cont(vec_id, 0.9)}, 6) as p90, max(vec_id) as high, round(1.0 * count(*) / sum(count(*)) over (), 6) as share from embeddings group by label""",
    "revision_vote": """
        select o_custkey, answer, votes from (
          select o_custkey, o_orderpriority as answer, count(*) as votes, row_number() over (partition by o_custkey order by count(*) desc, min(o_orderkey)) as r from orders group by o_custkey, o_orderpriority) x where r = 1""",
    "selection_branches": """
        select case when n_known is null or n_known = 0 then 'fallback' when n_known = 1 then 'single' when top >= 0.6 * n_known then 'consistency_shortcut' else 'pairwise_comparison' end as branch, count(*) as n from (
          select o_custkey, cast(sum(n) as bigint) as n_known, max(n) as top from (
            select o_custkey, o_orderpriority, count(*) as n from orders where o_orderstatus <> 'F' group by o_custkey, o_orderpriority) a group by o_custkey) b group by 1""",
    "paired_evaluation_report": """
        select d.source, count(*) as items, count(*) filter (where l.quality = 0 and l.toxic = 0) as repair, count(*) filter (where l.quality = 1 and l.toxic = 1) as harm,
          count(*) filter (where l.quality = 1 and l.toxic = 0) as unchanged_correct, count(*) filter (where l.quality = 0 and l.toxic = 1) as unchanged_incorrect,
          count(*) filter (where l.quality is null or l.toxic is null) as unknown from documents d left join labels l on l.doc_id = d.doc_id group by d.source""",
    "sampling_sensitivity": """
        select subset, d.lang, count(*) as n, count(*) filter (where l.quality = 1) as matched from documents d join labels l on l.doc_id = d.doc_id
          join (select 'complete_active' as subset union all select 'same_budget_active') s on (subset = 'complete_active' and d.n_chars > 200) or (subset = 'same_budget_active' and d.n_chars between 200 and 2000)
        group by subset, d.lang""",
    "schema_reduction_macro": """
        select round(avg(1.0 * (full_n - kept_n) / full_n), 6) as mean_reduction, count(*) as successes from (
          select o_orderkey, count(*) as full_n, count(*) filter (where l_discount > 0.04) as kept_n from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey) x where kept_n > 0""",
    "linking_recall": """
        select item, round(1.0 * hits / greatest(gold, 1), 6) as recall, gold from (
          select g.o_custkey as item, count(*) as gold, count(f.k) as hits from (select distinct o_custkey, o_orderpriority as k from orders) g
            left join (select distinct o_custkey, o_orderpriority as k from orders where o_orderstatus = 'O') f on f.o_custkey = g.o_custkey and f.k = g.k group by g.o_custkey) x""",
    "linked_set_union": """
        select item, {array_join(array_sort(collect_set(k)), ',')|string_agg(distinct k, ',' order by k)} as linked from (
          select o_custkey as item, o_orderpriority as k from orders where o_orderstatus = 'O' union all select o_custkey, o_orderstatus from orders) x group by item""",
    "parser_agreement": """
        select case when l.doc_id is null then 'missing' when d.n_chars = 0 then 'empty' else 'compared' end as reason, count(*) as n,
          count(*) filter (where l.quality = 1 - l.toxic) as exact from documents d left join labels l on l.doc_id = d.doc_id group by 1""",
    "stage_token_pairs": """
        select coalesce(exclusion, 'eligible') as state, count(*) as n, cast(sum(case when exclusion is null then a - b end) as bigint) as saved from (
          select l_orderkey, sum(case when l_linenumber = 1 then l_partkey end) as a, sum(case when l_linenumber = 2 then l_partkey end) as b,
            case when count(case when l_linenumber = 1 then 1 end) = 0 then 'no_native' when count(case when l_linenumber = 2 then 1 end) = 0 then 'no_variant' end as exclusion
          from lineitem group by l_orderkey) x group by 1""",
    "api_trace_fold": """
        select user_id, count(*) filter (where event_type = 'view') as requests, count(*) filter (where event_type = 'click') as responses, count(*) filter (where event_type = 'error') as errors,
          min(event_id) as first_event, max(event_id) as last_event from events group by user_id""",
    "monitoring_counts": "select event_type, count(*) as n, max(event_id) as next_cursor from events where event_id > 500 group by event_type",
    "incremental_cursor_scan": """
        select event_id, user_id from events where event_id > 900 and user_id in (select user_id from events where event_type = 'error' and event_id > 900 union select user_id from events where event_type = 'signup' and event_id > 950)""",
    "independent_examples": """
        select source, doc_id from (select source, doc_id, row_number() over (partition by source order by doc_id) as r from documents
          where source <> (select min(source) from documents) and doc_id not in (select doc_id from labels where toxic = 1)) x where r = 1""",
    "reuse_predicate": """
        select a.conv_id, a.turn from conversations a join conversations b on b.conv_id = a.conv_id and b.turn = a.turn and b.text = a.text and b.role is not distinct from a.role
        where a.text is not null and length(a.text) > 0 and a.role = 'user'""",
    "progressive_stripping": """
        select doc_id, case when length(text) / 4.0 <= 100 then 0 when length(text) / 8.0 <= 100 then 1 when length(text) / 16.0 <= 100 then 2 when length(text) / 64.0 <= 100 then 3 else 4 end as level from documents""",
    "profile_first_rows": "select count(o_totalprice) as total_count, count(distinct o_custkey) as distinct_count, cast(count(*) - count(o_totalprice) as bigint) as null_count from (select * from orders order by o_orderkey limit 100000) x",
    "line_multiset_equal": """
        select doc_id, count(*) over (partition by md5({array_join(array_sort(split(text, '\\n')), chr(10))|array_to_string(list_sort(string_split(text, chr(10))), chr(10))})) as peers from documents""",
    "null_safe_comparison": """
        select d.lang, count(*) filter (where l.quality is distinct from l.toxic) as differing, count(*) filter (where l.quality is not distinct from l.toxic) as equal_or_both_null
        from documents d left join labels l on l.doc_id = d.doc_id group by d.lang""",
    "first_row_of_each": "select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders) x where r = 1",
    "series_left_join": """
        select s.day, count(e.event_id) as n from (select {explode(sequence(1, 31))|unnest(range(1, 32))} as day) s left join events e on extract(day from e.ts) = s.day group by s.day""",
    "date_parts": """
        select extract(year from o_orderdate) as y, extract(quarter from o_orderdate) as q, count(*) as n, cast(min(date_trunc('month', o_orderdate)) as date) as first_month,
          cast(max(o_orderdate + interval '30' day) as date) as due, count(distinct {date_format(o_orderdate, 'yyyy-MM')|strftime(o_orderdate, '%Y-%m')}) as months from orders group by 1, 2""",
    "values_root": "select col1 as id, col2 as name from (values (1, 'a'), (2, 'b'), (3, null)) v(col1, col2)",
    "join_using": "select n_name, count(*) as n from (select n_nationkey as k, n_name from nation) a join (select c_nationkey as k, c_custkey from customer) b using (k) group by n_name",
    "natural_join": "select k, n_name, r_name from (select n_regionkey as k, n_name from nation) a natural join (select r_regionkey as k, r_name from region) b",
    "correlated_scalar": "select c_custkey, (select max(o_totalprice) from orders where o_custkey = c_custkey) as dearest from customer",
    "correlated_exists_not": "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 100000)",
    "windows_of_each": """
        select o_orderkey, cast(rank() over w as int) as place, lag(o_orderkey) over w as previous, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 1 preceding and current row), 2) as two
        from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""",
    "having_case_cast": """
        select case when p_size < 10 then 'small' when p_size < 30 then 'middle' else 'large' end as size_class, cast(avg(p_retailprice) as decimal(12, 2)) as price, count(*) as n
        from part group by 1 having count(*) > 5""",
    "market_share": """
        select extract(year from o_orderdate) as y, round(sum(case when n_name = 'NATION_1' then l_extendedprice * (1 - l_discount) else 0 end) / sum(l_extendedprice * (1 - l_discount)), 6) as share
        from lineitem join orders on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey group by 1""",
    "top_customers": """
        select c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey
        where l_returnflag = 'R' group by c_custkey, c_name order by revenue desc, c_custkey limit 20""",
    "forecast_revenue": "select round(sum(l_extendedprice * l_discount), 2) as revenue from lineitem where l_shipdate >= timestamp '1994-01-01' and l_shipdate < timestamp '1997-01-01' and l_discount between 0.03 and 0.07 and l_quantity < 24",
    "synthetic_point_lookup": "select id, group_id, category, amount, payload from records where id = 12345",
    "synthetic_group_agg": "select group_id, count(*) as n, round(sum(amount), 3) as total from records where group_id = 42 group by group_id",
    "synthetic_range_sum": "select round(sum(amount), 3) as total, count(*) as n from records where id between 1000 and 5000",
    "synthetic_sort_limit": "select id, amount from records order by amount desc, id limit 10",
    "synthetic_empty_result": "select id, payload from records where id < 0",
}
TEXTS |= {
    "side_tables_joined": """
        select d.doc_id, d.lang, l.quality, e.label, c.turns from documents d left join labels l on l.doc_id = d.doc_id left join embeddings e on e.vec_id = d.doc_id
          left join (select conv_id, count(*) as turns from conversations group by conv_id) c on c.conv_id = d.doc_id""",
    "broadcast_lookup": "select /*+ broadcast(n) */ s.s_suppkey, n.n_name from supplier s join nation n on n.n_nationkey = s.s_nationkey",
    "scoped_catalog": "select n_nationkey, n_name from nation n where exists (select 1 from region r where r.r_regionkey = n.n_regionkey and r.r_regionkey in (1, 3))",
    "latest_and_finished": """
        select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) x where r = 1 and event_type <> 'view'""",
    "casefold_order": """
        select n_name, cast(row_number() over (order by lower(n_name), n_name) as int) as place,
          cast(row_number() over (partition by n_regionkey order by case when n_nationkey % 5 = 0 then 0 else 1 end, lower(n_name), n_name) as int) as keys_first from nation""",
    "subset_test": "select o_custkey, sum(case when o_orderstatus in ('O', 'F') then 0 else 1 end) = 0 as inside from orders group by o_custkey",
    "ordered_dedupe": """
        select lang, source, min(doc_id) as first_id, cast(row_number() over (partition by lang order by min(doc_id)) as int) as place from documents group by lang, source""",
    "shape_agreement": """
        select d.lang, count(*) as rows_a, count(l.doc_id) as rows_b, count(*) = count(l.doc_id) as row_count_equal, 3 = 3 as column_count_equal
        from documents d left join labels l on l.doc_id = d.doc_id group by d.lang""",
    "canonical_hashes": "select doc_id, {sha1(text)|sha1(text)} as by_sha1, {sha2(concat(lang, ':', text), 256)|sha256(concat(lang, ':', text))} as by_sha256 from documents",
    "date_arithmetic": """
        select o_orderkey, {unix_date(cast(o_orderdate as date))|date_diff('day', date '1970-01-01', cast(o_orderdate as date))} + 719163 as ordinal,
          {datediff(cast(o_orderdate as date), date '1992-01-01')|date_diff('day', date '1992-01-01', cast(o_orderdate as date))} as days from orders""",
    "number_helpers": """
        select l_orderkey, l_linenumber, abs(l_discount - 0.05) < 0.011 as near, greatest(-1.0, least(1.0, l_quantity - 25.0)) as clipped,
          cast(floor(l_extendedprice / 100) as bigint) as low, cast(ceil(l_extendedprice / 100) as bigint) as high from lineitem""",
    "exact_rates": """
        with r as (select d.lang, count(*) as n, cast(sum(l.quality) as bigint) as k from documents d join labels l on l.doc_id = d.doc_id group by d.lang)
        select a.lang, b.lang as other, a.k * b.n > b.k * a.n as higher, a.k * b.n = b.k * a.n as equal from r a join r b on a.lang < b.lang""",
    "array_operations": """
        select n_nationkey, {array_join(array_sort(array_distinct(array(n_regionkey, n_nationkey, 3, 3))), '-')|array_to_string(list_sort(list_distinct([n_regionkey, n_nationkey, 3, 3])), '-')} as sorted,
          {array_contains(array(1, 2, 3), n_regionkey)|list_contains([1, 2, 3], n_regionkey)} as known, {array_join(slice(array(n_regionkey, n_nationkey, 7), 2, 2), ',')|array_to_string([n_regionkey, n_nationkey, 7][2:3], ',')} as cut from nation""",
    "map_operations": """
        select n_nationkey, {coalesce(try_element_at(map_concat(map('a', 1), map('b', n_regionkey)), 'b'), -1)|coalesce(map_concat(map(['a'], [1]), map(['b'], [n_regionkey]))['b'], -1)} as b,
          {coalesce(try_element_at(map('a', n_regionkey), 'c'), -1)|coalesce(map(['a'], [n_regionkey])['c'], -1)} as missing from nation""",
    "hinted_question": "select conv_id, turn, case when role = 'user' then concat(text, chr(10), 'Hint: ', role) else text end as question from conversations",
    "encodings": "select r_regionkey, {base64(cast(r_name as binary))|base64(encode(r_name))} as b64, {hex(cast(r_name as binary))|hex(encode(r_name))} as hexed, {cast(unbase64(base64(cast(r_name as binary))) as string)|decode(from_base64(base64(encode(r_name))))} as back from region",
    "wildcards": "select n.*, r.r_name from nation n join region r on r.r_regionkey = n.n_regionkey",
    "json_operators": """
        select event_id, {cast(get_json_object(props, '$.k') as bigint)|cast(props ->> '$.k' as bigint)} as k, {size(json_object_keys(props))|cast(len(json_keys(props)) as int)} as keys from events""",
    "quoted_names": "select {`n`.`n_name`|\"n\".\"n_name\"} as {`the_name`|\"the_name\"} from nation as {`n`|\"n\"}",
    "structs_unnested": """
        select x.k, x.v, n_regionkey from (select n_regionkey, {explode(array(named_struct('k', n_nationkey, 'v', n_name), named_struct('k', -1, 'v', 'none')))|unnest([struct_pack(k := n_nationkey, v := n_name), struct_pack(k := -1, v := 'none')])} as x from nation) t""",
    "annotation_ids": """
        select n_name, concat('T', cast(dense_rank() over (order by n_regionkey) as {string|varchar})) as table_id,
          concat('T', cast(dense_rank() over (order by n_regionkey) as {string|varchar}), '.C', cast(row_number() over (partition by n_regionkey order by n_nationkey) as {string|varchar})) as column_id from nation""",
    "rounds_merged": """
        select d.doc_id, 'reused' as origin, l.quality from documents d join labels l on l.doc_id = d.doc_id where l.quality is not null
        union all select d.doc_id, 'new', cast(null as bigint) from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality is not null)""",
    "gold_status": """
        select d.source, case when l.doc_id is null then 'missing' when l.quality is null then 'unknown' else 'available' end as status, count(*) as n
        from documents d left join labels l on l.doc_id = d.doc_id group by d.source, case when l.doc_id is null then 'missing' when l.quality is null then 'unknown' else 'available' end""",
    "integrity_audit": """
        select 'documents' as tbl, count(*) as n, count(distinct doc_id) as ids, count(*) - count(text) as nulls from documents
        union all select 'labels', count(*), count(distinct doc_id), count(*) - count(quality) from labels union all select 'benchmark', count(*), count(distinct item_id), count(*) - count(text) from benchmark""",
    "fingerprints_agree": """
        with a as (select doc_id, md5(text) as h from documents), b as (select doc_id, md5(concat(text, case when doc_id % 50 = 0 then 'x' else '' end)) as h from documents)
        select count(*) as checked, sum(case when a.h = b.h then 0 else 1 end) as differing, min(case when a.h <> b.h then a.doc_id end) as first_differing from a join b on a.doc_id = b.doc_id""",
    "verified_by_recomputation": """
        select count(*) as differing from ((select lang, count(*) as n from documents group by lang) except all (select distinct lang, count(*) over (partition by lang) as n from documents)) x""",
    "paired_records": """
        with native as (select doc_id, quality from labels), variant as (select doc_id, toxic from labels where doc_id % 2 = 0)
        select d.source, count(*) as tasks, count(n.doc_id) as native, count(v.doc_id) as variant, sum(case when n.doc_id is not null and v.doc_id is not null then 1 else 0 end) as paired,
          sum(case when v.doc_id is not null and n.doc_id is null then 1 else 0 end) as broken from documents d left join native n on n.doc_id = d.doc_id left join variant v on v.doc_id = d.doc_id group by d.source""",
    "group_summary": """
        select d.lang, count(*) as n, round(100.0 * avg(l.quality), 6) as ex_pct, cast(sum(d.n_chars) as bigint) as chars, round(avg(cast(d.n_chars as double)), 4) as mean_chars,
          round({percentile(d.n_chars, 0.5)|quantile_cont(d.n_chars, 0.5)}, 4) as median_chars, count(distinct d.source) as sources from documents d left join labels l on l.doc_id = d.doc_id group by d.lang""",
    "filter_then_link": """
        with kept as (select p_size as item, p_brand from part where p_partkey % 2 = 0), linked as (select p_size as item, p_brand from part where p_partkey % 3 = 0), gold as (select distinct p_size as item, p_brand from part where p_partkey % 6 = 0)
        select g.item, count(*) as gold, sum(case when exists (select 1 from kept k where k.item = g.item and k.p_brand = g.p_brand) then 1 else 0 end) as after_filter,
          sum(case when exists (select 1 from linked l where l.item = g.item and l.p_brand = g.p_brand) then 1 else 0 end) as after_link from gold g group by g.item""",
    "next_nodes": """
        with done as (select o_custkey as item, count(*) as n from orders where o_orderstatus = 'F' group by o_custkey)
        select c.c_custkey as item, case when coalesce(n, 0) = 0 then 'linking' when n = 1 then 'decomposition' when n <= 3 then 'generation' when n <= 5 then 'revision' else 'finished' end as next_node
        from customer c left join done d on d.item = c.c_custkey""",
    "stage_metrics": """
        select d.lang, sum(case when l.quality = 0 and l.toxic = 0 then 1 else 0 end) as repaired, sum(case when l.quality = 1 and l.toxic = 1 then 1 else 0 end) as harmed,
          sum(case when l.quality = 1 and l.toxic = 0 then 1 else 0 end) as kept_correct, sum(case when l.quality is null or l.toxic is null then 1 else 0 end) as unknown_pairs
        from documents d join labels l on l.doc_id = d.doc_id group by d.lang""",
}
_RECORDS = {
    "spark": "with records as (select id, id % 97 as group_id, concat('cat_', id % 11) as category, cast(round((cast(id as decimal(12,2)) * 1.37) % 1000, 3) as double) as amount, concat('payload_', lpad(cast(id as string), 6, '0')) as payload from range(20000)) ",
    "duckdb": "with records as (select range as id, range % 97 as group_id, 'cat_' || (range % 11) as category, cast(round((cast(range as decimal(12,2)) * 1.37) % 1000, 3) as double) as amount, 'payload_' || lpad(cast(range as varchar), 6, '0') as payload from range(20000)) ",
}


def spelt(name: str, dialect: str) -> str:
    """The text of a query as one of the two has it."""
    text = re.sub(r"\{([^{}|]*)\|([^{}]*)\}", lambda m: m[1 if dialect == "spark" else 2], TEXTS[name])
    if dialect == "duckdb":
        text = text.replace("\\\\", "\\")
    return (_RECORDS[dialect] if name.startswith("synthetic_") else "") + text.strip()
