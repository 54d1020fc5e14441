"""The queries opN_<name> over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, neighbours, pseudo_likelihood, quality, rans, secrets, simhash, substrings, token_counts
from .common import read, scratch

WORDS = "word_bpe_49k.json"
BYTES = "byte_bpe_50k.tiktoken"


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "rans")
    rans.write(read(spark, sf_dir, "documents"), path, public_tokenizers.path(WORDS), end_id=1)
    found = rans.read_ids(spark, path)
    return found.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTES), public_tokenizers.PATTERN)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(read(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(read(spark, sf_dir, "documents"), window=13)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.scores(read(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path(WORDS), limit=2048)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        op1_simhash_near_dedup, op2_token_id_output, op3_nearest_neighbours, op4_byte_bpe, op5_secret_scan, op6_substring_dedup,
        op7_decontamination, op8_pseudo_likelihood, op9_token_counts, op10_quality_classifier,
    )
    return {f.__name__: f for f in made}


#: DuckDB SQL of the queries whose method finds exactly what plain equality of windows finds.
OP6_SQL = r"""
    with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
    words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as place from docs),
    starts as (select doc_id, w, unnest(range(1, len(w) - 11)) as place from docs),
    windows as (select doc_id, place, array_to_string(w[place:place + 12], ' ') as body from starts),
    seen as (select body, min(doc_id) as first_id from windows group by body),
    later as (select doc_id, place from windows join seen using (body) where first_id < doc_id),
    gone as (select distinct doc_id, place + step as place from later, range(13) t(step)),
    kept as (select doc_id, string_agg(word, ' ' order by place) as body, count(*) as n from words anti join gone using (doc_id, place) group by doc_id)
    select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(body, '')) as kept_sha256
    from docs d left join kept k on k.doc_id = d.doc_id"""
OP7_SQL = r"""
    with docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
    items as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
    places as (select item_id, w, least(len(w), 10) as n, unnest(range(1, greatest(len(w) - 8, 2))) as place from items where len(w) > 0),
    wanted as (select distinct cast(item_id as varchar) as item, n, array_to_string(w[place:place + n - 1], ' ') as body from places),
    sizes as (select distinct n from wanted),
    starts as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as place from docs, sizes where len(w) >= n),
    hits as (select doc_id, place, n, item from (select doc_id, place, n, array_to_string(w[place:place + n - 1], ' ') as body from starts) join wanted using (n, body)),
    covered as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(place, place + n)) as pos from hits) group by doc_id),
    met as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as listed from (select distinct doc_id, item from hits) group by doc_id)
    select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
      sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from docs d left join covered c on c.doc_id = d.doc_id left join met m on m.doc_id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op6_substring_dedup": OP6_SQL, "op7_decontamination": OP7_SQL}
