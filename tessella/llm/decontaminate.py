"""Benchmark passages in documents, by winnowing; DataFrame functions only.

Words are runs of digits, a-z (A-Z lower-cased) and all that isn't ASCII. A window is `words` consecutive words of an item. The
smallest GRAM-word hash of each window is kept, once for a run of windows that share it; two texts that share a window share
that hash, so an equality join of kept hashes finds every shared window, and the windows around each hit are then compared as
text. Items shorter than a window are one window each, too short for the guarantee; for each of their few lengths documents keep
every run of so many words.

A document word inside any occurrence of a window is hit. Null texts have no words; empty items no window. Repeated rows give
repeated results; an item_id counts once however many rows have it. Clashing and extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, stored
from .hof import let

PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW, GRAM = 10, 5


def words_of(text: str = "text") -> Column:
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.regexp_extract_all(F.translate(whole, UPPER, LOWER), F.lit(PATTERN), F.lit(0))


def _joined(words: Column, start: Column, n: Column | int) -> Column:
    return F.array_join(F.slice(words, start + 1, F.lit(n) if isinstance(n, int) else n), " ")


def _smallest(words: Column, n: Column, window: int) -> Column:
    """The smallest gram hash of the window that begins at each word; n >= window."""
    grams = F.transform(F.sequence(F.lit(0), n - GRAM), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(GRAM)]))
    return let(grams, lambda h: F.transform(F.sequence(F.lit(0), n - window), lambda i: F.least(*[F.get(h, i + j) for j in range(window - GRAM + 1)])))


def _records(words: Column, n: Column, window: int, short: list[int]) -> Column:
    """struct(h, at, context) of each run of windows with the same smallest hash: context holds the words of the run."""
    kind = "array<struct<h:bigint,at:int,context:string>>"

    def runs(m: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), n - window), lambda i: (i == 0) | (F.get(m, i) != F.get(m, i - 1)))
        return let(first, lambda s: F.transform(s, lambda i, k: F.struct(F.get(m, i).alias("h"), i.alias("at"), _joined(words, i, F.coalesce(F.get(s, k + 1), n - window + 1) - i + window - 1).alias("context"))))

    out = F.when(n >= window, let(_smallest(words, n, window), runs)).otherwise(F.array().cast(kind)).cast(kind)
    for size in short:
        out = F.concat(out, F.when(n >= size, _runs_of(words, n, size)).otherwise(F.array().cast(kind)).cast(kind))
    return out


def _runs_of(words: Column, n: Column, size: int) -> Column:
    """struct(h, at, context) of every run of `size` words."""
    each = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.struct(i.alias("at"), _joined(words, i, size).alias("context")))
    return F.transform(each, lambda x: F.struct(F.xxhash64(x["context"]).alias("h"), x["at"].alias("at"), x["context"].alias("context")))


def _windows(context: Column, window: int) -> Column:
    """struct(offset, n, words) of each window in a record's context."""
    def within(w: Column) -> Column:
        n = F.size(w)
        return F.transform(F.sequence(F.lit(0), F.greatest(n - window, F.lit(0))), lambda i: F.struct(i.alias("offset"), F.least(n, F.lit(window)).alias("n"), _joined(w, i, window).alias("words")))

    return let(F.split(context, " "), within)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item: str = "item_id") -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, items (item_ids with occurring windows, as sorted strings) of every row."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), words_of().alias("w")).where(F.size("w") > 0)
    items = items.select("item", "w", F.size("w").alias("n"))
    short = sorted(r["n"] for r in items.where(F.col("n") < window).select("n").distinct().collect())
    full = items.select("item", F.explode(let(F.col("w"), lambda w: F.when(F.size(w) >= window, F.arrays_zip(_smallest(w, F.size(w), window).alias("h"), _windows_all(w, window).alias("words"))).otherwise(F.array(F.struct(F.xxhash64(F.array_join(w, " ")).alias("h"), F.array_join(w, " ").alias("words")))))).alias("x")).select("item", "x.h", "x.words")
    full = stored(full, "windows")
    hashes = bounded(full.select(F.col("h").alias("known")).distinct())
    windows = full.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    windows = bounded(windows, F.length("words") + F.length(F.array_join("items", " ")))

    def all_of(w: Column) -> Column:
        n = F.size(w)
        base = F.array(F.struct(F.lit(None).cast("long").alias("h"), n.alias("at"), F.lit(None).cast("string").alias("context")))
        return F.concat(base, _records(w, n, window, short))

    key = [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text_hash")]
    rows = docs.select(*key, F.explode(let(words_of(text), all_of)).alias("r")).select("doc_id", "text_hash", "r.*")
    base = F.col("h").isNull()
    met = rows.join(hashes, F.col("h") == F.col("known"), "left").where(base | F.col("known").isNotNull())
    none = F.array(F.struct(F.lit(None).cast("int").alias("offset"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("string").alias("words")))
    spread = met.select("doc_id", "text_hash", "at", F.explode(F.when(base, none).otherwise(_windows(F.col("context"), window))).alias("v")).select("doc_id", "text_hash", "at", "v.*")
    hits = spread.join(windows, "words", "left").where(F.col("n").isNull() | F.col("items").isNotNull())
    whole = F.col("n").isNull()
    found = F.collect_list(F.when(~whole, F.struct((F.col("at") + F.col("offset")).alias("at"), "n", "items")))
    per = hits.groupBy("doc_id", "text_hash").agg(F.max(F.when(whole, F.col("at"))).alias("n_words"), F.count(F.when(whole, 1)).alias("rows"), found.alias("found"))

    def step(acc: Column, x: Column) -> Column:
        to = x["at"] + x["n"]
        return F.struct(F.greatest(acc["to"], to).alias("to"), (acc["n"] + F.greatest(F.lit(0), to - F.greatest(acc["to"], x["at"]))).alias("n"))

    spans = F.array_sort(F.transform("found", lambda x: F.struct(x["at"].alias("at"), x["n"].alias("n"))))
    zero = F.struct(F.lit(0).alias("to"), F.lit(0).alias("n"))
    out = per.select(
        "doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"),
        F.aggregate(spans, zero, step, lambda acc: acc["n"].cast("long")).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda x: x["items"])))).alias("items"),
        F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("row"),
    )
    return out.drop("row")


def _windows_all(words: Column, window: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - window), lambda i: _joined(words, i, window))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs without those that hold a benchmark window."""
    hit = contamination(docs, benchmark, text=text).where("n_hit > 0").select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct()
    # Spark broadcasts what goes below its own threshold; beyond it, both sides are shuffled
    hit = stored(hit, "hit")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("hit_id")) & (F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))) == F.col("hit_hash"))
    return docs.join(hit, same, "left_anti")
