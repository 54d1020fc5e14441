"""Small helpers over Spark's higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, join: Callable[[Column, Column], Column], zero: int) -> Column:
    """join of all longs up to each, for an associative join with the neutral element `zero`.

    Arrays that grow are copied at each step, so this goes by blocks of about the square root of the array's size."""
    start = F.lit(zero).cast("bigint")
    none = F.array().cast("array<bigint>")

    def step(acc: Column, x: Column) -> Column:
        return F.struct(join(acc["last"], x).alias("last"), F.concat(acc["all"], F.array(join(acc["last"], x))).alias("all"))

    def fold(v: Column) -> Column:
        return F.aggregate(v, F.struct(start.alias("last"), none.alias("all")), step, lambda acc: acc["all"])

    def blocks(v: Column) -> Column:
        wide = F.ceil(F.sqrt(F.size(v))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / wide).cast("int") - 1), lambda b: fold(F.slice(v, b * wide + 1, wide)))

    def joined(inner: Column) -> Column:
        before = fold(F.transform(inner, lambda r: F.element_at(r, -1)))
        return let(before, lambda s: F.flatten(F.transform(inner, lambda r, b: F.transform(r, lambda x: join(F.coalesce(F.get(s, b - 1), start), x)))))

    return let(values, lambda v: F.when(F.size(v) > 0, let(blocks(v), joined)).otherwise(none))


#: Code points of a block of a long text.
WIDE = 4096


def blocks_of(text: Column) -> Column:
    """A text in blocks of WIDE code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{WIDE}}}"), F.lit(0))


def part(blocks: Column, start: Column, end: Column) -> Column:
    """Code points start to end (exclusive) of a text in blocks: no more of it is walked than that and two blocks."""
    i, j = F.floor(start / WIDE).cast("int"), F.floor(end / WIDE).cast("int")
    own = lambda k: F.coalesce(F.get(blocks, k), F.lit(""))
    first = (start % WIDE).cast("int") + 1
    across = F.concat(F.substr(own(i), first), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(own(j), F.lit(1), (end % WIDE).cast("int")))
    return F.when(i == j, F.substring(own(i), first, (end - start).cast("int"))).otherwise(across)
