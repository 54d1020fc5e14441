"""Equality of result tables: as bags, sets, ordered lists and column multisets.

A cell is spelt in a canonical form that names its kind: null, bool, str, bytes, date, datetime (with or without a time zone), array, object,
and number, whose value is exact whatever its type: a double is the binary fraction it holds, so that 0.1 as a double isn't the decimal 0.1,
while 1e15 is the integer. Cells of nested types are spelt within them, each with its length before it; the fields of an object go by name.
NaN, infinities and other types (intervals, variants) can't be compared: then equality is null and comparable is false.

Rows meet by two 64-bit hashes of their spelt cells, so that what is shuffled is as short for wide rows as for narrow ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranks import global_rank

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TIME = getattr(T, "TimeType", ())


def _number(text: Column) -> Column:
    """A decimal text as sign, digits without zeros at either end, e and a power of ten."""
    mantissa, power = F.split_part(text, F.lit("E"), F.lit(1)), F.split_part(text, F.lit("E"), F.lit(2))
    digits = F.regexp_replace(mantissa, "[-.]", "")
    short = F.rtrim(digits, F.lit("0"))
    behind = F.length(F.split_part(mantissa, F.lit("."), F.lit(2)))
    ten = F.length(digits) - F.length(short) - behind + F.when(power == "", 0).otherwise(power.try_cast("int"))
    sign = F.when(text.startswith("-"), "-").otherwise("")
    return F.when(short == "", "number:0").otherwise(F.concat(F.lit("number:"), sign, F.ltrim(short, F.lit("0")), F.lit("e"), ten.cast("string")))


def _integer(c: Column) -> Column:
    """As _number, of a long."""
    text = c.cast("string")
    short = F.rtrim(text, F.lit("0"))
    return F.when(c == 0, "number:0").otherwise(F.concat(F.lit("number:"), short, F.lit("e"), (F.length(text) - F.length(short)).cast("string")))


def _double(c: Column) -> Column:
    """A double's exact value m * 2**e, m odd: as a decimal if that has 38 digits or fewer, which any other number that equals it has; else as m and e."""
    spelt = F.format_string("%a", c)  # 0x1.mmmp-eee, below 2**-1022 with 0x0.
    digits = F.rtrim(F.regexp_extract(spelt, r"\.([0-9a-f]+)p", 1), F.lit("0"))
    whole = F.conv(F.concat(F.regexp_extract(spelt, r"0x(\d)", 1), digits), 16, 10).cast("bigint")
    low = F.when(whole % 8 == 0, 3).when(whole % 4 == 0, 2).when(whole % 2 == 0, 1).otherwise(0)
    m = (whole / F.pow(F.lit(2.0), low)).cast("bigint")
    e = F.regexp_extract(spelt, r"p(-?\d+)", 1).cast("int") - 4 * F.length(digits) + low
    sign = F.when(c < 0, "-").otherwise("")
    powers = lambda base, n: F.array(*[F.lit(str(base**k)).cast("decimal(38,0)") for k in range(n)])
    times = F.try_multiply(m.cast("decimal(20,0)"), F.when(e >= 0, F.get(powers(2, 127), e)).otherwise(F.get(powers(5, 55), -e)))
    as_decimal = _number(F.concat(sign, times.cast("string"), F.lit("E"), F.least(e, F.lit(0)).cast("string")))
    return F.coalesce(as_decimal, F.concat(F.lit("number:"), sign, m.cast("string"), F.lit("b"), e.cast("string")))


def _framed(spelt: Column) -> Column:
    return F.concat(F.length(spelt).cast("string"), F.lit(":"), spelt)


def _all(cells: Column) -> Column:
    """Cells of an array one after another; null if one can't be compared."""
    return F.when(~F.exists(cells, lambda x: x.isNull()), F.array_join(F.transform(cells, _framed), ""))


def cell(c: Column, kind: T.DataType) -> Column:
    """A cell in canonical form; null if it can't be compared."""
    if isinstance(kind, _INTEGERS):
        spelt = _integer(c.cast("bigint"))
    elif isinstance(kind, T.DecimalType):
        spelt = _number(c.cast("string"))
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        c = c.cast("double")
        finite = ~F.isnan(c) & (F.abs(c) != float("inf"))
        short = (c == F.floor(c)) & (F.abs(c) < 1e15)
        spelt = F.when(finite, F.when(short, _integer(F.when(short, c).cast("bigint"))).otherwise(_double(c)))
    elif isinstance(kind, T.BooleanType):
        spelt = F.concat(F.lit("bool:"), c.cast("string"))
    elif isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        spelt = F.concat(F.lit("str:"), c)
    elif isinstance(kind, T.BinaryType):
        spelt = F.concat(F.lit("bytes:"), F.hex(c))
    elif isinstance(kind, T.DateType):
        spelt = F.concat(F.lit("date:"), c.cast("string"))
    elif isinstance(kind, T.TimestampType):
        spelt = F.concat(F.lit("datetime:aware:"), F.unix_micros(c).cast("string"))
    elif isinstance(kind, T.TimestampNTZType):
        spelt = F.concat(F.lit("datetime:naive:"), c.cast("string"))
    elif _TIME and isinstance(kind, _TIME):
        spelt = F.concat(F.lit("time:naive:"), c.cast("string"))
    elif isinstance(kind, T.ArrayType):
        spelt = F.concat(F.lit("array:"), _all(F.transform(c, lambda x: cell(x, kind.elementType))))
    elif isinstance(kind, T.StructType):
        fields = [(F.lit(f.name), cell(c[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        spelt = F.concat(F.lit("object:"), _all(F.array(*[x for pair in fields for x in pair])))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        pairs = F.transform(F.array_sort(F.map_keys(c)), lambda k: F.array(k, cell(F.element_at(c, k), kind.valueType)))
        spelt = F.concat(F.lit("object:"), _all(F.flatten(pairs)))
    else:
        spelt = F.lit(None).cast("string")
    return F.when(c.isNull(), "null").otherwise(spelt)


def canonical(df: DataFrame) -> DataFrame:
    """Columns c0, c1, ... of canonical cells: names don't matter, positions do."""
    df = df.toDF(*[f"v{i}" for i in range(len(df.columns))])
    return df.select(*[cell(F.col(f.name), f.dataType).alias(f"c{i}") for i, f in enumerate(df.schema.fields)])


def _hashed(df: DataFrame, side: int) -> DataFrame:
    """h1, h2, side, known of each row."""
    made = canonical(df)
    known = F.lit(True)
    for c in made.columns:
        known = known & F.col(c).isNotNull()
    return made.select(F.xxhash64(F.lit(1), *made.columns).alias("h1"), F.xxhash64(F.lit(2), *made.columns).alias("h2"), F.lit(side).alias("side"), known.alias("known"))


def _compared(a: DataFrame, b: DataFrame, differs: Column) -> DataFrame:
    """One row: comparable, equal (null if not comparable), n_differing (of distinct rows)."""
    same = len(a.columns) == len(b.columns)
    one = _hashed(a, 1).unionByName(_hashed(b, 0))
    each = one.groupBy("h1", "h2").agg(F.sum("side").alias("a"), F.sum(1 - F.col("side")).alias("b"), F.min("known").alias("known"))
    found = each.agg(F.coalesce(F.min("known"), F.lit(True)).alias("comparable"), F.count_if(differs).alias("n_differing"))
    n = F.col("n_differing") if same else F.lit(-1).cast("long")
    return found.select("comparable", F.when(F.col("comparable"), n == 0).alias("equal"), n.alias("n_differing"))


def bag_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """comparable, equal, n_differing: row order doesn't matter, multiplicity does; -1 if the numbers of columns differ."""
    return _compared(a, b, F.col("a") != F.col("b"))


def set_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """As bag_equal, but how often a row occurs doesn't matter."""
    return _compared(a, b, (F.col("a") == 0) | (F.col("b") == 0))


def ordered_equal(a: DataFrame, b: DataFrame, key_a: list[str], key_b: list[str]) -> DataFrame:
    """Equality row by row, in the order of a declared total key, whose columns are compared too."""
    place = lambda df, key: global_rank(df.withColumn("order_key", F.struct(*key)), "order_key").drop("order_key")
    return bag_equal(place(a, key_a), place(b, key_b))


def result_status(rows: DataFrame, item: str, columns: list[str]) -> DataFrame:
    """empty_result, all_null_result or success of each item's result rows; an item without rows has null in `has_row`."""
    filled = F.count_if(F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull())
    n = F.count_if(F.col("has_row").isNotNull())
    return rows.groupBy(item).agg(n.alias("n_rows"), F.when(n == 0, "empty_result").when(filled == 0, "all_null_result").otherwise("success").alias("status"))
