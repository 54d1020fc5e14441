"""Secrets in texts: three base patterns, and strings that a battery of randomness tests finds; DataFrame functions only.

A candidate is a run of 20 or more characters of the base64 alphabets, which ends at a '=' that it is padded by; where a run mixes both
alphabets' signs, its pieces between the signs of either one are. Its encoding (hex, base32, lower-case and digits,
letters, letters and digits, base64) gives the alphabet. The battery: chi-squared over the alphabet, runs above and below
its middle, serial correlation at lag 1. Their three p-values for a random string, combined by Fisher's method, must not be below LEVEL.

Each test also has a p-value for an ordinary string of that encoding, whose letters meet, change kind (lower, upper, digit,
sign) and correlate with the next as the table of alphabets says: chi-squared by its noncentral distribution, changes of kind by
Chernoff's bound, serial correlation by the normal. Fisher's combination of these says how surely a string isn't ordinary.
Over all candidates of the corpus, by octave of length, Benjamini-Hochberg at FALSE bounds the share of false discoveries; the ranks
come from a histogram of bounded size.

Spans are kind:start:end in code points, end exclusive. Null texts are empty and have none. Each row is judged by itself but
for the thresholds, so that repeated rows give the same spans. Other columns are ignored. Time goes with a text's length and the
power 3/2 of its number of spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hof import blocks_of, let, part, running

#: Fixed patterns: (kind, where it matches, least length, group whose length counts).
VALUE = r"([A-Za-z0-9+/_.=-]+)"
BASE = [
    ("assign", rf"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?{VALUE}""", 12, 2),
    ("access", r"AKIA[A-Z0-9]{14,}", 18, 0),
    ("hex", r"[0-9a-f]{16,}", 16, 0),
]
KINDS = [k for k, *_ in BASE] + ["random"]
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}=*"
#: What is looked for in a candidate that no alphabet fits.
PIECES = [r"[A-Za-z0-9_-]{20,}=*", r"[A-Za-z0-9+/]{20,}=*"]
#: Fixed alphabets, in the order in which they are tried, each with how ordinary strings use it: the chance that two letters are
#: the same, and that the next one is of another kind.
DIGITS, UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
ALPHABETS = [
    (r"[0-9A-F]+", DIGITS + "ABCDEF", 0.1, 0.1), (r"[0-9a-f]+", DIGITS + "abcdef", 0.1, 0.1), (r"[A-Z2-7]+", UPPER + "234567", 0.066, 0.1), (r"[0-9a-z]+", DIGITS + LOWER, 0.066, 0.2),
    (r"[A-Za-z]+", UPPER + LOWER, 0.06, 0.4), (r"[0-9A-Za-z]+", DIGITS + UPPER + LOWER, 0.06, 0.45), (r"[0-9A-Za-z+/]+", UPPER + LOWER + DIGITS + "+/", 0.06, 0.45), (r"[0-9A-Za-z_-]+", UPPER + LOWER + DIGITS + "-_", 0.06, 0.45),
]
#: Serial correlation of ordinary strings; the least combined p-value of a random string; the share of false discoveries.
RHO, LEVEL, FALSE = 0.2, 0.001, 0.01
#: Histogram of -ln p: bins a unit, and the last bin.
BINS, TOP = 4, 400
SPAN = "struct<at:bigint,kind:int,to:bigint,body:string>"


def _text(name: str) -> Column:
    """The text without the two characters that mark spans here, which no pattern has."""
    text = F.coalesce(F.col(name).cast("string"), F.lit(""))
    return F.when(text.contains("\x01") | text.contains("\x02"), F.translate(text, "\x01\x02", "\x03\x03")).otherwise(text)


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """Spans of the leftmost non-overlapping matches: each is marked, and lengths between marks add up to its place."""
    pieces = F.split(F.regexp_replace(text, F.lit(pattern), F.lit("\x01$0\x02")), "\x01")

    def found(p: Column) -> Column:
        sizes = F.transform(p, lambda x, i: (F.length(x) - F.when(i > 0, 1).otherwise(0)).cast("bigint"))

        def span(place: Column, piece: Column, i: Column) -> Column:
            body = F.substring_index(piece, "\x02", 1)
            return F.struct(F.get(place, i).alias("at"), F.lit(kind).alias("kind"), (F.get(place, i) + F.length(body)).alias("to"), body.alias("body"))

        return let(running(sizes, lambda a, b: a + b, 0), lambda s: F.transform(F.slice(p, F.lit(2), F.size(p)), lambda x, i: span(s, x, i)))

    return F.when(text.rlike(pattern), let(pieces, found)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _base(text: Column) -> Column:
    found = []
    for kind, (_, pattern, least, group) in enumerate(BASE):
        long = lambda x, p=pattern, n=least, g=group: F.length(F.regexp_extract(x["body"], p, g)) >= n
        found.append(F.filter(_matches(text, pattern, kind), (lambda f: lambda x: f(x))(long)))
    return F.concat(*found)


def _unlikely(z: Column) -> Column:
    """-ln of the normal distribution function, by its logistic approximation."""
    return F.log1p(F.exp(F.least(F.lit(500.0), -1.5976 * z - 0.07056 * z * z * z)))


def _fisher(*surprises: Column) -> Column:
    """-ln of the combined p-value of three tests, from theirs: half of a chi-squared variable of six degrees of freedom."""
    total = sum(surprises[1:], surprises[0])
    return let(total, lambda s: s - F.log(1 + s + s * s / 2))


def _kind_of(sign: Column) -> Column:
    return F.when(sign.between("0", "9"), 0).when(sign.between("A", "Z"), 1).when(sign.between("a", "z"), 2).otherwise(3)


def battery(text: Column) -> Column:
    """struct(at, to, n, k, chi, runs, serial, turns, random, ordinary) of each candidate in a text: its length and its alphabet's, the
    chi-squared statistic, the runs' and the correlation's deviation in standard errors, how often the kind of letter changes, and -ln of the combined
    p-values of a random and of an ordinary string."""

    def known(x: Column) -> Column:
        body = F.rtrim(x["body"], F.lit("="))
        which = F.lit(None).cast("int")
        for k, (pattern, *_) in reversed(list(enumerate(ALPHABETS))):
            which = F.when(body.rlike(f"^{pattern}$"), F.lit(k)).otherwise(which)
        return F.struct(x["at"].alias("at"), x["to"].alias("to"), body.alias("body"), which.alias("which"))

    def cut(x: Column) -> Column:
        """The candidate, or its pieces if it mixes alphabets."""
        mixed = x["body"].rlike("[+/]") & x["body"].rlike("[_-]")
        moved = lambda y: F.struct((x["at"] + y["at"]).alias("at"), y["kind"].alias("kind"), (x["at"] + y["to"]).alias("to"), y["body"].alias("body"))
        parts = F.concat(*[F.transform(_matches(x["body"], p, len(BASE)), moved) for p in PIECES])
        return F.when(mixed, parts).otherwise(F.array(x))

    def of(column: int, x: Column) -> Column:
        return F.get(F.array(*[F.lit(a[column]) for a in ALPHABETS]), x["which"])

    def placed(x: Column) -> Column:
        signs = F.split(x["body"], "")
        letters = of(1, x)
        number = F.transform(signs, lambda c: (F.position(c, letters) - 1).cast("double"))
        same = F.aggregate(F.array_distinct(signs), F.lit(0.0), lambda a, c: a + F.pow(F.length(x["body"]) - F.length(F.replace(x["body"], c, F.lit(""))), F.lit(2.0)))
        return F.struct(
            x["at"].alias("at"), x["to"].alias("to"), F.length(x["body"]).cast("double").alias("n"), F.length(letters).cast("double").alias("k"),
            of(2, x).alias("meet"), of(3, x).alias("turn"), number.alias("x"), F.transform(signs, _kind_of).alias("kinds"), same.alias("same"),
        )

    def measured(x: Column) -> Column:
        n = x["n"]
        ahead = lambda v: F.slice(v, F.lit(1), F.size(v) - 1)
        after = lambda v: F.slice(v, F.lit(2), F.size(v) - 1)
        changes = lambda v: F.size(F.filter(F.zip_with(ahead(v), after(v), lambda a, b: a != b), lambda d: d)).cast("double")
        high = F.transform(x["x"], lambda v: v >= x["k"] / 2)
        mean = F.aggregate(x["x"], F.lit(0.0), lambda a, v: a + v) / n
        n1 = F.size(F.filter(high, lambda h: h)).cast("double")
        spread = lambda m: F.aggregate(x["x"], F.lit(0.0), lambda a, v: a + (v - m) * (v - m))
        joint = lambda m: F.aggregate(F.zip_with(ahead(x["x"]), after(x["x"]), lambda a, b: (a - m) * (b - m)), F.lit(0.0), lambda a, v: a + v)
        serial = let(mean, lambda m: F.try_divide(joint(m), spread(m)))
        twice = 2 * n1 * (n - n1)
        runs = F.try_divide(changes(high) - twice / n, F.sqrt(F.greatest(F.lit(0.0), twice * (twice - n) / (n * n * (n - 1)))))
        return F.struct(
            x["at"].alias("at"), x["to"].alias("to"), n.alias("n"), x["k"].alias("k"), x["meet"].alias("meet"), x["turn"].alias("turn"),
            (x["k"] * x["same"] / n - n).alias("chi"), runs.alias("runs"), (serial * F.sqrt(n)).alias("serial"), changes(x["kinds"]).alias("turns"),
        )

    def judged(x: Column) -> Column:
        n, free, turn = x["n"], x["k"] - 1, x["turn"]
        cube = (F.cbrt(x["chi"] / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
        both = lambda z: F.greatest(F.lit(0.0), _unlikely(-F.abs(z)) - math.log(2))
        random = _fisher(_unlikely(-cube), both(x["runs"]), both(x["serial"]))
        shift = (n - 1) * (x["k"] * x["meet"] - 1)
        alike = _unlikely((x["chi"] - free - shift) / F.sqrt(2 * free + 4 * shift))
        often = x["turns"] / (n - 1)
        gain = lambda p, q: F.when(p > 0, p * F.log(p / q)).otherwise(0.0)
        kinds = F.when(often > turn, (n - 1) * (gain(often, turn) + gain(1 - often, 1 - turn))).otherwise(0.0)
        ordinary = _fisher(alike, kinds, _unlikely(x["serial"] - RHO * F.sqrt(n)))
        kept = [x[c].alias(c) for c in ("at", "to", "n", "k", "chi", "runs", "serial", "turns")]
        return F.struct(*kept, random.alias("random"), ordinary.alias("ordinary"))

    runs = F.flatten(F.transform(_matches(text, CANDIDATE, len(BASE)), cut))
    some = F.filter(F.transform(runs, known), lambda x: x["which"].isNotNull() & (F.length(x["body"]) >= 20))
    return F.transform(F.transform(F.transform(some, placed), measured), judged)


def _candidates(text: Column) -> Column:
    """struct(at, to, octave, bin) of each candidate: bin is of -ln p of an ordinary string, or -1 if it isn't a random one either."""

    def binned(x: Column) -> Column:
        random = F.coalesce(x["random"] <= -math.log(LEVEL), F.lit(False))
        place = F.when(random, F.least(F.lit(TOP), F.floor(x["ordinary"] * BINS).cast("int"))).otherwise(-1)
        return F.struct(x["at"].alias("at"), x["to"].alias("to"), F.floor(F.log2(x["n"])).cast("int").alias("octave"), place.alias("bin"))

    return F.transform(battery(text), binned)


def thresholds(docs: DataFrame, text: str = "text") -> dict[int, int]:
    """octave → least bin that counts as random; octaves without a discovery are left out."""
    found = docs.select(F.explode(_candidates(_text(text))).alias("c")).groupBy("c.octave", "c.bin").count()
    rows = sorted(((r["octave"], r["bin"], r["count"]) for r in found.collect()), reverse=True)  # at most 402 bins an octave
    out: dict[int, int] = {}
    for octave in {o for o, _, _ in rows}:
        own = [(b, n) for o, b, n in rows if o == octave]
        total, seen = sum(n for _, n in own), 0
        for b, n in own:
            seen += n
            if b >= 0 and total * math.exp(-b / BINS) <= FALSE * seen:
                out[octave] = b
    return out


#: Columns that spans() makes on its way, each computed once.
_BASE, _OWN, _MARKS, _REACH, _NEXT = (f"secret_{x}\x01" for x in ("base", "own", "marks", "reach", "next"))


def _apart(docs: DataFrame) -> DataFrame:
    """docs with the spans of _OWN that none of _BASE touches: in order of place, none before reaches into them and none begins within."""
    far = 1 << 60
    most = lambda a, b: F.greatest(a, b)
    base, own, marks, reach, next_ = (F.col(f"`{c}`") for c in (_BASE, _OWN, _MARKS, _REACH, _NEXT))
    both = F.concat(
        F.transform(base, lambda x: F.struct(x["at"].alias("at"), x["to"].alias("to"), F.lit(-1).alias("i"))),
        F.transform(own, lambda x, i: F.struct(x["at"].alias("at"), x["to"].alias("to"), i.alias("i"))),
    )
    out = docs.withColumn(_MARKS, F.when((F.size(base) > 0) & (F.size(own) > 0), F.array_sort(both)))
    out = out.withColumn(_REACH, running(F.transform(marks, lambda x: F.when(x["i"] < 0, x["to"]).otherwise(F.lit(-far))), most, -far))
    out = out.withColumn(_NEXT, running(F.transform(F.reverse(marks), lambda x: F.when(x["i"] < 0, -x["at"]).otherwise(F.lit(-far))), most, -far))
    free = F.transform(marks, lambda x, k: F.when((F.get(reach, k) <= x["at"]) & (-F.get(next_, F.size(marks) - 1 - k) >= x["to"]), x["i"]).otherwise(-1))
    kept = F.transform(F.filter(free, lambda i: i >= 0), lambda i: F.get(own, i))
    return out.withColumn(_OWN, F.when(marks.isNotNull(), kept).otherwise(own)).drop(_MARKS, _REACH, _NEXT)


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column secret_spans: array of struct(at, kind, to, body), in order of place and kind."""
    least = thresholds(docs, text)
    body = _text(text)
    sure = lambda c: F.coalesce(F.when(c["octave"].isin(list(least)), c["bin"] >= F.element_at(F.create_map(*[F.lit(x) for kv in least.items() for x in kv]), c["octave"])), F.lit(False))
    out = docs.withColumn(_BASE, _base(body))
    if least:
        own = F.transform(F.filter(_candidates(body), sure), lambda c: F.struct(c["at"].alias("at"), F.lit(len(BASE)).alias("kind"), c["to"].alias("to"), F.lit("").alias("body")))
        # a random-looking string that a base span touches is that span already
        out = _apart(out.withColumn(_OWN, own))
        return out.withColumn("secret_spans", F.array_sort(F.concat(f"`{_BASE}`", f"`{_OWN}`"))).drop(_BASE, _OWN)
    return out.withColumn("secret_spans", F.array_sort(F.col(f"`{_BASE}`"))).drop(_BASE)


def spelt(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["at"].cast("string"), x["to"].cast("string"))), ",")


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    found = spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")))
    of = lambda kind: F.size(F.filter("secret_spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("secret_spans", lambda x: x["kind"] < len(BASE))
    counts = [of(k).alias(f"n_{name}") for k, (name, *_) in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(spelt(base), 256).alias("base_sha256"), spelt(F.col("secret_spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of the text replaced, overlapping spans by one mark; n_chars, if there is one, counts anew."""
    whole = F.col(text).cast("string")

    def without(blocks: Column) -> Column:
        def joined(reach: Column) -> Column:
            """What lies between the spans, each followed by a mark, then the rest; reach: how far the spans up to each go."""
            before = lambda i: F.coalesce(F.get(reach, i - 1), F.lit(0).cast("bigint"))
            gap = F.transform("secret_spans", lambda x, i: F.when(x["at"] >= before(i), F.concat(part(blocks, before(i), x["at"]), F.lit(mark))).otherwise(""))
            return F.concat(F.array_join(gap, ""), part(blocks, F.element_at(reach, -1), F.length(whole).cast("bigint")))

        return let(running(F.transform("secret_spans", lambda x: x["to"]), lambda a, b: F.greatest(a, b), 0), joined)

    found = spans(docs, text)
    out = found.withColumn(text, F.when(F.size("secret_spans") > 0, let(blocks_of(whole), without)).otherwise(whole))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("secret_spans") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
