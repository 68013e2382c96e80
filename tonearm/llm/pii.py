"""Personal data by patterns, checksum validators and context words; DataFrame functions only.

Patterns propose spans, validators confirm them (Luhn for cards, mod-97 for bank accounts, ranges for addresses, digit
counts for phones), and words near a span raise its score.  A kind without a validator of its own (social security
numbers) needs such words.  Positions are code points, the end is exclusive.  Each row is worked on alone: no shuffle.

The patterns are written so that the regular-expression engine neither recurses nor rescans on long texts; they match
what the plain forms in the comments match.

Defined results: null text is the empty text, without spans; null ids and repeated rows pass through; extra columns
are ignored by find() and kept by mask().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind: (pattern, characters without which no match is possible, score if valid).  Order is the order of kinds.
KINDS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6),
    # [0-9]([\x20-]?[0-9])+
    "card": (r"[0-9]++(?:[\x20-][0-9]++)*+", "", 0.8),
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", "", 0.8),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3),
}
BASE = ("email", "ip", "card", "phone")
#: Words that raise the score of a span within WINDOW characters.
CONTEXT = {
    "email": ["mail", "contact", "write to"],
    "ip": ["address", "host", "server", "client"],
    "card": ["card", "credit", "visa", "payment"],
    "phone": ["phone", "call", "mobile", "fax"],
    "iban": ["iban", "bank", "account"],
    "ssn": ["ssn", "social security"],
}
WINDOW = 40
BOOST = 0.3
#: Entries that one fold gathers, and characters of the blocks that a text is cut into; neither bounds anything.
CHUNK, BLOCK = 128, 256
#: Spans of the kinds beyond BASE stay from this score on.
LEAST_SCORE = 0.5


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)
    digit = lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int")
    part = lambda i: F.when(i % 2 == 1, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + part(i)) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number without spaces leaves 1 modulo 97, its first four characters moved to the end."""
    turned = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))
    value = lambda ch: F.when(ch.rlike("[0-9]"), ch.cast("int")).otherwise(F.ascii(ch) - 55)
    step = lambda acc, ch: (acc * F.when(ch.rlike("[0-9]"), 10).otherwise(100) + value(ch)) % 97
    return F.aggregate(F.filter(F.split(turned, ""), lambda ch: ch != ""), F.lit(0), step) == 1


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(match, " ", ""))
    return F.lit(True)


def _scan(values: str, add: Callable[[Column, Column], Column]) -> Column:
    """For each entry of an array column of numbers, all entries before it added up, from 0.

    A fold copies the array that it builds at every step, so the entries are taken in runs of CHUNK: first the sum of each
    run, then the sums before each run, then the entries of each run.
    """
    out = F.array().cast("array<int>")
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")), lambda k: F.slice(values, k * CHUNK + 1, CHUNK))

    def before(array: Column, start: Column) -> Column:
        step = lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(array, F.struct(start.alias("at"), out.alias("out")), step, lambda acc: acc["out"])

    starts = before(F.transform(runs, lambda run: F.aggregate(run, F.lit(0), add)), F.lit(0))
    long = F.flatten(F.zip_with(runs, starts, before))
    return F.when(F.size(values) == 0, out).when(F.size(values) <= CHUNK, before(F.col(values), F.lit(0))).otherwise(long)


def _cut(start: Column, end: Column) -> Column:
    """The characters start..end of the text, from the blocks that hold them: a plain substring walks from the text's start."""
    first = F.floor(start / BLOCK).cast("int")
    some = F.slice("__blocks", first + 1, F.floor(end / BLOCK).cast("int") - first + 1)
    return F.substring(F.array_join(some, ""), start % BLOCK + 1, end - start)


def _confirmed(kind: str, found: str) -> Column:
    """Array of (start, order, finish, kind, score) of the valid spans."""
    order, base = list(KINDS).index(kind), KINDS[kind][2]

    def near(x: Column) -> Column:
        around = F.lower(_cut(F.greatest(x["start"] - WINDOW, F.lit(0)), F.least(x["finish"] + WINDOW, F.col("__n"))))
        told = F.lit(False)
        for word in CONTEXT[kind]:
            told = told | F.contains(around, F.lit(word))
        return F.lit(base) + F.when(told, BOOST).otherwise(0.0)

    spans = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), x["finish"].alias("finish"), F.lit(kind).alias("kind"), near(x).alias("score")))
    return spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= LEAST_SCORE)


def _each(make: Callable[[str], Column], name: str) -> dict[str, Column]:
    return {f"__{name}_{k}": make(k) for k in KINDS}


def with_spans(docs: DataFrame, text_col: str, out: str = "__spans") -> DataFrame:
    """docs and an array of (start, order, finish, kind, score), by start, then by the order of kinds.

    Every step is linear in the text and in its matches: the places come from running sums over the lengths of the matches and of
    what lies between them.  The columns __n and __blocks that _cut() reads stay.
    """
    t = F.col("__text")
    df = docs.withColumn("__text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))

    def possible(kind: str) -> Column:
        needs = KINDS[kind][1]
        return F.contains(t, F.lit(needs)) if needs else t.rlike("[0-9]")

    matches = lambda k: F.when(possible(k), F.regexp_extract_all(t, F.lit(KINDS[k][0]), F.lit(0))).otherwise(F.array().cast("array<string>"))
    gaps = lambda k: F.when(F.size(f"__match_{k}") > 0, F.transform(F.split(t, KINDS[k][0], -1), F.length)).otherwise(F.array().cast("array<int>"))
    lengths = lambda k: F.zip_with(F.slice(f"__gap_{k}", 1, F.size(f"__match_{k}")), f"__match_{k}", lambda g, m: g + F.length(m))
    df = df.withColumns(_each(matches, "match"))
    df = df.withColumns(_each(gaps, "gap"))
    df = df.withColumns(_each(lengths, "length"))
    df = df.withColumns(_each(lambda k: _scan(f"__length_{k}", lambda x, y: x + y), "before"))

    def valid(kind: str) -> Column:
        placed = F.transform(F.arrays_zip(*(F.col(f"__{x}_{kind}").alias(x) for x in ("before", "gap", "match"))), lambda x: F.struct((x["before"] + x["gap"]).alias("start"), (x["before"] + x["gap"] + F.length(x["match"])).alias("finish"), x["match"].alias("match")))
        return F.filter(placed, lambda x: x["match"].isNotNull() & F.coalesce(_valid(kind, x["match"]), F.lit(False)))

    df = df.withColumns(_each(valid, "found"))
    some = F.lit(False)
    for k in KINDS:
        some = some | (F.size(f"__found_{k}") > 0)
    df = df.withColumns({"__n": F.length(t), "__blocks": F.when(some, F.regexp_extract_all(t, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))).otherwise(F.array().cast("array<string>"))})
    df = df.withColumns(_each(lambda k: _confirmed(k, f"__found_{k}"), "span"))
    df = df.withColumn(out, F.array_sort(F.concat(*(F.col(f"__span_{k}") for k in KINDS))))
    return df.select(*docs.columns, out, "__n", "__blocks")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pii): pii is an array of (start, order, finish, kind, score)."""
    return with_spans(docs.select(id_col, F.col(text_col).alias("__in")), "__in").select(id_col, F.col("__spans").alias("pii"))


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; overlapping spans go as one, by the first's kind.

    A column n_chars follows the new text.
    """
    df = with_spans(docs, text_col)
    # where the spans before each one end, and which spans begin after that
    df = df.withColumn("__ends", F.transform("__spans", lambda s: s["finish"]))
    df = df.withColumn("__before", _scan("__ends", lambda x, y: F.greatest(x, y)))
    pairs = F.arrays_zip(F.col("__spans").alias("s"), F.col("__before").alias("at"))
    told = lambda x: F.concat(_cut(x["at"], x["s"]["start"]), F.lit("<"), x["s"]["kind"], F.lit(">"))
    pieces = F.transform(pairs, lambda x: F.when(x["s"]["start"] >= x["at"], told(x)).otherwise(""))
    rest = _cut(F.array_max("__ends"), F.col("__n"))
    df = df.withColumn("__masked", F.when(F.size("__spans") > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col(text_col).cast("string")))
    new = {text_col: F.col("__masked")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("__spans") > 0, F.length("__masked")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return df.withColumns(new).select(*docs.columns)
