"""Benchmark decontamination by winnowing; DataFrame functions only.

A benchmark item is cut into windows of WINDOW consecutive words.  Of every window the smallest hash of its K-word grams is its
fingerprint; neighbouring windows mostly share one, so a text keeps about two fingerprints in seven words.  A span that
document and item share over WINDOW words or more holds a window, and equal windows have equal fingerprints, so joining
the fingerprints misses no such span.  Every hit is extended: the windows around it are read from the document's words and
compared word by word with those of the benchmark.  Items with fewer words than a window are one window of their own length;
the gram that finds them is their first words, as many as the shortest such item has, and it is sought at every place of the
documents, but only if there are such items.

A fingerprint travels as one number: the upper bits of the hash, and the place of its gram modulo 2**PLACE_BITS below them, so
that the smallest number of a window tells both.  Places beyond come back by trying all that fit, and the
comparison decides.  The benchmark's fingerprints and windows are broadcast up to max_broadcast of them; beyond that
the joins shuffle, and Spark splits what is skewed.  Documents with hits are found again by id and hash of the text; so each
document is compared in one row, and only rows of hits are shuffled, not fingerprints.

Defined results: a null or wordless text has no words and no hits; a null or wordless item has no windows; equal windows of several
items count for each of them, and equal item_ids once; repeated rows and null ids of documents each get a row; texts may have any
length; null item_ids are told by no name but their windows hit; an empty benchmark leaves every document clean; columns
other than id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm.llm import _common as c

#: Every ASCII character that is neither a digit nor a letter separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW, K = 10, 5
#: Grams of a window, of which the smallest hash is kept.
GRAMS = WINDOW - K + 1
PLACE_BITS = 20
#: So many fingerprints or windows of the benchmark are broadcast at most, about 100 bytes each.
MAX_BROADCAST = 200_000


def words(text: Column) -> Column:
    """The words as they stand; case is folded where they are hashed or compared."""
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), SEPARATORS), lambda w: w != "")


def _folded(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _each(array: Column | str) -> Column:
    """One row for each entry, a null one for none.

    The plain explode makes Spark filter by the array's size below it, and so work out the whole array, and all that it is
    made of inside other arrays' functions, once more for each use.  The joins that follow drop the nulls.
    """
    return F.explode_outer(array)


def _hashes(df: DataFrame, word_col: str) -> DataFrame:
    """df with __h: a hash of each word.  It folds the case of all letters, which may only add hits."""
    return df.withColumn("__h", F.transform(word_col, lambda w: F.xxhash64(F.lower(w))))


def _packed(grams: int, seed: int) -> Column:
    """Of the word hashes __h: each gram's hash in the upper bits and its place below, in order of the places."""
    low = 2**PLACE_BITS - 1

    def one(h: Column, i: Column) -> Column:
        gram = F.xxhash64(F.lit(seed), h, *(F.get("__h", i + j) for j in range(1, grams)))
        return gram.bitwiseAND(F.lit(~low)).bitwiseOR(i.bitwiseAND(F.lit(low)).cast("bigint"))

    packed = F.transform("__h", one)
    return F.when(F.size("__h") >= grams, F.slice(packed, 1, F.greatest(F.size("__h") - (grams - 1), F.lit(0))))


def _fingerprints(df: DataFrame, short_grams: int | None) -> DataFrame:
    """df (with __h) with __f: an array of packed fingerprints, those of short grams at every place included where asked for."""
    df = df.withColumn("__g", F.when(F.size("__h") >= WINDOW, _packed(K, 0)))
    least = lambda g, i: F.least(g, *(F.get("__g", i + j) for j in range(1, GRAMS)))
    kept = F.array_distinct(F.slice(F.transform("__g", least), 1, F.greatest(F.size("__g") - (GRAMS - 1), F.lit(0))))
    none = F.array().cast("array<bigint>")
    df = df.withColumn("__f", F.when(F.size("__g") >= GRAMS, kept).otherwise(none))
    if short_grams:
        df = df.withColumn("__s", F.coalesce(_packed(short_grams, 1), none))
        df = df.withColumn("__f", F.concat("__f", "__s")).drop("__s")
    return df.drop("__h", "__g")


def _hash(packed: str) -> Column:
    return F.shiftright(packed, PLACE_BITS)


class Benchmark:
    """The windows of a benchmark and the fingerprints that find them, as tables."""

    def __init__(self, items: DataFrame, id_col: str = "item_id", text_col: str = "text", max_broadcast: int = MAX_BROADCAST):
        self.max_broadcast = max_broadcast
        own = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
        self.short = own.agg(F.min(F.when(F.size("w") < WINDOW, F.size("w")))).first()[0]
        size = F.least(F.size("w"), F.lit(WINDOW))
        spans = F.transform(F.sequence(F.lit(0), F.size("w") - size), lambda i: F.slice("w", i + 1, size))
        windows = own.select("item", _each(spans).alias("w"))
        text = _folded(F.array_join("w", " ")).alias("window")
        # one row a window, and the set of items that have it by one number
        grouped = windows.groupBy(text).agg(F.array_sort(F.collect_set("item")).alias("items"), F.first("w").alias("w"))
        self.windows = c.materialise(grouped.withColumn("items_id", F.sha2(F.to_json("items"), 256)))
        self.n_windows = self.windows.count()
        found = _fingerprints(_hashes(self.windows.select("w"), "w"), None).select("w", "__f")
        if self.short:
            first = _hashes(self.windows.select("w"), "w").where(F.size("w") < WINDOW).withColumn("__h", F.slice("__h", 1, self.short))
            found = found.where(F.size("w") >= WINDOW).unionByName(first.select("w", _packed(self.short, 1).alias("__f")))
        # back: how far before the gram a window may begin; a short window begins with it
        size = F.size("w")
        rows = found.select(size.alias("size"), F.when(size < WINDOW, 0).otherwise(GRAMS - 1).alias("back"), _each("__f").alias("f"))
        self.fingerprints = c.materialise(rows.groupBy(_hash("f").alias("hash")).agg(F.collect_set(F.struct("size", "back")).alias("reach")))

    def sent(self, side: DataFrame) -> DataFrame:
        """A table of the benchmark as the small side of a join: broadcast if it is small."""
        return F.broadcast(side) if self.n_windows <= self.max_broadcast else side


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, hash of the text, text): rows that agree in both are treated as one."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def hits(keyed: DataFrame, benchmark: Benchmark) -> DataFrame:
    """(id, th, reached): the documents with fingerprints of the benchmark, with the places and sizes to look at."""
    made = _fingerprints(_hashes(keyed.select("id", "th", words(F.col("text")).alias("w")), "w"), benchmark.short)
    rows = made.select("id", "th", _each("__f").alias("f"))
    met = rows.withColumn("hash", _hash("f")).join(benchmark.sent(benchmark.fingerprints), "hash")
    each = met.select("id", "th", F.col("f").bitwiseAND(F.lit(2**PLACE_BITS - 1)).cast("int").alias("place"), F.explode("reach").alias("r"))
    return c.materialise(each.groupBy("id", "th").agg(F.collect_set(F.struct("place", "r.size", "r.back")).alias("reached")))


def occurrences(keyed: DataFrame, found: DataFrame, benchmark: Benchmark) -> DataFrame:
    """(id, th, start, finish, items_id): where windows of the benchmark stand in the documents with hits, in word places."""
    docs = keyed.withColumnRenamed("id", "__id").withColumnRenamed("th", "__th")
    joined = docs.join(found, F.col("__id").eqNullSafe(F.col("id")) & (F.col("__th") == F.col("th"))).select("id", "th", "reached", words(F.col("text")).alias("w"))
    n = F.size("w")

    def around(x: Column) -> Column:
        places = F.sequence(x["place"], F.greatest(n - 1, x["place"]), F.lit(2**PLACE_BITS))
        starts = F.flatten(F.transform(places, lambda p: F.sequence(p - x["back"], p)))
        return F.transform(starts, lambda s: F.struct(s.alias("start"), x["size"].alias("size")))

    tried = joined.withColumn("tried", F.array_distinct(F.flatten(F.transform("reached", around))))
    fits = F.filter("tried", lambda x: (x["start"] >= 0) & (x["start"] + x["size"] <= n))
    read = tried.withColumn("read", F.transform(fits, lambda x: F.struct(x["start"], (x["start"] + x["size"]).alias("finish"), F.array_join(F.slice("w", x["start"] + 1, x["size"]), " ").alias("text"))))
    rows = read.select("id", "th", _each("read").alias("x")).select("id", "th", "x.start", "x.finish", _folded(F.col("x.text")).alias("window"))
    return rows.join(benchmark.sent(benchmark.windows.select("window", "items_id")), "window").select("id", "th", "start", "finish", "items_id")


def _covered(spans: Column) -> Column:
    """How many places the sorted (start, finish) spans cover."""
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(acc: Column, x: Column) -> Column:
        fresh = F.greatest(x["finish"] - F.greatest(x["start"], acc["end"]), F.lit(0))
        return F.struct((acc["n"] + fresh).alias("n"), F.greatest(acc["end"], x["finish"]).alias("end"))

    return F.aggregate(spans, state, step, lambda acc: acc["n"])


def named(sets: DataFrame, benchmark: Benchmark) -> DataFrame:
    """(items_ids, n_items, items_sha256) of each distinct list of item sets: the items are put together once for all documents that have it."""
    told = benchmark.windows.groupBy("items_id").agg(F.first("items").alias("items"))
    each = sets.select("items_ids").distinct().select("items_ids", F.explode("items_ids").alias("items_id")).join(told, "items_id")
    whole = each.groupBy("items_ids").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return whole.select("items_ids", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))


def decontaminate(docs: DataFrame, benchmark: Benchmark, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    keyed = _keyed(docs, id_col, text_col)
    base = keyed.select("id", "th", F.size(words(F.col("text"))).cast("bigint").alias("n_words"))
    if benchmark.n_windows:
        found = occurrences(keyed, hits(keyed, benchmark), benchmark)
        grouped = found.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("start", "finish"))).alias("spans"), F.array_sort(F.collect_set("items_id")).alias("items_ids"))
        dirty = c.materialise(grouped.select("id", "th", _covered(F.col("spans")).cast("bigint").alias("n_hit"), "items_ids"))
        dirty = dirty.join(named(dirty, benchmark), "items_ids").select(F.col("id").alias("__id"), F.col("th").alias("__th"), "n_hit", "n_items", "items_sha256")
        base = base.join(dirty, F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left")
    else:
        base = base.selectExpr("*", "0L as n_hit", "0L as n_items", "cast(null as string) as items_sha256")
    hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return base.select(F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), (hit > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: Benchmark, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that hold a window of the benchmark."""
    keyed = _keyed(docs, id_col, text_col)
    if not benchmark.n_windows:
        return docs
    dirty = occurrences(keyed, hits(keyed, benchmark), benchmark).select(F.col("id").alias("__id"), F.col("th").alias("__th")).distinct()
    same = docs[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))) == F.col("__th"))
    return docs.join(dirty, same, "left_anti")
