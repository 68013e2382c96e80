"""Which keywords stand inside which texts, for many keywords: an equi-join on grams, then the comparison itself.

A keyword inside a text brings all its grams of Q characters with it, so one of them is enough to find the pair.  Each keyword takes
the one that the fewest texts have, and keywords with a gram that no text has are out.  Keywords shorter than Q are their own
gram.  No text meets a keyword that does not share such a gram with it, and no join is a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonearm import schemas, tables

Q = 3


def _grams(text: Column, size: int) -> Column:
    """The distinct grams of `size` characters, none for a shorter text, the empty one for size 0."""
    if size == 0:
        return F.array(F.lit(""))
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (size - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def matches(texts: DataFrame, keywords: DataFrame, text: str = "text", keyword: str = "keyword") -> DataFrame:
    """(text, keyword) of each distinct text and keyword that stands in it; the empty keyword stands in every text."""
    words = keywords.select(F.col(keyword).alias("keyword")).where("keyword is not null").distinct()
    short = [r["n"] for r in words.select(F.length("keyword").alias("n")).where(F.col("n") < Q).distinct().collect()]  # Q values at most
    own = texts.select(F.col(text).alias("text")).where("text is not null").distinct()
    sizes = sorted({Q, *short})
    cut = own.select("text", F.explode_outer(F.flatten(F.array(*(_grams(F.col("text"), n) for n in sizes)))).alias("gram"))
    cut = tables.write(cut.where("gram is not null"))
    counts = cut.groupBy("gram").agg(F.count("*").alias("texts"))
    parts = F.when(F.length("keyword") < Q, F.array("keyword")).otherwise(_grams(F.col("keyword"), Q))
    each = words.select("keyword", F.explode_outer(parts).alias("gram"))
    told = each.join(counts, "gram", "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    rarest = told.groupBy("keyword").agg(F.min(F.struct("texts", "gram")).alias("r")).where("r.texts > 0").select("keyword", F.col("r.gram").alias("gram"))
    return cut.join(rarest, "gram").where(F.contains("text", F.col("keyword"))).select("text", "keyword")


def normalize(genres: DataFrame, rule_table: DataFrame) -> DataFrame:
    """What classify.normalize gives, for rule tables too large to meet every genre: (genre, bucket, priority)."""
    all_genres = genres.select("genre").distinct().withColumn("text", F.lower("genre"))
    met = matches(all_genres, rule_table).join(rule_table.select("keyword", "priority", "bucket"), "keyword")
    first = met.groupBy("text").agg(F.min_by("bucket", "priority").alias("bucket"), F.min("priority").alias("priority"))
    return all_genres.join(first, "text", "left").select("genre", F.coalesce("bucket", F.lit(schemas.OTHER)).alias("bucket"), "priority")
