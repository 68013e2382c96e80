"""Landed pages of a list as a chain: broken records kept apart, repeated pages dropped, gaps, overlaps and open ends told.

A list is read page by page: each page names its offset, and the next page until the last one.  What has landed may lack pages, hold
some twice, or end while a next page is named.  Such lists are told and not silently shortened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonearm.operators.filters import LIST

BROKEN = "_broken"
COMPLETE, GAP, OVERLAP, OPEN, NO_START = "complete", "gap", "overlap", "open end", "no first page"


def records(lines: DataFrame, schema: T.StructType, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good, broken): lines of JSON as records of the schema, and the lines that are none, or name no user, list or offset."""
    whole = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])
    read = lines.select(F.col(line).alias("line"), F.from_json(line, whole, {"columnNameOfCorruptRecord": BROKEN}).alias("r"))
    keys = [f.name for f in schema.fields if f.name in (*LIST, "offset", "seq")]
    bad = F.col("r").isNull() | F.col(f"r.{BROKEN}").isNotNull()
    for k in keys:
        bad = bad | F.col(f"r.{k}").isNull()
    return read.where(~bad).select(*(F.col(f"r.{f.name}").alias(f.name) for f in schema.fields)), read.where(bad).select("line")


def once(pages: DataFrame) -> DataFrame:
    """Pages (user_id, playlist_id, offset, next, items) without those that landed more than once; of different ones at an offset, the longest."""
    best = F.max(F.struct(F.coalesce(F.size("items"), F.lit(0)).alias("n"), F.to_json(F.struct("items")).alias("told"), "next", "items"))
    grouped = pages.groupBy(*LIST, "offset").agg(best.alias("r"))
    return grouped.select(*LIST, "offset", F.col("r.next").alias("next"), F.col("r.items").alias("items"))


def verdicts(pages: DataFrame) -> DataFrame:
    """(user_id, playlist_id, n_pages, n_repeated, n_items, verdict) of each list; verdict is the first fault from its start, else complete.

    n_items counts the items of pages taken once.  A page is as long as its items, null items too.
    """
    # dealt by list at once, so that neither counting nor the windows shuffle them again
    slim = pages.select(*LIST, "offset", "next", F.coalesce(F.size("items"), F.lit(0)).alias("n")).repartition(*LIST)
    distinct = slim.groupBy(*LIST, "offset").agg(F.max(F.struct("n", "next")).alias("r"), F.count("*").alias("times")).select(*LIST, "offset", "r.n", "r.next", "times")
    by = Window.partitionBy(*LIST).orderBy("offset")
    end = F.lag(F.col("offset") + F.col("n")).over(by)
    first, last = F.row_number().over(by) == 1, F.lead("offset").over(by).isNull()
    fault = (
        F.when(first & (F.col("offset") > 0), NO_START)
        .when(F.col("offset") > end, GAP)
        .when(F.col("offset") < end, OVERLAP)
        .when(last & F.col("next").isNotNull(), OPEN)
    )
    told = distinct.withColumn("fault", fault)
    grouped = told.groupBy(*LIST).agg(F.count("*").alias("n_pages"), F.sum(F.col("times") - 1).alias("n_repeated"), F.sum("n").cast("bigint").alias("n_items"), F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("offset"))).alias("fault"))
    return grouped.select(*LIST, "n_pages", "n_repeated", "n_items", F.coalesce("fault", F.lit(COMPLETE)).alias("verdict"))


def complete(pages: DataFrame) -> DataFrame:
    """The pages, each once, of lists whose chain is whole: what a scan may take.

    Pages are dealt by list once, with what is told of their list; repeated ones are told apart where they then lie, as once() does.
    """
    good = verdicts(pages).where(F.col("verdict") == COMPLETE).select(*LIST, (F.col("n_repeated") > 0).alias("repeated"))
    rows = pages.join(good, LIST).withColumns({"n": F.coalesce(F.size("items"), F.lit(0)), "told": F.when(F.col("repeated"), F.to_json(F.struct("items")))})
    best = Window.partitionBy(*LIST, "offset").orderBy(*(F.desc(c) for c in ("n", "told", "next", "items")))
    return rows.withColumn("rank", F.row_number().over(best)).where("rank = 1").select(*LIST, "offset", "next", "items")
