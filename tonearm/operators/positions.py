"""Places in ordered lists of any length, and lists cut into segments: no list has to fit one task.

A window by list puts a whole list into one task.  Lists with more than `most` rows are therefore numbered in two phases: their
rows are dealt by ranges of the list and the order, so that a long list lies over many chunks; each chunk is numbered alone;
and the rows of the chunks before it, one count a chunk, are added.  All other lists take the window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearm import tables

#: Rows of a list that one task numbers at most.
MOST = 1_000_000


def number(rows: DataFrame, keys: list[str], order: list[str], name: str = "position", most: int = MOST) -> DataFrame:
    """rows and their place, from 0, in the list that keys name; the order columns tell all rows of a list apart."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    long = tables.write(sizes.where(F.col("__n") > most).select(*keys))
    if long.isEmpty():
        return _by_list(rows, keys, order, name)
    same = None
    for k in keys:
        one = rows[k].eqNullSafe(long[k])
        same = one if same is None else same & one
    # at most one list in `most` rows is long: 100 TB of rows of 100 bytes hold a million such names at the default
    return _by_list(rows.join(long, same, "left_anti"), keys, order, name).unionByName(_by_chunk(rows.join(long, same, "left_semi"), keys, order, name))


def _by_list(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return rows.withColumn(name, at.cast("bigint"))


def _by_chunk(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """The two phases.  The dealt rows are written first, so a lost executor cannot deal them anew in another way."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tables.write(rows.repartitionByRange(n, *keys, *order).withColumn("__chunk", F.spark_partition_id()))
    held = dealt.groupBy(*keys, "__chunk").agg(F.count("*").alias("__rows"))
    before = F.sum("__rows").over(Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1))
    starts = held.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__chunk").alias("__of"), F.coalesce(before, F.lit(0)).alias("__start"))
    local = F.row_number().over(Window.partitionBy("__chunk", *keys).orderBy(*order)) - 1
    met = dealt["__chunk"] == starts["__of"]
    for k in keys:
        met = met & dealt[k].eqNullSafe(starts[f"__{k}"])
    # one row a chunk of a long list, of which there are at most as many as chunks and lists together
    placed = dealt.withColumn("__local", local).join(F.broadcast(starts), met)
    return placed.withColumn(name, F.col("__start") + F.col("__local")).select(*rows.columns, name)


def segments(rows: DataFrame, keys: list[str], value: str, size: int, position: str = "position") -> DataFrame:
    """(keys, segment, values): numbered rows in runs of `size`, the last one short; a list is as many rows as it has runs."""
    at = F.floor(F.col(position) / size).cast("bigint")
    grouped = rows.groupBy(*keys, at.alias("segment")).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("at"), F.col(value).alias("v")))).alias("r"))
    return grouped.select(*keys, "segment", F.transform("r", lambda x: x["v"]).alias("values"))
