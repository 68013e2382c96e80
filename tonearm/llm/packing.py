"""Conflict-constrained best-fit packing.

Documents are cut into pieces of at most `capacity` tokens (words); full pieces fill a bin each, the others are packed by
best fit, largest first.  Open bins are ordered by their residual and carry two bitmaps: the sources and the duplicate
clusters they hold.  A piece goes to the tightest bin that has room and neither bit set; the successor search walks up
the order until it finds one, else a new bin opens.

Pieces are dealt by a hash of what they hold to shards of about SHARD pieces, so copies and pieces of one source spread evenly, and
each shard is packed alone: no task holds more than a shard, and the tightest bin is sought among the shard's bins.  Pieces that agree in
everything are numbered first, so that a hot row spreads too and the bins depend on the rows alone, not on their
files.  Only ids and sizes are shuffled, never texts.

Defined results: null and empty texts have no tokens and take a place in no bin (bin null); a null source or cluster conflicts
with nothing; ties in size go by id, part, source and cluster; repeated rows are packed each for itself; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm import _common as c

CAPACITY = 2048
SHARD = 2048


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """Bin number of each item; items are taken in the given order."""
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    source_bit: dict = {}
    cluster_bit: dict = {}
    held_sources: list[int] = []
    held_clusters: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s = 0 if source is None else 1 << source_bit.setdefault(source, len(source_bit))
        k = 0 if cluster is None else 1 << cluster_bit.setdefault(cluster, len(cluster_bit))
        at = bisect_left(order, (size, -1))
        while at < len(order) and (held_sources[order[at][1]] & s or held_clusters[order[at][1]] & k):
            at += 1
        if at < len(order):
            room, number = order.pop(at)
        else:
            room, number = capacity, len(held_sources)
            held_sources.append(0)
            held_clusters.append(0)
        held_sources[number] |= s
        held_clusters[number] |= k
        if room > size:
            insort(order, (room - size, number))
        out.append(number)
    return out


def pieces(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None) -> DataFrame:
    """(id, source, cluster, part, start, tokens): pieces of whole texts; without a cluster column, equal words make a cluster."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    count = F.regexp_count(text, F.lit(f"[^{c.SPACE}]+")).cast("bigint")
    cluster = F.col(cluster_col).cast("string") if cluster_col else F.xxhash64(F.regexp_replace(F.lower(text), f"[{c.SPACE}]+", " ")).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), cluster.alias("cluster"), count.alias("n"))
    starts = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1, F.lit(capacity))).otherwise(F.array(F.lit(0).cast("bigint")))
    rows = rows.select("id", "source", "cluster", "n", F.posexplode(starts).alias("part", "start"))
    return rows.select("id", "source", "cluster", "part", "start", F.least(F.lit(capacity), F.col("n") - F.col("start")).cast("bigint").alias("tokens"))


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(id, part, start, tokens, source, cluster, bin): bin is text, shard and number, the same for the pieces of a bin."""
    keys = ["id", "source", "cluster", "part", "start", "tokens"]
    alike = cut.groupBy(*keys).agg(F.count("*").alias("copies"))
    cut = c.materialise(alike.select(*keys, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")))
    n = cut.where("tokens between 1 and %d" % (capacity - 1)).count()
    shards = max(1, -(-n // SHARD))
    name = F.md5(F.to_json(F.struct("id", "source", "cluster", "part", "copy")))
    whole = cut.where(F.col("tokens") >= capacity).withColumn("bin", F.concat(F.lit("full-"), name))
    none = cut.where("tokens = 0").withColumn("bin", F.lit(None).cast("string"))
    rest = cut.where(F.col("tokens").between(1, capacity - 1)).withColumn("shard", F.pmod(F.xxhash64("id", "source", "cluster", "part", "copy"), F.lit(shards)).cast("int"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["tokens", "id", "part", "source", "cluster", "copy"], ascending=[False, True, True, True, True, True], kind="stable")
        sources = [None if pd.isna(x) else x for x in group["source"]]
        clusters = [None if pd.isna(x) else x for x in group["cluster"]]
        numbers = best_fit(group["tokens"].tolist(), sources, clusters, capacity)
        shard = group["shard"].iloc[0]
        return group.drop(columns=["shard", "copy"]).assign(bin=[f"{shard}-{k}" for k in numbers])

    names = ["id", "source", "cluster", "part", "start", "tokens", "bin"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name != "copy") + ", bin string"
    packed = rest.groupBy("shard").applyInPandas(run, schema)
    return packed.select(*names).unionByName(whole.select(*names)).unionByName(none.select(*names))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None) -> DataFrame:
    out = pack(pieces(docs, capacity, id_col, text_col, source_col, cluster_col), capacity)
    return out.withColumnRenamed("id", id_col)
