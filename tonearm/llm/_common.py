"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm import tables
from tonearm.tables import discard  # noqa: F401

#: Characters that separate words everywhere in this subpackage: space, tab, LF, VT, FF, CR.
SPACE = r"\x20\x09-\x0D"
#: Most rows of a batch that goes to Python.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """Write df once into the shared folder and read it back: the lineage ends there and survives lost executors.

    batch_rows: most rows of the batches that go to Python during this write; the session's setting comes back after it.
    """
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if batch_rows:
        spark.conf.set(name, str(batch_rows))
    try:
        return tables.write(df)
    finally:
        spark.conf.set(name, before)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def in_small_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema), in batches small enough that whole texts take little memory on either side.

    Every function of this subpackage that gets texts goes this way.  The session keeps the setting, as Spark reads it
    when the action runs; a smaller one of the session stays.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts as UTF-8; null becomes the empty text."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def slices(texts: list, most: int) -> Iterator[tuple[int, int]]:
    """Cut a list into runs of at most `most` characters in all; a longer text stands alone."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
