"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether an execution's shuffle files go when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, as the cluster names it in spark.checkpoint.dir.

    Only a local master may go without the setting; it then gets a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="tonearm-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def _path(spark: SparkSession, name: str):
    """A Hadoop path and its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, name: str) -> bool:
    path, files = _path(spark, name)
    return files.exists(path)


def inline(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """A small fixed table that stands in the plan itself: its size is known and no Python worker has to bring it.

    rows hold whole numbers and texts; names are column names, comma-separated.
    """
    text = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(x, str) else str(x)
    values = ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)
    return spark.sql(f"select * from values {values} as t({names})")


def write(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write df once and read it back: the plan starts anew there and survives lost executors.

    codec: how the files are compressed, if not as the session says; zstd halves ids that are digests, snappy leaves them whole.

    The tables of an application lie in one folder, which goes when the application ends.  What the write has shuffled goes with
    the write: it would else lie on the disks until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/tonearm-{spark.sparkContext.applicationId}"
    name = f"{folder}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN)
    spark.conf.set(CLEAN, "true")
    try:
        (df.write.option("compression", codec) if codec else df.write).parquet(name)
    finally:
        spark.conf.set(CLEAN, before)
    path, files = _path(spark, folder)
    files.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(name)
    out._written = name
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that write() made and that no later result reads."""
    for df in tables:
        path, files = _path(df.sparkSession, df._written)
        files.delete(path, True)
