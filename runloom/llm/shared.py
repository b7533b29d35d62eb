"""Where intermediate tables go, and how lineage is cut.

Intermediate tables are Parquet under the folder named by ``spark.checkpoint.dir``: executors and the driver all see it,
so a lost executor only costs the tasks it was running.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
#: A task that writes a table of known size takes so many rows; with fewer, more of them go to one.
ROWS_A_TASK = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, a temporary folder, in local mode only."""
    base = spark.conf.get(_KEY, None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{_KEY} must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="runloom-")
        spark.conf.set(_KEY, base)
    return base


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd", path: str | None = None, rows: int | None = None) -> DataFrame:
    """``df`` written as Parquet under the shared folder (or at ``path``) and read back: its lineage ends there.

    ``rows``: what it has, or is made of, at most. No more tasks write it than so many rows are worth.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_TASK)))
    path = path or fresh_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
