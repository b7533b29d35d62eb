"""Position updates as a stream: appended exactly once to Parquet, read back as a tensor at any time."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runloom.operators.tensor import StepTensor, apply_updates

COLUMNS = ["seq", "start", "end", "val"]


def append_updates(stream: DataFrame, path: str, checkpoint: str, **trigger: Any) -> StreamingQuery:
    """Writes a stream of range updates (seq, start, end, val); the file sink and its checkpoint make each count once."""
    return stream.select(*COLUMNS).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def snapshot(spark: SparkSession, path: str, shape: int | tuple[int, ...], fill: Any = 0, dtype: Any = None) -> StepTensor:
    """The tensor that the updates so far give, the greatest seq winning."""
    return apply_updates(spark.read.parquet(path), shape, fill, dtype)


def windowed_histogram(stream: DataFrame, ts: str, window: str, late: str, val: str = "val") -> DataFrame:
    """Cells written per value and event-time window, with late data up to ``late``."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window), val).agg(F.sum(F.col("end") - F.col("start")).alias("n"))
