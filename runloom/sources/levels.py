"""Tensors kept as Parquet: runs sorted by start, so that a range of positions skips row groups."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from runloom.operators.tensor import StepTensor, from_runs


def dump(t: StepTensor, path: str) -> None:
    t.runs().repartitionByRange("start").sortWithinPartitions("start").write.parquet(f"{path}/runs")
    t.spark.createDataFrame([(json.dumps({"shape": list(t.shape), "dtype": t.kind}),)], "meta string").coalesce(1).write.parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> StepTensor:
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()[0])
    return from_runs(spark.read.parquet(f"{path}/runs"), tuple(meta["shape"]), meta["dtype"], path)
