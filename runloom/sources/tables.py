"""The test tables as arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.operators.tensor import StepTensor, from_cells, from_sparse

#: Codes of event types and order states; anything else is the last.
EVENT_CODES = {"click": 0, "error": 1, "purchase": 2, "signup": 3}
ORDER_CODES = {"F": 0, "O": 1}
GRID = (7, 50, 84)
#: Projections: how many components an embedding has, and the factor of its quantisation.
COMPONENTS, LEVELS = 64, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def coded(column: str, codes: dict[str, int]):
    out = None
    for k, v in codes.items():
        out = F.when(F.col(column) == k, v) if out is None else out.when(F.col(column) == k, v)
    return out.otherwise(len(codes)).cast("int")


def event_types(spark: SparkSession, sf_dir: str) -> StepTensor:
    e = table(spark, sf_dir, "events")
    return from_cells(e.select(F.col("event_id").alias("pos"), coded("event_type", EVENT_CODES).alias("val")), e.count(), "i")


def event_days(spark: SparkSession, sf_dir: str) -> StepTensor:
    e = table(spark, sf_dir, "events")
    return from_cells(e.select(F.col("event_id").alias("pos"), F.dayofmonth("ts").alias("val")), e.count(), "i")


def order_states(spark: SparkSession, sf_dir: str) -> StepTensor:
    o = table(spark, sf_dir, "orders")
    return from_cells(o.select(F.col("o_orderkey").alias("pos"), coded("o_orderstatus", ORDER_CODES).alias("val")), o.count(), "i")


def line_grid(spark: SparkSession, sf_dir: str) -> StepTensor:
    """Line items counted by line number, quantity and month of shipping."""
    month = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
    pos = (F.col("l_linenumber") - 1 + GRID[0] * (F.col("l_quantity").cast("bigint") - 1) + GRID[0] * GRID[1] * month).cast("bigint")
    counts = table(spark, sf_dir, "lineitem").groupBy(pos.alias("pos")).agg(F.count("*").cast("int").alias("val"))
    return from_sparse(counts, GRID, "i")


def embedding_grid(spark: SparkSession, sf_dir: str) -> StepTensor:
    """Quantised components by component and vector."""
    v = table(spark, sf_dir, "embeddings")
    cells = v.select("vec_id", F.posexplode("embedding").alias("i", "e"))
    cells = cells.select((F.col("vec_id") * COMPONENTS + F.col("i")).alias("pos"), F.floor(F.col("e").cast("double") * LEVELS).cast("int").alias("val"))
    return from_cells(cells, (COMPONENTS, v.count()), "i")
