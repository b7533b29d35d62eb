"""Synthetic run arrays and quantised digit strips."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from runloom.operators.tensor import StepTensor, apply_updates, from_runs, from_sparse


#: A prime and multipliers of the draws below.
PRIME, FACTORS = (1 << 31) - 1, (48271, 69621, 39373)


def draw(key: Column, seed: int, stream: int) -> Column:
    """A number from 0 to PRIME - 1 of a row's key: the same on any number of partitions, in plain integer arithmetic."""
    u = (key * 7919 + (seed * 104729 + stream * 1299709 + 12345)) % PRIME
    for f in FACTORS:
        u = (u * f + key) % PRIME
        u = u * u % PRIME
    return u


def run_length_array(spark: SparkSession, num_elements: int, num_non_zero: int, run_length: int, deterministic_run_length: bool = True, random_seed: int = 0) -> StepTensor:
    """Runs of values 0 to 32767 at random places over zeros, later runs over earlier; lengths fixed, or random about the given."""
    n = max(1, num_non_zero // max(1, run_length))
    size = F.lit(run_length).cast("bigint") if deterministic_run_length else 1 + draw(F.col("id"), random_seed, 2) % max(1, 2 * run_length - 1)
    rows = spark.range(n).select(F.col("id").alias("seq"), (draw(F.col("id"), random_seed, 0) % num_elements).alias("start"), size.alias("size"), (draw(F.col("id"), random_seed, 1) % 32768).cast("int").alias("val"))
    rows = rows.select("seq", "start", F.least(F.col("start") + F.col("size"), F.lit(num_elements)).alias("end"), "val")
    return apply_updates(rows, num_elements, 0, "i")


def banded(spark: SparkSession, n: int, band: int) -> StepTensor:
    """0, 1, 2 ... each ``band`` times."""
    return from_runs(spark.range(n // band).select((F.col("id") * band).alias("start"), ((F.col("id") + 1) * band).alias("end"), F.col("id").cast("int").alias("val")), n // band * band, "i")


def digits(spark: SparkSession, path: str, side: int = 28, buckets: int | None = None, top: int = 256) -> StepTensor:
    """A CSV of label and pixel rows as a strip of ``side`` columns, pixels quantised to ``buckets`` levels."""
    rows = spark.read.option("header", True).option("inferSchema", False).csv(path)
    pixels = [c for c in rows.columns if c != "label"]
    numbered = rows.select(F.monotonically_increasing_id().alias("at"), F.array(*(F.col(c).cast("int") for c in pixels)).alias("p"))
    # rows are numbered by task and place in it; the tasks' sizes make that dense
    parts = numbered.select((F.shiftright("at", 33)).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"), "p")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    n = rows.count()
    cells = parts.join(before, "part").select((F.col("before") + F.col("place")).alias("row"), F.posexplode("p").alias("i", "v"))
    value = F.col("v") if buckets is None else F.call_function("div", F.col("v") * buckets, F.lit(top)).cast("int") * buckets
    return from_sparse(cells.select((F.col("row") * len(pixels) + F.col("i")).alias("pos"), value.cast("int").alias("val")), (side, side * n), "i")
