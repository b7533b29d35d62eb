"""Alignment of any number of run frames over one domain: union of their boundaries, one shuffle by block, forward fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom import config
from runloom.plans.runs import block_of, split


def align(parts: list[tuple[DataFrame, list[int]]], kinds: list[str], length: int, fn: Callable[[list[Column]], Column], block: int | None = None) -> DataFrame:
    """Runs of ``fn`` over all sources' values, equal neighbours merged within blocks.

    A part is a frame of (src, start, end, val) and the sources that it holds; every source covers the domain once.
    """
    block = block or config.get_value("block")
    names = [f"v{j}" for j in range(len(kinds))]
    rows = None
    for frame, held in parts:
        cut = split(frame, block)
        own = lambda j, held=held: F.when(F.col("src") == j, F.col("val")).cast(kinds[j]) if j in held else F.lit(None).cast(kinds[j])
        cut = cut.select("blk", "start", *(own(j).alias(names[j]) for j in range(len(kinds))))
        rows = cut if rows is None else rows.unionByName(cut)
    met = rows.repartition("blk").groupBy("blk", "start").agg(*(F.max(v).alias(v) for v in names))
    return _filled(met, names, length, block, fn)


def overlay(base: DataFrame, patch: DataFrame, length: int, block: int | None = None) -> DataFrame:
    """``base`` with the disjoint runs of ``patch`` written over it."""
    block = block or config.get_value("block")
    kind = dict(base.dtypes)["val"]
    null, off = F.lit(None).cast(kind), F.lit(None).cast("boolean")
    under = split(base, block).select("blk", "start", F.col("val").alias("v0"), null.alias("v1"), off.alias("v2"))
    cut = split(patch, block)
    begins = cut.select("blk", "start", null.alias("v0"), F.col("val").cast(kind).alias("v1"), F.lit(True).alias("v2"))
    ends = cut.select(block_of(F.col("end"), block).alias("blk"), F.col("end").alias("start"), null.alias("v0"), null.alias("v1"), F.lit(False).alias("v2")).where(F.col("start") < length)
    # where a run ends as another begins, the beginning counts: true is the greater
    met = under.unionByName(begins).unionByName(ends).repartition("blk").groupBy("blk", "start").agg(F.max("v0").alias("v0"), F.max("v1").alias("v1"), F.max("v2").alias("v2"))
    return _filled(met, ["v0", "v1", "v2"], length, block, lambda c: F.when(F.coalesce(c[2], F.lit(False)), c[1]).otherwise(c[0]))


def _filled(met: DataFrame, names: list[str], length: int, block: int, fn: Callable[[list[Column]], Column]) -> DataFrame:
    order = Window.partitionBy("blk").orderBy("start")
    fill = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = met.select("blk", "start", *(F.last(v, True).over(fill).alias(v) for v in names))
    rows = rows.select("blk", "start", fn([F.col(v) for v in names]).alias("val"))
    rows = rows.select("*", F.lag("val").over(order).alias("prev"), F.row_number().over(order).alias("k"))
    rows = rows.where((F.col("k") == 1) | ~F.col("val").eqNullSafe(F.col("prev")))
    stop = F.coalesce(F.lead("start").over(order), F.least((F.col("blk") + 1) * block, F.lit(length).cast("bigint")))
    return rows.select("start", stop.alias("end"), "val")
