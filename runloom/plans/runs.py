"""Run frames: DataFrames of (start, end, val) that cover [0, length) once, in any order and any partitioning.

Everything is keyed by fixed-size blocks of positions, so no window or aggregation ever spans the whole domain: what blocks
have to say to each other goes up a hierarchy of larger and larger blocks, two rows of each at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runloom import config

#: Blocks of a level that one block of the next level holds.
FAN = 1 << 16


def block_of(p: Column, block: int) -> Column:
    return F.call_function("div", p, F.lit(block).cast("bigint"))


def empty(spark: SparkSession, kind: str) -> DataFrame:
    return spark.createDataFrame([], f"start bigint, end bigint, val {kind}")


def constant(spark: SparkSession, length: int, value: Column) -> DataFrame:
    """One run, or none for length 0."""
    return spark.range(1 if length else 0).select(F.lit(0).cast("bigint").alias("start"), F.lit(length).cast("bigint").alias("end"), value.alias("val"))


def split(runs: DataFrame, block: int) -> DataFrame:
    """Runs cut at multiples of ``block``, with their block as ``blk``."""
    first, last = block_of(F.col("start"), block), block_of(F.col("end") - 1, block)
    out = runs.withColumn("blk", F.explode(F.sequence(first, last)))
    return out.withColumn("start", F.greatest("start", F.col("blk") * block)).withColumn("end", F.least("end", (F.col("blk") + 1) * block))


def encode(cells: DataFrame, length: int, pos: str = "pos", val: str = "val", block: int | None = None) -> DataFrame:
    """Canonical runs of a table of cells (dense, unique positions)."""
    one = cells.select(F.col(pos).cast("bigint").alias("start"), (F.col(pos).cast("bigint") + 1).alias("end"), F.col(val).alias("val"))
    return canonical(one, length, block)


def canonical(runs: DataFrame, length: int, block: int | None = None) -> DataFrame:
    """Equal neighbours merged, across blocks too.

    A level merges the runs that start in the same block by one sort. All but the first and the last of a block are then
    final; those two go to the next level, whose blocks hold ``FAN`` of this one's. The last level has one block: no window ever
    holds more than a block's rows, or twice ``FAN``.
    """
    span, rows, done = block or config.get_value("block"), runs.select("start", "end", "val"), []
    while True:
        group = Window.partitionBy("blk")
        order = group.orderBy("start")
        rows = rows.withColumn("blk", block_of(F.col("start"), span))
        rows = rows.withColumns({"before": F.lag("end").over(order), "prev": F.lag("val").over(order), "stop": F.max("end").over(group)})
        rows = rows.where(F.col("before").isNull() | (F.col("before") != F.col("start")) | ~F.col("val").eqNullSafe(F.col("prev")))
        after = F.lead("before").over(order)
        rows = rows.select("start", F.coalesce(after, "stop").alias("end"), "val", (F.col("before").isNull() | after.isNull()).alias("edge"))
        if span >= length:
            done.append(rows.select("start", "end", "val"))
            return reduce(DataFrame.unionByName, done)
        done.append(rows.where(~F.col("edge")).select("start", "end", "val"))
        rows, span = rows.where("edge").select("start", "end", "val"), span * FAN


def decode(runs: DataFrame) -> DataFrame:
    """One row per cell: pos, val."""
    return runs.select(F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"), "val")


def _dyadic(block: int) -> Column:
    """The aligned intervals (level, place) of sizes 1, 2, 4 ... that make up s to e of a block, two of a level at most."""
    shift = lambda x, k: F.call_function("shiftright", x, k)
    odd = lambda x: x.bitwiseAND(F.lit(1)) == 1

    def at(k: Column) -> Column:
        low, high = shift(F.col("s") + F.call_function("shiftleft", F.lit(1), k) - 1, k), shift(F.col("e"), k)
        left = F.when((low < high) & odd(low), F.struct(k.alias("level"), low.alias("place")))
        right = F.when((low < high) & odd(high), F.struct(k.alias("level"), (high - 1).alias("place")))
        return F.array(left, right)

    levels = F.sequence(F.lit(0), F.lit(block.bit_length()))
    return F.array_compact(F.flatten(F.transform(levels, at)))


def last_writer(updates: DataFrame, fill: Column, length: int, block: int | None = None) -> DataFrame:
    """Runs of range updates (seq, start, end, val) over ``fill``: where updates overlap, the greatest seq wins.

    Updates are cut at block edges and into dyadic intervals, of which only the last writer is kept (combined before the
    shuffle). A boundary position then takes the latest of the dyadic intervals around it, one for each size: the work
    grows with updates plus boundaries times the logarithm of the block, however many updates meet.
    """
    block = block or config.get_value("block")
    spark = updates.sparkSession
    cut = split(updates.select("seq", "start", "end", "val"), block)
    cut = cut.select("blk", "start", "end", "seq", "val", (F.col("start") - F.col("blk") * block).cast("int").alias("s"), (F.col("end") - F.col("blk") * block).cast("int").alias("e"))
    best = cut.select("blk", "seq", "val", F.explode(_dyadic(block)).alias("d")).groupBy("blk", "d.level", "d.place").agg(F.max(F.struct("seq", "val")).alias("w"))
    blocks = spark.range(-(-length // block)).select(F.col("id").alias("blk"), (F.col("id") * block).alias("at"))
    edges = cut.select("blk", F.col("start").alias("at")).union(cut.where(F.col("end") < F.least((F.col("blk") + 1) * block, F.lit(length))).select("blk", "end")).union(blocks).distinct()
    inside = (F.col("at") - F.col("blk") * block).cast("int")
    around = F.transform(F.sequence(F.lit(0), F.lit(block.bit_length())), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", inside, k).alias("place")))
    asked = edges.select("blk", "at", F.explode(around).alias("d")).select("blk", "at", "d.level", "d.place")
    told = asked.join(best, ["blk", "level", "place"]).groupBy("blk", "at").agg(F.max("w").alias("w"))
    values = edges.join(told, ["blk", "at"], "left")
    after = Window.partitionBy("blk").orderBy("at")
    stop = F.coalesce(F.lead("at").over(after), F.least((F.col("blk") + 1) * block, F.lit(length)))
    return values.select(F.col("at").alias("start"), stop.alias("end"), F.coalesce("w.val", fill).alias("val"))


def dumps(runs: DataFrame, length: int) -> str:
    """``end=>val, end=>val`` of canonical runs, on the driver."""
    rows = canonical(runs, length).orderBy("start").select("end", F.col("val").cast("string")).collect()
    return ", ".join(f"{e}=>{v}" for e, v in rows)


def dump_blocks(runs: DataFrame, length: int, block: int | None = None) -> DataFrame:
    """``end=>val`` of the canonical runs that start in each block, as one line of text a block: blk, dump."""
    block = block or config.get_value("block")
    said = F.transform(F.array_sort(F.collect_list(F.struct("end", "val"))), lambda r: F.concat(r["end"].cast("string"), F.lit("=>"), r["val"].cast("string")))
    return canonical(runs, length).groupBy(block_of(F.col("start"), block).alias("blk")).agg(F.array_join(said, ", ").alias("dump"))
