"""Reductions over runs: cost follows the runs, not the cells."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce as fold
from math import prod
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.functions import scalar
from runloom.functions.stepmap import strides
from runloom.operators.tensor import StepTensor, from_runs, full
from runloom.plans.runs import split


def _size() -> Column:
    return F.col("end") - F.col("start")


def _finish(t: StepTensor, value: Any, keepdims: bool) -> Any:
    return full(t.spark, (1,) * t.ndim, value, t.kind) if keepdims else value


def total(t: StepTensor) -> DataFrame:
    """One row: the sum as bigint (double for floats), 0 for no cells."""
    kind = "double" if t.kind == "f" else "bigint"
    return t.frame().agg(F.coalesce(F.sum(F.col("val").cast(kind) * _size()), F.lit(0).cast(kind)).alias("value"))


def sum(t: StepTensor, axis: int | None = None, keepdims: bool = False, wide: bool = False) -> Any:  # noqa: A001
    """The sum; 32-bit unless ``wide``. With an axis, a tensor of what remains."""
    if axis is not None:
        return sum_axis(t, axis, keepdims)
    value = total(t).first()[0]
    if t.kind in "ibc" and not wide:
        value = (value + (1 << 31)) % (1 << 32) - (1 << 31)
    return _finish(t, value, keepdims)


#: 5 to the power of -(2^k), modulo 2^32: what takes bit k out of a logarithm to base 5.
_ROOTS = [pow(5, -(1 << k), 1 << 32) for k in range(30)]


def _logarithm(v: Column) -> Column:
    """The logarithm to base 5 (modulo 2^30) of a 32-bit number that leaves 1 when divided by 4, bit by bit."""
    start = F.struct(v.alias("v"), F.lit(0).cast("bigint").alias("b"))
    roots = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(r).cast("bigint").alias("r")) for k, r in enumerate(_ROOTS)))

    def step(acc: Column, root: Column) -> Column:
        bit = F.call_function("shiftright", acc["v"], root["k"] + 2).bitwiseAND(F.lit(1)) == 1
        # both factors are below 2^32: the product's low 32 bits by halves
        low, high = root["r"].bitwiseAND(F.lit(0xFFFF)), F.shiftright(root["r"], 16)
        times = (acc["v"] * low + F.shiftleft((acc["v"] * high).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(0xFFFFFFFF))
        power = F.call_function("shiftleft", F.lit(1).cast("bigint"), root["k"])
        return F.when(bit, F.struct(times.alias("v"), (acc["b"] + power).alias("b"))).otherwise(acc)

    return F.aggregate(roots, start, step, lambda acc: acc["b"])


def integer_product(t: StepTensor) -> DataFrame:
    """One row: zero (whether any cell is 0), twos, negative and power.

    Every other 32-bit number is 2^c, times 1 or -1, times a power of 5: products of cells are sums of these exponents, which
    executors add up like any other sums.
    """
    v = F.col("val").cast("bigint")
    twos = F.expr("array_position(transform(sequence(0, 31), k -> shiftright(cast(val as bigint), k) & 1L), 1L) - 1").cast("int")
    odd = F.call_function("shiftright", v, F.col("c")).bitwiseAND(F.lit(0xFFFFFFFF))
    rows = t.frame().groupBy("val").agg(F.sum(_size()).alias("n")).withColumn("c", F.when(v != 0, twos).otherwise(0))
    rows = rows.withColumn("odd", odd).withColumn("minus", F.col("odd").bitwiseAND(F.lit(3)) == 3)
    rows = rows.withColumn("plus", F.when(F.col("minus"), (F.lit(1 << 32) - F.col("odd"))).otherwise(F.col("odd")))
    around = F.lit(1 << 30)
    part = _logarithm(F.col("plus")) * (F.col("n") % around) % around
    return rows.agg(
        F.coalesce(F.max(v == 0), F.lit(False)).alias("zero"),
        F.coalesce(F.sum(F.col("c") * F.least("n", F.lit(32))), F.lit(0)).alias("twos"),
        F.coalesce(F.sum(F.when(F.col("minus"), F.col("n") % 2)), F.lit(0)).alias("negative"),
        F.coalesce(F.sum(F.when(v != 0, part)), F.lit(0)).alias("power"),
    )


def prod_(t: StepTensor, keepdims: bool = False) -> Any:
    """The product (1 for no cells); integers wrap to 32 bits, floats are multiplied in double."""
    if t.kind == "f":
        value = t.frame().agg(F.product(F.pow(F.col("val").cast("double"), _size()))).first()[0]
        return _finish(t, 1.0 if value is None else float(value), keepdims)
    r = integer_product(t.to("i")).first()
    m = 1 << 32
    out = 0 if r["zero"] or r["twos"] >= 32 else pow(5, int(r["power"]) % (1 << 30), m) * (-1) ** (int(r["negative"]) % 2) * (1 << int(r["twos"])) % m
    return _finish(t, (out + (1 << 31)) % m - (1 << 31), keepdims)


def extreme(t: StepTensor, name: str) -> DataFrame:
    return t.frame().agg(F.expr(f"{name}(val)").alias("value"))


def count_nonzero(t: StepTensor) -> DataFrame:
    return t.frame().agg(F.coalesce(F.sum(F.when(scalar.nonzero(F.col("val"), t.kind), _size())), F.lit(0)).cast("bigint").alias("value"))


def histogram(t: StepTensor) -> DataFrame:
    """val and n: how many cells hold it."""
    return t.frame().groupBy("val").agg(F.sum(_size()).alias("n"))


def statistics(t: StepTensor) -> DataFrame:
    """One row: cells, non-zeros, runs, and the bytes of the dense, sparse and run forms."""
    zero = F.when(scalar.nonzero(F.col("val"), t.kind), _size()).otherwise(0)
    row = t.runs().agg(F.sum(_size()).alias("cells"), F.sum(zero).alias("nonzero"), F.count("*").alias("runs"))
    return row.select("*", (F.col("cells") * 4).alias("dense_bytes"), (F.col("nonzero") * 8).alias("sparse_bytes"), (F.col("runs") * 8).alias("run_bytes"))


def compression_ratio(t: StepTensor) -> DataFrame:
    """Cells over twice the runs, and over twice the non-zeros."""
    return statistics(t).select(F.try_divide(F.col("cells").cast("double"), 2 * F.col("runs")).alias("run_ratio"), F.try_divide(F.col("cells").cast("double"), 2 * F.col("nonzero")).alias("sparse_ratio"))


def _rows(t: StepTensor) -> DataFrame:
    """Runs cut at the edges of axis 0: row, x0, x1, val."""
    w = t.shape[0]
    return split(t.frame(), w).select(F.col("blk").alias("row"), (F.col("start") - F.col("blk") * w).alias("x0"), (F.col("end") - F.col("blk") * w).alias("x1"), "val")


def sum_axis(t: StepTensor, axis: int, keepdims: bool = False) -> StepTensor:
    """Sums along an axis: for axis 0 one aggregation of the rows, else difference events and a running sum in each row."""
    axis += t.ndim * (axis < 0)
    shape = tuple(n for k, n in enumerate(t.shape) if k != axis) or (1,)
    wide = "double" if t.kind == "f" else "bigint"
    kind = "f" if t.kind == "f" else "i"
    end = (lambda x: x.cast("float")) if kind == "f" else (lambda x: scalar.wrap32(x))
    rows = _rows(t)
    if axis == 0:
        sums = rows.groupBy("row").agg(F.sum(F.col("val").cast("int" if t.kind == "b" else wide).cast(wide) * (F.col("x1") - F.col("x0"))).alias("s"))
        frame = sums.select(F.col("row").alias("start"), (F.col("row") + 1).alias("end"), end(F.col("s")).alias("val"))
    else:
        inner, size = prod(t.shape[1:axis]), t.shape[axis]
        div = lambda a, b: F.call_function("div", a, F.lit(b).cast("bigint"))
        row = F.col("row") % inner + div(F.col("row"), inner * size) * inner
        v = F.col("val").cast("int" if t.kind == "b" else wide).cast(wide)
        events = rows.select(row.alias("row"), F.explode(F.array(F.struct(F.col("x0").alias("x"), v.alias("d")), F.struct(F.col("x1").alias("x"), (-v).alias("d")))).alias("e")).select("row", "e.*")
        frame = running(events, t.shape[0], wide).select("start", "end", end(F.col("val")).alias("val"))
    out = from_runs(frame, shape, kind, f"sum({t.text}, {axis})")
    return out.reshape(tuple(1 if k == axis else n for k, n in enumerate(t.shape))) if keepdims else out


def running(events: DataFrame, width: int, wide: str) -> DataFrame:
    """Difference events (row, x, d) of rows of ``width`` cells as runs; every row has an event at its first cell."""
    at = events.groupBy("row", "x").agg(F.sum("d").alias("d")).where(F.col("x") < width)
    order = Window.partitionBy("row").orderBy("x")
    value = F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast(wide)
    stop = F.coalesce(F.lead("x").over(order), F.lit(width).cast("bigint"))
    return at.select((F.col("row") * width + F.col("x")).alias("start"), (F.col("row") * width + stop).alias("end"), value.alias("val"))


def reduce(op: Callable[[StepTensor, StepTensor], StepTensor], t: StepTensor, axis: int | None = None, keepdims: bool = False, fan: int = 16) -> Any:
    """Any associative operator on tensors: every round combines ``fan`` neighbours, as aligned strided slices of one frame."""
    flat = t.flatten() if axis is None else t
    k = 0 if axis is None else axis + t.ndim * (axis < 0)
    if not flat.shape[k]:
        raise ValueError("nothing to reduce")

    def part(x: StepTensor, start: int, stop: int, step: int = 1) -> StepTensor:
        return x[tuple(slice(start, stop, step) if j == k else slice(None) for j in range(x.ndim))]

    rest = None
    while (n := flat.shape[k]) > 1:
        width = min(fan, n)
        whole = n // width * width
        for j in reversed(range(whole, n)):  # what doesn't fill a round comes after everything else
            last = part(flat, j, j + 1)
            rest = last if rest is None else op(last, rest)
        if rest is not None:
            rest = rest.eval()
        flat = fold(op, [part(flat, j, whole, width) for j in range(width)])
        flat = flat.eval()
    out = flat if rest is None else op(flat, rest)
    if axis is None:
        return out.reshape((1,) * t.ndim) if keepdims else out.item()
    return out if keepdims else out.squeeze(k)
