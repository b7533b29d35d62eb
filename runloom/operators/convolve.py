"""Convolution (without flipping the kernel) of runs.

Integers go by difference events: a run is a step up at its start and a step down at its end, linear in the taps, so every
tap shifts and weighs the events of its row and one running sum per output row gives the runs back. Floats go by aligned
slices, which don't accumulate rounding along a row.
"""

from __future__ import annotations

from functools import reduce as fold
from itertools import product
from math import prod
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from runloom.errors import IncompatibleTensor
from runloom.functions import scalar
from runloom.operators.manipulate import pad
from runloom.operators.reduce import _rows, running
from runloom.operators.tensor import StepTensor, from_runs, full, map_values


def conv(t: StepTensor, kernel: Any, padding: int | tuple[int, ...] = 0, fill: Any = 0) -> StepTensor:
    """Correlation with a kernel (array of reversed shape, or a tensor): size n + 2 * padding - k + 1 on every axis."""
    kernel = kernel.to_numpy() if isinstance(kernel, StepTensor) else np.asarray(kernel)
    if kernel.ndim != t.ndim:
        raise IncompatibleTensor(f"a kernel of {kernel.ndim} axes for {t.ndim}")
    p = (padding,) * t.ndim if isinstance(padding, int) else tuple(padding)
    k = kernel.shape[::-1]
    shape = tuple(n + 2 * a - b + 1 for n, a, b in zip(t.shape, p, k, strict=True))
    if min(shape) <= 0:
        raise IncompatibleTensor("the kernel is larger than the padded tensor")
    taps = [(at[::-1], kernel[at].item()) for at in product(*map(range, kernel.shape)) if kernel[at] != 0]
    if t.kind == "f" or kernel.dtype.kind == "f":
        return _by_slices(t.to("f"), taps, p, shape, fill)
    return _by_events(t, taps, p, shape, int(fill))


def conv_2d(t: StepTensor, kernel: Any, padding: int = 0, fill: Any = 0) -> StepTensor:
    return conv(t, kernel, padding, fill)


def conv_3d(t: StepTensor, kernel: Any, padding: int = 0, fill: Any = 0) -> StepTensor:
    return conv(t, kernel, padding, fill)


def _by_slices(t: StepTensor, taps: list, p: tuple[int, ...], shape: tuple[int, ...], fill: Any) -> StepTensor:
    padded = pad(t, p, float(fill)) if any(p) else t
    if not taps:
        return full(t.spark, shape, 0.0)
    parts = [padded[tuple(slice(a, a + n) for a, n in zip(at, shape, strict=True))] for at, _ in taps]
    weights = [w for _, w in taps]
    return map_values(lambda *c: fold(lambda x, y: x + y, [v.cast("double") * w for v, w in zip(c, weights, strict=True)]).cast("float"), *parts, kind="f", text=f"conv({t.text})")


def _by_events(t: StepTensor, taps: list, p: tuple[int, ...], shape: tuple[int, ...], fill: int) -> StepTensor:
    width = shape[0]
    table = F.array(*(F.struct(*(F.lit(p[k] - at[k]).cast("bigint").alias(f"s{k}") for k in range(t.ndim)), F.lit(int(w)).cast("bigint").alias("w")) for at, w in taps))
    rows = _rows(t).where(F.col("val").cast("bigint") != fill) if t.kind != "b" else _rows(t).where(F.col("val"))
    x = rows.select("row", "x0", "x1", (F.col("val").cast("int").cast("bigint") - fill).alias("v"), F.explode(table).alias("tap"))
    inside, out_row, step = F.lit(True), F.lit(0).cast("bigint"), 1
    for k in range(1, t.ndim):
        size = prod(t.shape[1:k])
        y = F.call_function("div", F.col("row"), F.lit(size).cast("bigint")) % t.shape[k] + F.col(f"tap.s{k}")
        inside = inside & (y >= 0) & (y < shape[k])
        out_row = out_row + y * step
        step *= shape[k]
    clip = lambda c: F.least(F.greatest(F.col(c) + F.col("tap.s0"), F.lit(0)), F.lit(width)).cast("bigint")
    d = F.col("v") * F.col("tap.w")
    e = F.explode(F.array(F.struct(clip("x0").alias("x"), d.alias("d")), F.struct(clip("x1").alias("x"), (-d).alias("d"))))
    events = x.where(inside).select(out_row.alias("row"), e.alias("e")).select("row", "e.x", "e.d")
    base = fill * sum(w for _, w in taps)
    heads = t.spark.range(prod(shape[1:])).select(F.col("id").alias("row"), F.lit(0).cast("bigint").alias("x"), F.lit(int(base)).cast("bigint").alias("d"))
    frame = running(events.unionByName(heads), width, "bigint")
    return from_runs(frame.select("start", "end", scalar.wrap32(F.col("val")).alias("val")), shape, "i", f"conv({t.text})")


def gaussian_blur(t: StepTensor) -> StepTensor:
    """(1, 6, 15, 20, 15, 6, 1) / 64 along every axis, edges padded with zeros."""
    line = np.array([1, 6, 15, 20, 15, 6, 1], np.float32) / 64
    for axis in range(t.ndim):
        shape = [1] * t.ndim
        shape[t.ndim - 1 - axis] = 7
        t = conv(t.to("f"), line.reshape(shape), tuple(3 if k == axis else 0 for k in range(t.ndim))).eval()
    return t


def sharpen(t: StepTensor) -> StepTensor:
    """Every cell times all cells around it less one, minus these: 26 and -1 in three dimensions."""
    kernel = np.full((3,) * t.ndim, -1, np.int32)
    kernel[(1,) * t.ndim] = 3**t.ndim - 1
    return conv(t, kernel, 1)


def box(t: StepTensor, size: int = 3) -> StepTensor:
    """The mean of ``size`` cells along every axis, as floats (sums of integers are 32-bit)."""
    if t.kind == "f":
        return conv(t, np.full((size,) * t.ndim, 1 / size**t.ndim, np.float32), size // 2)
    return conv(t, np.ones((size,) * t.ndim, np.int32), size // 2) / float(size**t.ndim)


def downsample(t: StepTensor) -> StepTensor:
    """The mean of every 2 x 2 ... block, as floats; where an axis is odd its last cells are a block of their own.

    Integers go by difference events over halved rows: one shuffle, cost by runs. Floats by aligned slices.
    """
    shape = tuple(-(-n // 2) for n in t.shape)
    if t.kind == "f":
        if any(n % 2 for n in t.shape):
            raise IncompatibleTensor("every axis of floats must be even")
        parts = [t[tuple(slice(o, None, 2) for o in at)] for at in product((0, 1), repeat=t.ndim)]
        n = len(parts)
        return map_values(lambda *c: (fold(lambda x, y: x + y, [v.cast("double") for v in c]) / n).cast("float"), *parts, kind="f", text=f"downsample({t.text})")
    div = lambda a, b: F.call_function("div", a, F.lit(b).cast("bigint"))
    rows = _rows(t)
    weight, out_row, step = F.lit(1).cast("bigint"), F.lit(0).cast("bigint"), 1
    for k in range(1, t.ndim):
        y = div(F.col("row"), prod(t.shape[1:k])) % t.shape[k]
        if t.shape[k] % 2:  # the last row is its own pair
            weight = weight * F.when(y == t.shape[k] - 1, 2).otherwise(1)
        out_row, step = out_row + div(y, 2) * step, step * shape[k]
    w = t.shape[0]
    v = F.col("val").cast("int").cast("bigint") * weight
    stop = F.when(F.col("x1") == w, w + w % 2).otherwise(F.col("x1"))

    def at(x: Column, v: Column) -> list[Column]:
        """Half of the step in the pair of x, half of it where the next cell begins."""
        return [F.struct(div(x, 2).alias("x"), v.alias("d")), F.struct(div(x + 1, 2).alias("x"), v.alias("d"))]

    events = rows.select(out_row.alias("row"), F.explode(F.array(*at(F.col("x0"), v), *at(stop.cast("bigint"), -v))).alias("e")).select("row", "e.x", "e.d")
    heads = t.spark.range(prod(shape[1:])).select(F.col("id").alias("row"), F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("d"))
    frame = running(events.unionByName(heads), shape[0], "bigint")
    return from_runs(frame.select("start", "end", (F.col("val") / 2**t.ndim).cast("float").alias("val")), shape, "f", f"downsample({t.text})")


def highlight_runs(t: StepTensor) -> StepTensor:
    """Whether a cell equals the next one in flat order (the last cell doesn't): known from run lengths alone."""
    runs = t.runs()
    ends = F.array(F.struct("start", (F.col("end") - 1).alias("end"), F.lit(True).alias("val")), F.struct((F.col("end") - 1).alias("start"), "end", F.lit(False).alias("val")))
    frame = runs.select(F.explode(ends).alias("e")).select("e.*").where("end > start")
    return from_runs(frame, t.shape, "b", f"highlight({t.text})")


def shift_or(t: StepTensor, by: int) -> StepTensor:
    """``t`` or ``t`` moved ``by`` cells on, over the cells that both have."""
    return t.flatten()[by:] | t.flatten()[: t.length - by]
