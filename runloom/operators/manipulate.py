"""Composition of tensors: stack, concat, pad, take, transpose, assembly of blocks."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.errors import IncompatibleTensor
from runloom.functions import scalar
from runloom.operators.tensor import StepTensor, from_runs, from_sparse, full, shifted
from runloom.plans.align import overlay
from runloom.plans.runs import decode


def take(t: StepTensor, part: slice, axis: int | None = None) -> StepTensor:
    """A slice of one axis; without one, of every axis."""
    return t[tuple(part if axis is None or k == axis else slice(None) for k in range(t.ndim))]


def stack(a: StepTensor, b: StepTensor) -> StepTensor:
    """Block-diagonal: shapes add on every axis, zero elsewhere; in one dimension plain concatenation."""
    return concat([a, b])


def concat(tensors: list[StepTensor]) -> StepTensor:
    """All blocks on the diagonal, in one union."""
    first = tensors[0]
    if any(t.kind != first.kind or t.ndim != first.ndim for t in tensors):
        raise IncompatibleTensor("dtypes and dimensions must be the same")
    if len(tensors) == 1:
        return first.clone()
    shape = tuple(sum(t.shape[k] for t in tensors) for k in range(first.ndim))
    at, frames = (0,) * first.ndim, []
    for t in tensors:
        frames.append(shifted(t, shape, at))
        at = tuple(a + n for a, n in zip(at, t.shape, strict=True))
    whole = reduce(DataFrame.unionByName, frames)
    if first.ndim > 1:
        base = full(first.spark, shape, 0, first.kind)
        whole = overlay(base.frame(), whole, base.length)
    return from_runs(whole, shape, first.kind, "concat")


def pad(t: StepTensor, padding: int | tuple[int, ...], fill: Any = 0) -> StepTensor:
    """``t`` in the middle of a larger tensor of ``fill``."""
    p = (padding,) * t.ndim if isinstance(padding, int) else tuple(padding)
    shape = tuple(n + 2 * k for n, k in zip(t.shape, p, strict=True))
    base = full(t.spark, shape, fill, t.kind)
    return from_runs(overlay(base.frame(), shifted(t, shape, p), base.length), shape, t.kind, "pad")


def transpose(t: StepTensor, order: tuple[int, ...] | None = None) -> StepTensor:
    """Axes in another order (reversed without one). Runs change as a whole: cells are moved and encoded again."""
    order = tuple(reversed(range(t.ndim))) if order is None else order
    shape = tuple(t.shape[k] for k in order)
    place, step, steps = F.lit(0).cast("bigint"), 1, [1]
    for n in t.shape[:-1]:
        steps.append(steps[-1] * n)
    for k in order:
        place = place + F.call_function("div", F.col("pos"), F.lit(steps[k]).cast("bigint")) % t.shape[k] * step
        step *= t.shape[k]
    return from_sparse(decode(t.frame()).select(place.alias("pos"), "val").where(F.col("val") != F.lit(0).cast(scalar.SQL_TYPES[t.kind])), shape, t.kind)


def assemble(blocks: DataFrame, block_shape: tuple[int, ...], shape: tuple[int, ...], dtype: Any = "i", fill: Any = 0) -> StepTensor:
    """Runs of many equal blocks (cx, cy, cz: the block's first cell; start, end, val within it) as one tensor, by one union."""
    from runloom.functions.stepmap import strides
    from runloom.plans.runs import split

    base = full(blocks.sparkSession, shape, fill, dtype)
    cut = split(blocks, block_shape[0])
    steps, own = strides(shape), strides(block_shape)
    begin = F.lit(0).cast("bigint")
    for k, c in enumerate(("cx", "cy", "cz")[: len(shape)]):
        begin = begin + (F.col(c) + F.call_function("div", F.col("start"), F.lit(own[k]).cast("bigint")) % block_shape[k]) * steps[k]
    patch = cut.select(begin.alias("start"), (begin + F.col("end") - F.col("start")).alias("end"), F.col("val").cast(scalar.SQL_TYPES[base.kind]).alias("val"))
    return from_runs(overlay(base.frame(), patch, base.length), shape, base.kind, "assembly")
