"""Slices as monotone position maps, in closed form over Columns.

A tensor's axis 0 is the fastest. A slice maps a prefix of positions to how many of them it selects; a run (s, e] of the
tensor becomes (f(s), f(e)] of the slice, and goes where the two are equal.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F

from runloom.errors import IncompatibleTensor

Bounds = tuple[int, int, int]


def normalise(index, shape: tuple[int, ...]) -> tuple[Bounds, ...]:
    """(start, stop, stride) per axis; negative places count from the end, stops are clamped, an integer keeps its axis."""
    parts = list(index) if isinstance(index, tuple) else [index]
    if Ellipsis in parts:
        at = parts.index(Ellipsis)
        parts[at : at + 1] = [slice(None)] * (len(shape) - len(parts) + 1)
    if len(parts) != len(shape):
        raise IncompatibleTensor(f"{len(parts)} indices for {len(shape)} axes")
    out = []
    for part, n in zip(parts, shape, strict=True):
        if isinstance(part, slice):
            stride = 1 if part.step is None else part.step
            if stride <= 0:
                raise ValueError("a stride must be positive")
            start, stop = (0 if part.start is None else part.start), (n if part.stop is None else part.stop)
            start, stop = start + n * (start < 0), stop + n * (stop < 0)
            stop = min(max(stop, 0), n)
            out.append((min(max(start, 0), stop), stop, stride))
        else:
            place = int(part) + n * (part < 0)
            if not 0 <= place < n:
                raise IndexError(f"{part} is outside of {n}")
            out.append((place, place + 1, 1))
    return tuple(out)


def counts(bounds: tuple[Bounds, ...]) -> tuple[int, ...]:
    """The slice's shape."""
    return tuple(-(-(stop - start) // stride) for start, stop, stride in bounds)


def strides(shape: tuple[int, ...]) -> list[int]:
    return [prod(shape[:k]) for k in range(len(shape))]


def _div(a: Column, b: int) -> Column:
    return a if b == 1 else F.call_function("div", a, F.lit(b).cast("bigint"))


@dataclass(frozen=True)
class SliceMap:
    """The map of one slice of a tensor of ``shape``."""

    shape: tuple[int, ...]
    bounds: tuple[Bounds, ...]

    @property
    def is_identity(self) -> bool:
        return all(b == (0, n, 1) for b, n in zip(self.bounds, self.shape, strict=True))

    def __call__(self, p: Column) -> Column:
        sizes, steps = counts(self.bounds), strides(self.shape)
        total, ok = F.lit(0).cast("bigint"), None
        for axis in reversed(range(len(self.shape))):
            start, stop, stride = self.bounds[axis]
            v = _div(p, steps[axis])
            if axis < len(self.shape) - 1:
                v = v % self.shape[axis]
            if (start, stop, stride) == (0, self.shape[axis], 1):
                seen, chosen = v, None
            else:
                seen = F.least(F.greatest(_div(F.least(v, F.lit(stop)) - start + stride - 1, stride), F.lit(0)), F.lit(sizes[axis])).cast("bigint")
                chosen = (v >= start) & (v < stop) & ((v - start) % stride == 0)
            part = seen * prod(sizes[:axis])
            total = total + (part if ok is None else F.when(ok, part).otherwise(0))
            if chosen is not None:
                ok = chosen if ok is None else ok & chosen
        return total

    def place(self, k: Column) -> Column:
        """The position of the k-th selected cell."""
        sizes, steps = counts(self.bounds), strides(self.shape)
        out = F.lit(0).cast("bigint")
        for axis, (start, _, stride) in enumerate(self.bounds):
            i = _div(k, prod(sizes[:axis]))
            if axis < len(sizes) - 1:
                i = i % sizes[axis]
            out = out + (start + i * stride) * steps[axis]
        return out
