"""StepTensor: a lazy N-dimensional array of runs.

An expression is a list of sources (a run frame under a chain of slice maps) and one Column function over them; operators
compose the functions and merge equal sources, slices go down to the sources. So whatever was composed is one plan: no
shuffle for one source, one shuffle for any number. Scalars stay literals.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import prod
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom import config
from runloom.errors import IncompatibleTensor, InvalidTensor, TypeConversion
from runloom.functions import scalar
from runloom.functions.stepmap import SliceMap, counts, normalise
from runloom.plans import runs as R
from runloom.plans.align import align, overlay

_NUMPY = {"i": np.int32, "f": np.float32, "b": np.bool_, "c": np.int8}
_KINDS = {int: "i", float: "f", bool: "b"}


class Leaf:
    """A run frame over [0, length); equality is identity, so the same frame is one source."""

    def __init__(self, frame: DataFrame, length: int, kind: str):
        self.frame, self.length, self.kind = frame, length, kind


@dataclass(frozen=True)
class Source:
    leaf: Leaf
    maps: tuple[SliceMap, ...] = ()

    def frame(self) -> DataFrame:
        """The mapped runs: a narrow projection."""
        if not self.maps:
            return self.leaf.frame
        to = lambda p: reduce(lambda x, m: m(x), self.maps, p)
        mapped = self.leaf.frame.select(to(F.col("start")).alias("start"), to(F.col("end")).alias("end"), "val")
        return mapped.where(F.col("end") > F.col("start"))


def parts_of(sources: tuple[Source, ...] | list[Source]) -> list[tuple[DataFrame, list[int]]]:
    """The sources as parts to align: those of one frame together, so that it is worked out once however many slices of it
    an expression has."""
    held: dict[Leaf, list[int]] = {}
    for k, s in enumerate(sources):
        held.setdefault(s.leaf, []).append(k)
    out = []
    for leaf, ks in held.items():
        if len(ks) == 1:
            out.append((sources[ks[0]].frame().select(F.lit(ks[0]).alias("src"), "start", "end", "val"), ks))
            continue
        to = lambda k, p: reduce(lambda x, m: m(x), sources[k].maps, p)
        mapped = F.array(*(F.struct(F.lit(k).alias("src"), to(k, F.col("start")).alias("start"), to(k, F.col("end")).alias("end")) for k in ks))
        rows = leaf.frame.select(F.explode(mapped).alias("m"), "val").select("m.src", "m.start", "m.end", "val")
        out.append((rows.where(F.col("end") > F.col("start")), ks))
    return out


def dtype_of(dtype: Any) -> str:
    if dtype in _KINDS:
        return _KINDS[dtype]
    if dtype in scalar.SQL_TYPES:
        return dtype
    raise InvalidTensor(f"no dtype {dtype!r}")


def kind_of(value: Any) -> str:
    if isinstance(value, (bool, np.bool_)):
        return "b"
    if isinstance(value, (int, np.integer)):
        return "i"
    if isinstance(value, (float, np.floating)):
        return "f"
    raise TypeConversion(f"{value!r} is no scalar")


def literal(value: Any, kind: str) -> Column:
    if kind == "i":
        value = (int(value) + (1 << 31)) % (1 << 32) - (1 << 31)
    return F.lit({"i": int, "f": float, "b": bool, "c": int}[kind](value)).cast(scalar.SQL_TYPES[kind])


class StepTensor:
    """See the module. Build with :func:`full`, :func:`from_numpy`, :func:`from_cells`, :func:`from_runs`, :func:`builder`."""

    def __init__(self, spark: SparkSession, shape: tuple[int, ...], kind: str, sources: tuple[Source, ...], fn: Callable[[list[Column]], Column], text: str):
        if any(n < 0 for n in shape) or not shape:
            raise InvalidTensor(f"no shape {shape}")
        self.spark, self.shape, self.kind, self.sources, self.fn, self.text = spark, tuple(shape), kind, sources, fn, text

    # metadata
    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def dtype(self) -> str:
        return self.kind

    @property
    def length(self) -> int:
        return prod(self.shape)

    def __len__(self) -> int:
        return self.length

    def empty(self) -> bool:
        return self.length == 0

    def clone(self) -> StepTensor:
        return StepTensor(self.spark, self.shape, self.kind, self.sources, self.fn, self.text)

    def explain(self) -> str:
        """The expression, and the plan that it becomes."""
        plan = self.frame()._jdf.queryExecution().toString()
        return f"{self.text}\n{len(self.sources)} sources\n{plan}"

    # plans
    def frame(self) -> DataFrame:
        """Runs (start, end, val); equal neighbours may remain."""
        kind = scalar.SQL_TYPES[self.kind]
        if not self.length:
            return R.empty(self.spark, kind)
        if not self.sources:
            return R.constant(self.spark, self.length, self.fn([]).cast(kind))
        if len(self.sources) == 1:
            return self.sources[0].frame().select("start", "end", self.fn([F.col("val")]).cast(kind).alias("val"))
        return align(parts_of(self.sources), [scalar.SQL_TYPES[s.leaf.kind] for s in self.sources], self.length, lambda c: self.fn(c).cast(kind))

    def _leaf(self, frame: DataFrame, shape: tuple[int, ...] | None = None, kind: str | None = None, text: str = "runs") -> StepTensor:
        return from_runs(frame, self.shape if shape is None else shape, kind or self.kind, text)

    def eval(self) -> StepTensor:
        """Worked out now, and kept in runs in the checkpoint folder."""
        return self._leaf(config.checkpointed(self.runs()))

    def _flushed(self) -> StepTensor:
        return self.eval() if len(self.sources) > config.get_value("flush_sources") else self

    # operators
    def unary(self, name: str) -> StepTensor:
        op, kind = scalar.UNARY[name]
        old, t = self.fn, self.kind
        return StepTensor(self.spark, self.shape, kind or t, self.sources, lambda c: op(old(c), t), f"{name}({self.text})")

    def binary(self, name: str, other: Any, reflected: bool = False) -> StepTensor:
        op, kind = scalar.BINARY[name]
        a, b = self, other if isinstance(other, StepTensor) else full(self.spark, (1,), other, kind_of(other))
        if a.kind != b.kind:
            if not isinstance(other, StepTensor) or name == "truediv":
                a, b = promote(a, b)
            else:
                raise IncompatibleTensor(f"dtypes {a.kind} and {b.kind}; cast one with to()")
        if a.kind == "b" and name in ("add", "sub", "mul", "floordiv", "mod", "pow", "truediv"):
            a, b = a.to("i"), b.to("i")
        if reflected:
            a, b = b, a
        t = a.kind
        return map_values(lambda x, y: op(x, y, t), a, b, kind=kind or t, text=f"{name}({a.text}, {b.text})")

    def to(self, dtype: Any) -> StepTensor:
        kind, t, old = dtype_of(dtype), self.kind, self.fn
        return self if kind == t else StepTensor(self.spark, self.shape, kind, self.sources, lambda c: scalar.cast(old(c), t, kind), f"{kind}({self.text})")

    # indexing
    def __getitem__(self, index: Any) -> Any:
        bounds = normalise(index, self.shape)
        if not any(isinstance(p, slice) or p is Ellipsis for p in (index if isinstance(index, tuple) else (index,))):
            return self.at(sum(b[0] * s for b, s in zip(bounds, [prod(self.shape[:k]) for k in range(self.ndim)], strict=True)))
        return self.sliced(bounds)

    def at(self, position: int) -> Any:
        """The value of one flat position: a range filter on the sources."""
        rows = self.sliced_flat(position, position + 1).frame().select("val").collect()
        return rows[0][0]

    def sliced_flat(self, start: int, stop: int) -> StepTensor:
        return self.flatten().sliced(((start, stop, 1),))

    def sliced(self, bounds: tuple[tuple[int, int, int], ...]) -> StepTensor:
        m = SliceMap(self.shape, bounds)
        if m.is_identity:
            return self
        sources = tuple(Source(s.leaf, (*s.maps, m)) for s in self.sources)
        return StepTensor(self.spark, counts(bounds), self.kind, sources, self.fn, f"slice({self.text}, {bounds})")

    def set(self, index: Any, value: Any) -> StepTensor:
        """A tensor with the slice of ``index`` replaced by a scalar or a tensor of its shape."""
        bounds = normalise(index, self.shape)
        shape = counts(bounds)
        if not prod(shape):
            return self
        patch = value if isinstance(value, StepTensor) else full(self.spark, shape, value, self.kind)
        if isinstance(value, StepTensor):
            if value.kind != self.kind:
                raise IncompatibleTensor(f"dtypes {self.kind} and {value.kind}")
            if value.shape == (1,) and shape != (1,):
                raise_scalar = value.fn if not value.sources else None
                patch = StepTensor(self.spark, shape, self.kind, (), raise_scalar, value.text) if raise_scalar else full(self.spark, shape, value.item(), self.kind)
            elif value.shape != shape:
                raise IncompatibleTensor(f"a slice of shape {shape} can't take {value.shape}")
        m = SliceMap(self.shape, bounds)
        if m.is_identity:
            return self._leaf(patch.frame(), text=patch.text)
        return self._leaf(overlay(self.frame(), scatter(patch.frame(), m), self.length), text=f"set({self.text}, {bounds}, {patch.text})")

    def __setitem__(self, index: Any, value: Any) -> None:
        new = self.set(index, value)._flushed()
        self.sources, self.fn, self.text = new.sources, new.fn, new.text

    # shape
    def reshape(self, *shape: int) -> StepTensor:
        shape = shape[0] if len(shape) == 1 and isinstance(shape[0], tuple) else shape
        if prod(shape) != self.length:
            raise IncompatibleTensor(f"{self.shape} can't be {shape}")
        return StepTensor(self.spark, shape, self.kind, self.sources, self.fn, self.text)

    def flatten(self) -> StepTensor:
        return self.reshape((self.length,))

    def squeeze(self, axis: int | None = None) -> StepTensor:
        """Without unit axes, or without ``axis``; a single cell has shape (1,)."""
        if axis is not None and self.shape[axis] != 1:
            raise IncompatibleTensor(f"axis {axis} isn't a unit axis")
        keep = tuple(n for k, n in enumerate(self.shape) if (k != axis if axis is not None else n != 1))
        return self.reshape(keep or (1,))

    def to_array(self) -> StepTensor:
        return self.flatten()

    # sinks
    def runs(self) -> DataFrame:
        """Canonical runs: start, end, val."""
        return R.canonical(self.frame(), self.length)

    def cells(self) -> DataFrame:
        """One row per cell: pos, val."""
        return R.decode(self.frame())

    def rle_length(self) -> int:
        return self.runs().count()

    def dumps(self) -> str:
        return R.dumps(self.frame(), self.length)

    def to_numpy(self) -> np.ndarray:
        """A dense array of the reversed shape, on the driver."""
        out = np.zeros(self.length, _NUMPY[self.kind])
        for start, end, val in self.frame().toPandas().itertuples(index=False):
            out[start:end] = val
        return out.reshape(self.shape[::-1])

    def to_list(self) -> list:
        return self.to_numpy().reshape(-1).tolist()

    def item(self) -> Any:
        if self.length != 1:
            raise InvalidTensor("only a single cell is an item")
        return self.frame().first()["val"]

    def format(self, threshold: int = 20, separator: str = ", ") -> str:
        """Values with axes longer than the threshold shown by their ends; only those cells are fetched."""
        edge = max(1, threshold // 2)
        parts = [[slice(None)] if n <= threshold else [slice(0, edge), slice(n - edge, n)] for n in self.shape]
        t = self
        for axis, p in enumerate(parts):
            if len(p) > 1:
                n = t.shape[axis]
                pick = [slice(None)] * self.ndim
                t = concat_axis([t[tuple(pick[:axis] + [slice(0, edge)] + pick[axis + 1 :])], t[tuple(pick[:axis] + [slice(n - edge, n)] + pick[axis + 1 :])]], axis)
        dense = t.to_numpy()

        def show(block: np.ndarray, axis: int) -> str:
            if axis < 0:
                return str(block)
            items = [show(x, axis - 1) for x in block]
            if len(parts[axis]) > 1:
                items.insert(edge, "...")
            return "[" + separator.join(items) + "]"

        return show(dense, self.ndim - 1)

    def __repr__(self) -> str:
        return f"StepTensor(shape={self.shape}, dtype={self.kind}, {self.format(10)})"

    __str__ = __repr__
    __hash__ = object.__hash__


def _install() -> None:
    pairs = {"add": "add", "sub": "sub", "mul": "mul", "truediv": "truediv", "floordiv": "floordiv", "mod": "mod", "pow": "pow", "and": "and", "or": "or", "xor": "xor", "lshift": "shl", "rshift": "shr"}
    for dunder, name in pairs.items():
        setattr(StepTensor, f"__{dunder}__", lambda self, other, name=name: self.binary(name, other))
        setattr(StepTensor, f"__r{dunder}__", lambda self, other, name=name: self.binary(name, other, True))
        setattr(StepTensor, f"__i{dunder}__", lambda self, other, name=name: self.binary(name, other)._flushed())
    for name in ("eq", "ne", "lt", "le", "gt", "ge"):
        setattr(StepTensor, f"__{name}__", lambda self, other, name=name: self.binary(name, other))
    for name in ("min", "max", "coalesce"):
        setattr(StepTensor, name, lambda self, other, name=name: self.binary(name, other))
    for dunder, name in {"__neg__": "neg", "__pos__": "pos", "__invert__": "invert", "__abs__": "abs", "abs": "abs", "sqrt": "sqrt", "exp": "exp", "logical_not": "not"}.items():
        setattr(StepTensor, dunder, lambda self, name=name: self.unary(name))


_install()


def promote(a: StepTensor, b: StepTensor) -> tuple[StepTensor, StepTensor]:
    """Both as the wider dtype: b, c, i, f."""
    wide = max(a.kind, b.kind, key="bcif".index)
    return a.to(wide), b.to(wide)


def map_values(fn: Callable[..., Column], *tensors: StepTensor, kind: str | None = None, text: str | None = None) -> StepTensor:
    """A Column function over aligned tensors of one shape; tensors of shape (1,) without sources are scalars."""
    shapes = [t.shape for t in tensors if not (t.shape == (1,) and not t.sources)] or [(1,)]
    scalars = [t for t in tensors if t.shape == (1,) and t.sources and any(s != (1,) for s in shapes)]
    tensors = tuple(full(t.spark, (1,), t.item(), t.kind) if t in scalars else t for t in tensors) if scalars else tensors
    shapes = [t.shape for t in tensors if not (t.shape == (1,) and not t.sources)] or [(1,)]
    if len(set(shapes)) != 1:
        raise IncompatibleTensor(f"shapes {shapes}")
    sources: dict[Source, int] = {}
    places = [[sources.setdefault(s, len(sources)) for s in t.sources] for t in tensors]
    fns = [t.fn for t in tensors]
    first = tensors[0]
    out = StepTensor(first.spark, shapes[0], kind or first.kind, tuple(sources), lambda c: fn(*(f([c[i] for i in at]) for f, at in zip(fns, places, strict=True))), text or f"map({', '.join(t.text for t in tensors)})")
    return out._flushed()


def where(mask: StepTensor, a: Any, b: Any) -> StepTensor:
    """a where the mask isn't zero, else b."""
    ref = a if isinstance(a, StepTensor) else b
    kind = ref.kind if isinstance(ref, StepTensor) else kind_of(a)
    a, b = (x if isinstance(x, StepTensor) else full(mask.spark, (1,), x, kind) for x in (a, b))
    t = mask.kind
    return map_values(lambda m, x, y: F.when(scalar.nonzero(m, t), x).otherwise(y), mask, a, b, kind=kind, text="select")


def scatter(runs: DataFrame, m: SliceMap) -> DataFrame:
    """Runs over the slice's cells, at their places in the tensor: a run per row of the slice, or per cell if axis 0 strides."""
    width = counts(m.bounds)[0] if m.bounds[0][2] == 1 else 1
    cut = R.split(runs, width)
    begin = m.place(F.col("start"))
    return cut.select(begin.alias("start"), (begin + F.col("end") - F.col("start")).alias("end"), "val")


def full(spark: SparkSession, shape: int | tuple[int, ...], value: Any = 0, dtype: Any = None) -> StepTensor:
    """One value everywhere."""
    shape = (shape,) if isinstance(shape, int) else tuple(shape)
    kind = dtype_of(dtype) if dtype is not None else kind_of(value)
    return StepTensor(spark, shape, kind, (), lambda c: literal(value, kind), repr(value))


def from_runs(frame: DataFrame, shape: int | tuple[int, ...], dtype: Any, text: str = "runs") -> StepTensor:
    """A frame of (start, end, val) that covers the domain once."""
    shape = (shape,) if isinstance(shape, int) else tuple(shape)
    kind = dtype_of(dtype)
    return StepTensor(frame.sparkSession, shape, kind, (Source(Leaf(frame, prod(shape), kind)),), lambda c: c[0], text)


def from_cells(cells: DataFrame, shape: int | tuple[int, ...], dtype: Any, pos: str = "pos", val: str = "val") -> StepTensor:
    """A table of cells with dense, unique positions, as runs."""
    kind = dtype_of(dtype)
    length = shape if isinstance(shape, int) else prod(shape)
    return from_runs(R.encode(cells.withColumn(val, F.col(val).cast(scalar.SQL_TYPES[kind])), length, pos, val), shape, kind, "cells")


def from_sparse(cells: DataFrame, shape: int | tuple[int, ...], dtype: Any, fill: Any = 0, pos: str = "pos", val: str = "val") -> StepTensor:
    """A table of some cells (unique positions), ``fill`` elsewhere."""
    kind = dtype_of(dtype)
    base = full(cells.sparkSession, shape, fill, kind)
    patch = cells.select(F.col(pos).cast("bigint").alias("start"), (F.col(pos).cast("bigint") + 1).alias("end"), F.col(val).cast(scalar.SQL_TYPES[kind]).alias("val"))
    return from_runs(overlay(base.frame(), patch, base.length), base.shape, kind, "sparse")


def from_numpy(spark: SparkSession, array: np.ndarray, dtype: Any = None) -> StepTensor:
    """A dense array; shape reversed, dtype kept. Runs are found by numpy, and only they are sent."""
    array = np.asarray(array)
    kind = dtype_of(dtype) if dtype is not None else {"b": "b", "f": "f"}.get(array.dtype.kind, "c" if array.dtype == np.int8 else "i")
    flat = array.reshape(-1).astype(_NUMPY[kind])
    shape = array.shape[::-1] or (1,)
    if not len(flat):
        return from_runs(R.empty(spark, scalar.SQL_TYPES[kind]), shape, kind)
    start = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    rows = list(zip(start.tolist(), [*start[1:].tolist(), len(flat)], flat[start].tolist(), strict=True))
    return from_runs(spark.createDataFrame(rows, f"start bigint, end bigint, val {scalar.SQL_TYPES[kind]}"), shape, kind, "numpy")


def from_list(spark: SparkSession, values: list, dtype: Any = None) -> StepTensor:
    kind = dtype or (kind_of(values[0]) if values else "i")
    return from_numpy(spark, np.array(values, _NUMPY[dtype_of(kind)]), kind)


class Builder:
    """Collects point and range updates; ``build`` writes them in order over the fill, the last writer wins.

    The driver keeps a box for each update; boxes become runs, and tensors are put in their places, in Spark.
    """

    def __init__(self, spark: SparkSession, shape: int | tuple[int, ...], value: Any = 0, dtype: Any = None):
        self.base = full(spark, shape, value, dtype)
        self.value = value
        self.boxes: list[tuple] = []
        self.tensors: list[tuple[int, tuple, StepTensor]] = []

    def __setitem__(self, index: Any, value: Any) -> None:
        bounds = normalise(index, self.base.shape)
        if any(s != 1 for *_, s in bounds):
            raise ValueError("a builder's ranges have no stride")
        seq = len(self.boxes) + len(self.tensors)
        if not isinstance(value, StepTensor):
            self.boxes.append((seq, [b[0] for b in bounds], [b[1] for b in bounds], {"i": int, "f": float, "b": bool, "c": int}[self.base.kind](value)))
            return
        if value.kind != self.base.kind or value.shape not in (counts(bounds), (prod(counts(bounds)),)):
            raise IncompatibleTensor(f"a range of shape {counts(bounds)} can't take {value.shape} of {value.kind}")
        self.tensors.append((seq, bounds, value))

    def dumps(self) -> str:
        return self.build().dumps()

    def _box_runs(self) -> DataFrame:
        """A run for every row of cells of every box."""
        shape, kind = self.base.shape, scalar.SQL_TYPES[self.base.kind]
        rows = self.base.spark.createDataFrame(self.boxes, f"seq bigint, low array<bigint>, high array<bigint>, val {kind}")
        rows = rows.where(F.forall(F.zip_with("low", "high", lambda a, b: a < b), lambda x: x)).withColumn("at", F.lit(0).cast("bigint"))
        for axis in range(1, len(shape)):
            rows = rows.withColumn("k", F.explode(F.sequence(F.col("low")[axis], F.col("high")[axis] - 1))).withColumn("at", F.col("at") + F.col("k") * prod(shape[:axis]))
        return rows.select("seq", (F.col("at") + F.col("low")[0]).alias("start"), (F.col("at") + F.col("high")[0]).alias("end"), "val")

    def build(self) -> StepTensor:
        frames = [self._box_runs()] if self.boxes else []
        frames += [scatter(t.frame(), SliceMap(self.base.shape, bounds)).select(F.lit(seq).cast("bigint").alias("seq"), "start", "end", "val") for seq, bounds, t in self.tensors]
        if not frames:
            return self.base
        return apply_updates(reduce(DataFrame.unionByName, frames), self.base.shape, self.value, self.base.kind)


def builder(spark: SparkSession, shape: int | tuple[int, ...], value: Any = 0, dtype: Any = None) -> Builder:
    return Builder(spark, shape, value, dtype)


def apply_updates(updates: DataFrame, shape: int | tuple[int, ...], fill: Any = 0, dtype: Any = None) -> StepTensor:
    """A table of range updates (seq, start, end, val) over a fill, as runs."""
    base = full(updates.sparkSession, shape, fill, dtype)
    frame = R.last_writer(updates, literal(fill, base.kind), base.length)
    return from_runs(frame.withColumn("val", F.col("val").cast(scalar.SQL_TYPES[base.kind])), base.shape, base.kind, "updates")


def shifted(t: StepTensor, shape: tuple[int, ...], at: tuple[int, ...]) -> DataFrame:
    """The runs of ``t`` as a block of a larger tensor, at ``at``."""
    bounds = tuple((a, a + n, 1) for a, n in zip(at, t.shape, strict=True))
    return scatter(t.frame(), SliceMap(shape, bounds))


def concat_axis(tensors: list[StepTensor], axis: int) -> StepTensor:
    """Tensors side by side along one axis: a union of shifted runs."""
    shape = list(tensors[0].shape)
    shape[axis] = sum(t.shape[axis] for t in tensors)
    at, frames = 0, []
    for t in tensors:
        place = [0] * len(shape)
        place[axis] = at
        frames.append(shifted(t, tuple(shape), tuple(place)))
        at += t.shape[axis]
    return from_runs(reduce(DataFrame.unionByName, frames), tuple(shape), tensors[0].kind, "concat")
